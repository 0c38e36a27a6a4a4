"""Normalisation, library filters, differential expression and enrichment inputs."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import expression as E
from strandlake.queries import roles as R
from strandlake.queries.roles import COUNTS_SQL, rounded


def tpm(spark, sf):
    return rounded(E.tpm(R.counts(spark, sf), R.lengths(spark, sf)), "tpm")


def rpkm(spark, sf):
    counts = R.counts(spark, sf)
    return rounded(E.rpkm_to_tpm(E.rpkm(counts, R.lengths(spark, sf), E.library_sizes(counts))), "rpkm", "tpm")


def library_sizes(spark, sf):
    return E.library_sizes(R.counts(spark, sf))


def r_statistic(spark, sf):
    counts = R.counts(spark, sf)
    return E.r_statistic(counts, E.library_sizes(counts))


def member_counts(spark, sf):
    members = R.read(spark, sf, "part").select((F.col("p_partkey") % 50).alias("contig"), F.col("p_partkey").alias("seq_id"), F.lit("X").alias("lib"))
    return E.member_counts(members, R.counts(spark, sf).where("n > 100"))


def cpm_filter(spark, sf):
    return E.cpm_filter(R.reps(spark, sf), cpm=550.0, least=2)


def library_filter(spark, sf):
    return E.library_filter(R.counts(spark, sf).where("rep = 0"), {"libs": ["A", "N"], "value": 200, "how": "all"}, {"libs": ["R"], "value": 300, "how": "any"})


def sample_matrix(spark, sf):
    return E.sample_matrix(R.reps(spark, sf), ["A", "N", "R"], 2)


def raw(spark, sf):
    """Signed p-values from events, one contrast for each type."""
    v = F.col("value")
    p = F.when(F.col("event_id") % 17 == 0, float("nan")).when(F.col("event_id") % 2 == 0, F.round(v % 1, 2)).otherwise(-F.round(v % 1, 2))
    return R.read(spark, sf, "events").select(F.col("event_id").alias("seq_id"), F.col("event_type").alias("contrast"), p.alias("p"))


DE_SQL = "de AS (SELECT event_id AS seq_id, event_type AS contrast, CASE WHEN event_id % 17 = 0 THEN NULL ELSE round(value % 1, 2) END AS p, CASE WHEN event_id % 17 <> 0 AND event_id % 2 <> 0 AND round(value % 1, 2) > 0 THEN -1 ELSE 1 END AS direction FROM events)"


def de_results(spark, sf):
    return E.de_results(raw(spark, sf))


def de_direction(spark, sf):
    counts = R.counts(spark, sf)
    levels = E.tpm(counts, R.lengths(spark, sf))
    own = R.read(spark, sf, "part").select(F.col("p_partkey").alias("seq_id"), F.lit("A:R").alias("contrast"), (F.col("p_size") / 100).alias("p"))
    return E.de_results(own, levels, "A", "R")


def de_counts(spark, sf):
    return E.de_counts(E.de_results(raw(spark, sf)))


def benjamini_hochberg(spark, sf):
    return rounded(E.benjamini_hochberg(E.de_results(raw(spark, sf))).select("seq_id", "contrast", "p", "adjusted"), "adjusted")


def enrichment_inputs(spark, sf):
    go = R.read(spark, sf, "events").where("event_id % 3 <> 0").select(F.col("event_id").alias("seq_id"), F.explode(F.array(F.col("user_id").cast("int") % 7, F.col("user_id").cast("int") % 5)).alias("gonum"))
    lengths = R.read(spark, sf, "events").select(F.col("event_id").alias("seq_id"), (F.col("user_id") * 10).alias("len"))
    return E.enrichment_inputs(E.de_results(raw(spark, sf)), go, lengths)


def enrichment_list(spark, sf):
    return enrichment_inputs(spark, sf).withColumn("terms", F.concat_ws(",", F.transform("terms", lambda x: x.cast("string"))))


def de_length_stats(spark, sf):
    return rounded(E.de_length_stats(enrichment_inputs(spark, sf)), "mean_len", "sd_len")


def top_percent(spark, sf):
    return E.top_percent_cutoff(raw(spark, sf).where("NOT isnan(p)"), 10)


ENRICH_SQL = f"""{DE_SQL}, go AS (SELECT event_id AS seq_id, list_sort(list_distinct([CAST(user_id AS INT) % 7, CAST(user_id AS INT) % 5])) AS terms, user_id * 10 AS len FROM events WHERE event_id % 3 <> 0),
inputs AS (SELECT seq_id, contrast, CAST(coalesce(p < 0.05, false) AS INT) AS is_de, len, array_to_string(terms, ',') AS terms FROM de JOIN go USING (seq_id))"""

QUERIES = {
    "n01_tpm": (tpm, f"""WITH {COUNTS_SQL}, r AS (SELECT seq_id, lib, n, n * 1000.0 / len AS rpk FROM counts JOIN lengths USING (seq_id) WHERE rep = 0)
        SELECT seq_id, lib, n, round(rpk / (sum(rpk) OVER (PARTITION BY lib) / 1e6), 6) AS tpm FROM r"""),
    "n02_n03_rpkm": (rpkm, f"""WITH {COUNTS_SQL}, r AS (SELECT seq_id, lib, n, (n / (size / 1e6)) * 1000 / len AS rpkm FROM counts JOIN lengths USING (seq_id) JOIN sizes USING (lib) WHERE rep = 0)
        SELECT seq_id, lib, n, round(rpkm, 6) AS rpkm, round(1e6 * rpkm / sum(rpkm) OVER (PARTITION BY lib), 6) AS tpm FROM r"""),
    "n04_library_sizes": (library_sizes, f"WITH {COUNTS_SQL} SELECT * FROM sizes"),
    "n05_r_statistic": (r_statistic, f"""WITH {COUNTS_SQL}, t AS (SELECT seq_id, sum(n) AS total FROM counts WHERE rep = 0 GROUP BY 1)
        SELECT seq_id, greatest(round(sum(n * log10(n / (total / (SELECT sum(size) FROM sizes) * size))), 1), 0) AS r_stat FROM counts JOIN t USING (seq_id) JOIN sizes USING (lib) WHERE rep = 0 AND n > 0 GROUP BY 1"""),
    "n06_member_counts": (member_counts, f"""WITH {COUNTS_SQL} SELECT p_partkey % 50 AS contig, coalesce(lib, 'X') AS lib, CAST(sum(coalesce(n, 1)) AS BIGINT) AS n
        FROM part LEFT JOIN (SELECT * FROM counts WHERE rep = 0 AND n > 100) c ON c.seq_id = p_partkey GROUP BY ALL"""),
    "n07_cpm_filter": (cpm_filter, f"""WITH {COUNTS_SQL}, t AS (SELECT lib, rep, sum(n) AS t FROM reps GROUP BY ALL)
        SELECT seq_id, count(*) AS n_samples FROM reps JOIN t USING (lib, rep) WHERE n / t * 1e6 > 550 GROUP BY 1 HAVING count(*) >= 2"""),
    "f03_library_filter": (library_filter, f"""WITH {COUNTS_SQL} SELECT seq_id FROM counts WHERE rep = 0 GROUP BY 1
        HAVING coalesce(max(n) FILTER (lib = 'A'), 0) >= 200 AND coalesce(max(n) FILTER (lib = 'N'), 0) >= 200 AND coalesce(max(n) FILTER (lib = 'R'), 0) <= 300"""),
    "d01_x06_sample_matrix": (sample_matrix, f"WITH {COUNTS_SQL} SELECT seq_id, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (lib = '{x}' AND rep = {r}), 0) AS BIGINT) AS {x}{r}" for x in "ANR" for r in (1, 2)) + " FROM reps GROUP BY 1"),
    "d05_de_results": (de_results, f"WITH {DE_SQL} SELECT * FROM de"),
    "d05_de_direction": (de_direction, f"""WITH {COUNTS_SQL}, r AS (SELECT seq_id, lib, n * 1000.0 / len AS rpk FROM counts JOIN lengths USING (seq_id) WHERE rep = 0),
        t AS (SELECT seq_id, lib, rpk / (sum(rpk) OVER (PARTITION BY lib) / 1e6) AS tpm FROM r)
        SELECT p_partkey AS seq_id, 'A:R' AS contrast, p_size / 100 AS p, CASE WHEN coalesce(a.tpm, 0) < coalesce(b.tpm, 0) THEN -1 ELSE 1 END AS direction
        FROM part LEFT JOIN t a ON a.seq_id = p_partkey AND a.lib = 'A' LEFT JOIN t b ON b.seq_id = p_partkey AND b.lib = 'R'"""),
    "d06_de_counts": (de_counts, f"""WITH {DE_SQL} SELECT contrast, count(p) AS n_results, """ + ", ".join(f"CAST(sum(CAST(p < {c!r} AS INT)) AS BIGINT) AS n_{f'{c:g}'.replace('-', 'm').replace('.', '_')}" for c in E.DE_CUTOFFS) + ", CAST(sum(CAST(p < 0.05 AND direction > 0 AS INT)) AS BIGINT) AS n_up FROM de GROUP BY 1"),
    "d04_benjamini_hochberg": (benjamini_hochberg, f"""WITH {DE_SQL}, k AS (SELECT *, count(p) OVER (PARTITION BY contrast) AS n, count(p) OVER (PARTITION BY contrast ORDER BY p NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS r FROM de)
        SELECT seq_id, contrast, p, CASE WHEN p IS NOT NULL THEN round(least(min(p * n / r) OVER (PARTITION BY contrast, p IS NULL ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 1), 6) END AS adjusted FROM k"""),
    "d07_enrichment_inputs": (enrichment_list, f"WITH {ENRICH_SQL} SELECT * FROM inputs"),
    "d07_de_length_stats": (de_length_stats, f"WITH {ENRICH_SQL} SELECT contrast, count(*) AS n_de, round(avg(len), 6) AS mean_len, round(stddev_samp(len), 6) AS sd_len FROM inputs WHERE is_de = 1 GROUP BY 1"),
    "l06_top_percent": (top_percent, f"WITH {DE_SQL}, k AS (SELECT p, row_number() OVER (ORDER BY p) AS r, count(*) OVER () AS n FROM de WHERE p IS NOT NULL) SELECT min(p) AS cutoff FROM k WHERE r >= greatest(floor(n * 10 / 100), 1)"),
}
