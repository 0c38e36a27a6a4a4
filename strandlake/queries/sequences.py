"""Sequence functions, k-mers and reading frames on texts turned to nucleotides."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import sequences as Q
from strandlake.operators import orf as O
from strandlake.queries import roles as R
from strandlake.queries.pairs import CODON_TABLE
from strandlake.queries.roles import rounded

ALPHABET = "'abcdefghijklmnopqrstuvwxyz', 'ACGTTGCACGATCGTANCGTAGCTCG'"


def dna(spark, sf):
    text = F.expr(f"translate(regexp_replace(lower(text), '[^a-z]', ''), {ALPHABET})")
    return R.read(spark, sf, "benchmark").select(F.col("item_id").alias("seq_id"), text.alias("seq"))


DNA_SQL = f"dna AS (SELECT item_id AS seq_id, translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), {ALPHABET}) AS seq FROM benchmark)"


def composition(spark, sf):
    s = F.col("seq")
    rows = dna(spark, sf).select(
        "seq_id", Q.reverse_complement(s).alias("revcomp"), Q.gc_ratio(s).alias("gc"), Q.n_count(s).alias("ns"), Q.cpg_observed_expected(s).alias("cpg_oe"), Q.cpg_percent(s).alias("cpg_percent"),
        Q.codon_position_gc(s, 3).alias("gc3"), Q.gc_ratio(Q.region(s, F.lit(11), F.lit(40))).alias("gc_region"),
    )
    return rounded(rows, "gc", "cpg_oe", "cpg_percent", "gc3", "gc_region")


def translation(spark, sf):
    return dna(spark, sf).select("seq_id", Q.translate(F.col("seq"), 2).alias("aa"))


def region_summary(spark, sf):
    """Average composition per group of sequences."""
    rows = dna(spark, sf).groupBy((F.col("seq_id") % 5).alias("ds")).agg(F.avg(F.length("seq")).alias("mean_len"), F.avg(Q.gc_ratio(F.col("seq"))).alias("mean_gc"))
    return rounded(rows, "mean_len", "mean_gc")


def gap_maps(spark, sf):
    aligned = F.regexp_replace("text", "[ .,]", "-")
    rows = R.read(spark, sf, "benchmark").select("item_id", aligned.alias("a")).withColumn("g", Q.gap_map(F.col("a")))
    back = Q.with_gaps(F.regexp_replace("a", "-", ""), Q.parse_gap_text(Q.gap_text(F.col("g"))))
    return rows.select("item_id", F.size("g").cast("long").alias("n_gaps"), (back == F.col("a")).alias("same"))


def codon_usage(spark, sf):
    return rounded(O.codon_scores(dna(spark, sf).withColumnRenamed("seq", "orf")), "score")


def kmers(spark, sf):
    return O.kmers(dna(spark, sf), 4, "seq")


def markov(spark, sf):
    rows = dna(spark, sf)
    return rounded(O.markov_scores(rows, O.base_frequencies(rows), text="seq"), "score")


def host_counts(spark, sf):
    """Lines of the location form of pages' addresses: host and path, as a text format is parsed."""
    host = F.regexp_extract("url", r"^https?://([^/]+)", 1)
    return R.read(spark, sf, "pages").groupBy(host.alias("host")).agg(F.count(F.lit(1)).alias("n"), F.max(F.length("html")).cast("long").alias("longest"))


def count(letters: str, text: str = "seq") -> str:
    return f"len(regexp_replace({text}, '[^{letters}]', '', 'g'))"


def gc(text: str) -> str:
    return f"CASE WHEN {count('ACGT', text)} > 0 THEN {count('GC', text)} / {count('ACGT', text)} ELSE 0 END"


THIRDS = "list_aggregate(list_transform(range(1, len(seq) // 3 + 1), lambda i: seq[i * 3]), 'string_agg', '')"
CPG = "len(regexp_extract_all(seq, 'CG'))"

QUERIES = {
    "q03_q05_s10_composition": (composition, f"""WITH {DNA_SQL} SELECT seq_id, translate(reverse(seq), 'ACGT', 'TGCA') AS revcomp, round({gc('seq')}, 6) AS gc, CAST({count('N')} AS INT) AS ns,
        round(CASE WHEN {count('C')} > 0 AND {count('G')} > 0 THEN {CPG} / ({count('C')} * {count('G')}) * len(seq) ELSE 0 END, 6) AS cpg_oe, round(2 * {CPG} / len(seq) * 100, 6) AS cpg_percent,
        round({gc(THIRDS)}, 6) AS gc3, round({gc('substr(seq, 11, 30)')}, 6) AS gc_region FROM dna"""),
    "q01_q02_translation": (translation, f"""WITH {DNA_SQL}, {CODON_TABLE}, c AS (SELECT seq_id, i, substr(seq, i * 3 + 2, 3) AS codon FROM (SELECT *, unnest(range(0, (len(seq) - 1) // 3)) AS i FROM dna))
        SELECT seq_id, string_agg(coalesce(aa, 'X'), '' ORDER BY i) AS aa FROM c LEFT JOIN code USING (codon) GROUP BY 1"""),
    "a15_region_summary": (region_summary, f"WITH {DNA_SQL} SELECT seq_id % 5 AS ds, round(avg(len(seq)), 6) AS mean_len, round(avg({gc('seq')}), 6) AS mean_gc FROM dna GROUP BY 1"),
    "s12_gap_maps": (gap_maps, "SELECT item_id, len(regexp_extract_all(regexp_replace(text, '[ .,]', '-', 'g'), '-+')) AS n_gaps, true AS same FROM benchmark"),
    "q14_codon_usage": (codon_usage, f"""WITH {DNA_SQL}, {CODON_TABLE}, c AS (SELECT substr(seq, i * 3 + 1, 3) AS codon FROM (SELECT *, unnest(range(0, len(seq) // 3)) AS i FROM dna)), n AS (SELECT codon, aa, count(c.codon) AS n FROM code LEFT JOIN c USING (codon) GROUP BY ALL),
        t AS (SELECT sum(n) AS t, min(n) FILTER (n > 0) AS least FROM n WHERE aa <> '*') SELECT codon, n, round(CASE WHEN aa = '*' THEN -20 WHEN n > 0 THEN ln(n / t) ELSE ln(least / t) - 1 END, 6) AS score FROM n, t"""),
    "q15_kmers": (kmers, f"WITH {DNA_SQL}, k AS (SELECT substr(seq, i, 4) AS kmer, CAST((i + 2) % 3 AS INT) AS phase FROM (SELECT *, unnest(range(1, len(seq) - 2)) AS i FROM dna)) SELECT kmer, phase, count(*) AS n FROM k GROUP BY ALL"),
    "q15_markov": (markov, f"""WITH {DNA_SQL}, k AS (SELECT substr(seq, i, 6) AS kmer, CAST((i + 4) % 3 AS INT) AS phase, count(*) AS n FROM (SELECT *, unnest(range(1, len(seq) - 4)) AS i FROM dna) GROUP BY ALL), f AS (SELECT * FROM k WHERE regexp_full_match(kmer, '[ACGT]+')),
        b AS (SELECT sum({count('AT')}) AS n_at, sum({count('GC')}) AS n_gc FROM dna), p AS (SELECT kmer[:5] AS pre, phase, sum(n) AS p FROM f GROUP BY ALL)
        SELECT kmer, phase, round(ln((n + 1) / (p + 4) / (CASE WHEN kmer[6] IN ('A', 'T') THEN n_at ELSE n_gc END / 2 / (n_at + n_gc))), 6) AS score FROM f JOIN p USING (phase), b WHERE pre = kmer[:5]"""),
    "i18_host_counts": (host_counts, "SELECT regexp_extract(url, '^https?://([^/]+)', 1) AS host, count(*) AS n, CAST(max(length(html)) AS BIGINT) AS longest FROM pages GROUP BY 1"),
}
