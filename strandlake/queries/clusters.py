"""Clusters from pairs, their summaries, and scores of multiple alignments."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import clusters as C
from strandlake.operators import msa as M
from strandlake.operators import pairs as P
from strandlake.operators import stats as S
from strandlake.plans.filters import ClusterFilter, Levels, apply
from strandlake.queries import roles as R
from strandlake.queries.pairs import MATES_SQL
from strandlake.queries.roles import FLAGGED_SQL, PAIRS_SQL, rounded


def edge_filter(spark, sf):
    return C.edge_filter(R.pairs(spark, sf), sim=70, cov=60).select("seq1", "seq2")


def edge_filter_truncated(spark, sf):
    return C.edge_filter(R.pairs(spark, sf).withColumn("sim", F.col("sim") + 0.6), sim=71, cov=60, how="either", rounded=False).select("seq1", "seq2")


def reciprocal_best(spark, sf):
    return C.reciprocal_best(R.pairs(spark, sf))


def reciprocal_best_cut(spark, sf):
    """With cutoffs, of pairs that are each side's first."""
    rows = R.pairs(spark, sf).withColumns({"sim": F.col("sim") + 0.4, "best": F.when(F.col("bits") % 3 == 0, 1).otherwise(2)})
    return C.reciprocal_best(rows, sim=55, cov=50, how="either", flag="best")


def strong(spark, sf):
    return R.pairs(spark, sf).where("bits > 150").select("seq1", "seq2")


def components(spark, sf):
    return C.components(strong(spark, sf))


def mutual_sets(spark, sf):
    return C.mutual_sets(C.reciprocal_best(R.pairs(spark, sf)), 3)


def complete_linkage(spark, sf):
    return C.complete_linkage(C.edge_filter(R.pairs(spark, sf), sim=70, cov=60).withColumn("best", F.lit(2)))


def cliques(spark, sf):
    return C.cliques(edge_filter(spark, sf))


def shared_hit(spark, sf):
    members = R.read(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type", F.floor(F.col("p_size") / 10).cast("string")).alias("cluster"), F.col("p_partkey").alias("seq"))
    return C.by_shared_hit(members, R.pairs(spark, sf).select("seq1", "seq2"), "any")


def members_of(spark, sf):
    return R.read(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("cluster"), F.col("p_partkey").alias("seq"), (F.col("p_size") % 4).alias("ds"), F.lit("user").alias("method"))


def numbered(spark, sf):
    """The number that each cluster gets, beside its own name."""
    members = members_of(spark, sf).select("cluster", "seq")
    return C.numbered(members, "PP").withColumnRenamed("cluster", "name").join(members.withColumnRenamed("cluster", "old"), "seq").select("name", "old").distinct()


def majority(spark, sf):
    rows = R.flagged(spark, sf)
    return C.majority_description(rows.select((F.col("seq_id") % 300).alias("cluster"), F.col("seq_id").alias("seq"), "description", "good", F.col("best_anno").alias("is_anno"), "evalue", "dbtype", F.lit(0).alias("n_go")), least=3)


def taxa(spark, sf):
    return apply(C.taxa(members_of(spark, sf)), ClusterFilter(ranges={"n_seqs": (4, None)}))


def dataset_counts(spark, sf):
    rows = C.dataset_counts(members_of(spark, sf), [0, 1, 2, 3])
    rows = rows.select("cluster", *[F.col(str(i)).alias(f"ds{i}") for i in range(4)])
    return apply(rows, ClusterFilter(datasets=Levels(["ds0", "ds1"], 1, "all", ["ds3"], 3, "all")))


def correlation_summary(spark, sf):
    levels = R.reps(spark, sf).select("seq_id", F.concat("lib", F.col("rep").cast("string")).alias("lib"), F.col("n").cast("double").alias("value"))
    members = members_of(spark, sf).select("cluster", "seq")
    pcc = P.correlation(C.pairs_inside(members, R.pairs(spark, sf)), levels)
    return rounded(C.correlation_summary(members, pcc, good=0.1), "min_pcc")


def size_histogram(spark, sf):
    return rounded(C.size_histogram(members_of(spark, sf), n_datasets=4), "mean_size", "sd_size")


def score_summary(spark, sf):
    """Parts by brand as clusters, each method a manufacturer's digit; scores by size and price, some missing."""
    rows = R.read(spark, sf, "part").select(F.substring("p_brand", -1, 1).alias("method"), F.col("p_size").alias("con_len"), (F.col("p_partkey") % 9).alias("sd_len"), F.when(F.col("p_size") % 4 > 0, F.col("p_size") / 50).alias("score1"), (F.col("p_partkey") % 11).cast("double").alias("score2"))
    names = ["mean_con_len", "mean_sd_len", "mean_score1", "sd_score1", "mean_score2", "sd_score2"]
    return rounded(C.score_summary(rows), *names)


def menus(spark, sf):
    return S.menu(R.details(spark, sf), ["dbtype", "taxonomy", "species"])


def aligned_members(spark, sf):
    """Passages in clusters of four, filled up to the longest, as aligned members."""
    text = F.expr("lower(regexp_replace(text, '[^A-Za-z ]', ''))")
    rows = R.read(spark, sf, "benchmark").select(F.floor(F.col("item_id") / 4).cast("long").alias("cluster"), F.col("item_id").alias("member"), text.alias("text"))
    rows = rows.join(rows.groupBy("cluster").agg(F.max(F.length("text")).alias("len")), "cluster")
    return rows.select("cluster", "member", F.expr("translate(rpad(text, len, ' '), 'abcdefghijklmnopqrstuvwxyz ', 'ACGTACGTACGTACGTACGTACGTAC-')").alias("aligned"))


def consensus(spark, sf):
    """Transitions count as related letters."""
    matrix = spark.createDataFrame([("A", "G", 1.0), ("C", "T", 1.0), ("A", "C", -1.0)], "a string, b string, score double")
    return M.consensus(M.letter_counts(aligned_members(spark, sf)), matrix)


def consensus_nt(spark, sf):
    return M.consensus(M.letter_counts(aligned_members(spark, sf)))


def gapped(spark, sf):
    """Turns with consonants as gaps and words further apart in later turns, at times with a gap before and behind."""
    text = F.regexp_replace(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), "[^aeiou ]", "-")
    wide = F.replace(text, F.lit(" "), F.repeat(F.lit("-"), F.col("turn") * 2))
    edge = F.repeat(F.lit("-"), (F.col("conv_id") % 17).cast("int"))
    rows = R.read(spark, sf, "conversations").select("conv_id", "turn", F.concat(F.when(F.col("conv_id") % 3 == 0, "aa").otherwise(""), edge, wide, edge, F.when(F.col("conv_id") % 4 == 0, "e").otherwise("")).alias("consensus"))
    return rows.groupBy("conv_id", "turn").agg(F.min("consensus").alias("consensus"))


def trim(spark, sf):
    return M.trimmed(gapped(spark, sf)).drop("consensus")


def msa_scores(spark, sf):
    members = aligned_members(spark, sf)
    counts = M.letter_counts(members)
    matrix = spark.createDataFrame([(a, b, 4.0 if a == b else -1.0) for a in "ACGT" for b in "ACGT" if a <= b], "a string, b string, score double")
    rows = M.sum_of_pairs(counts, matrix).join(M.length_sd(members), "cluster")
    return rounded(rows, "sum_of_pairs", "sd_len")


def entropy(spark, sf):
    members = aligned_members(spark, sf)
    return rounded(M.entropy(M.letter_counts(members), members), "conservation")


def snps(spark, sf):
    bases = R.read(spark, sf, "lineitem").select((F.col("l_partkey") % 100).alias("contig"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_quantity") > 48, "T").when(F.col("l_quantity") > 44, "G").otherwise("A").alias("base"))
    return rounded(M.snps(bases.groupBy("contig", "pos", "base").agg(F.count(F.lit(1)).cast("int").alias("n")), error=0.1, least=2, threshold=0.01).drop("depth"), "p")


CUT = "bits % 3 <> 0 AND sim >= 55 AND (cov1 >= 50 OR cov2 >= 50)"
MEMBERS_SQL = "members AS (SELECT p_brand || '/' || p_type AS cluster, p_partkey AS seq, p_size % 4 AS ds FROM part)"
ALIGNED_SQL = """passages AS (SELECT item_id // 4 AS cluster, item_id AS member, lower(regexp_replace(text, '[^A-Za-z ]', '', 'g')) AS text FROM benchmark),
aligned AS (SELECT cluster, member, translate(rpad(text, CAST(max(len(text)) OVER (PARTITION BY cluster) AS INT), ' '), 'abcdefghijklmnopqrstuvwxyz ', 'ACGTACGTACGTACGTACGTACGTAC-') AS t FROM passages),
chars AS (SELECT cluster, member, i AS pos, CASE WHEN t[i] = '-' AND (i <= len(t) - len(ltrim(t, '-')) OR i > len(rtrim(t, '-'))) THEN '~' ELSE t[i] END AS letter FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM aligned)),
lc AS (SELECT cluster, pos, letter, count(*) AS n FROM chars GROUP BY ALL)"""



def consensus_sql(related: str) -> str:
    """Columns as lists of (n, letter) in order; ``related`` switches the relation of letters on."""
    return f"""g AS (SELECT cluster, pos, CASE WHEN letter IN ('-', '~') THEN '-' ELSE letter END AS l, CAST(sum(n) AS BIGINT) AS n FROM lc GROUP BY ALL),
        c AS (SELECT cluster, pos, list(n ORDER BY n DESC, l = '-', l) AS ns, list(l ORDER BY n DESC, l = '-', l) AS ls, coalesce(sum(n) FILTER (l <> '-'), 0) AS letters FROM g GROUP BY ALL),
        r AS (SELECT *, list_transform(ls, lambda x: len(list_filter(ls, lambda y: {related} AND x || y IN ('AG', 'GA', 'CT', 'TC')))) AS f FROM c),
        p AS (SELECT cluster, pos, CASE WHEN letters <= 1 THEN '-' WHEN len(ls) = 1 OR (ns[1] > ns[2] AND ls[1] <> '-') THEN ls[1] WHEN ls[1] = '-' AND (len(ls) = 2 OR ns[2] > ns[3]) THEN ls[2] ELSE ls[list_position(f, list_max(f))] END AS l FROM r)
        SELECT cluster, string_agg(l, '' ORDER BY pos) AS consensus FROM p GROUP BY 1"""


QUERIES = {
    "c01_edge_filter": (edge_filter, f"WITH {PAIRS_SQL} SELECT seq1, seq2 FROM pairs WHERE floor(sim + 0.5) >= 70 AND cov1 >= 60 AND cov2 >= 60"),
    "c01_edge_filter_truncated": (edge_filter_truncated, f"WITH {PAIRS_SQL} SELECT seq1, seq2 FROM pairs WHERE floor(sim + 0.6) >= 71 AND (cov1 >= 60 OR cov2 >= 60)"),
    "c02_reciprocal_best": (reciprocal_best, f"WITH {MATES_SQL} SELECT a.seq AS seq1, a.mate AS seq2 FROM best a JOIN best b ON a.seq = b.mate AND a.mate = b.seq WHERE a.seq < a.mate"),
    "c02_reciprocal_best_cut": (reciprocal_best_cut, f"WITH {MATES_SQL.replace('UNION ALL SELECT seq2, ds2, seq1, ds1, evalue, sim FROM pairs)', 'WHERE ' + CUT + ' UNION ALL SELECT seq2, ds2, seq1, ds1, evalue, sim FROM pairs WHERE ' + CUT + ')')} SELECT a.seq AS seq1, a.mate AS seq2 FROM best a JOIN best b ON a.seq = b.mate AND a.mate = b.seq WHERE a.seq < a.mate"),
    "c05_e02_components": (components, f"""WITH RECURSIVE {PAIRS_SQL}, e AS (SELECT seq1 AS a, seq2 AS b FROM pairs WHERE bits > 150 UNION SELECT seq2, seq1 FROM pairs WHERE bits > 150),
        r AS (SELECT a AS node, a AS to_ FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.to_) SELECT node, min(to_) AS component FROM r GROUP BY 1"""),
    "c03_mutual_sets": (mutual_sets, f"""WITH RECURSIVE {MATES_SQL}, e AS (SELECT a.seq AS a, a.mate AS b FROM best a JOIN best b ON a.seq = b.mate AND a.mate = b.seq),
        r AS (SELECT a AS node, a AS to_ FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.to_), c AS (SELECT node, min(to_) AS cluster FROM r GROUP BY 1),
        ok AS (SELECT cluster FROM c GROUP BY 1 HAVING count(*) = 3 AND (SELECT count(*) FROM e JOIN c d ON d.node = e.a WHERE d.cluster = c.cluster) = 6) SELECT cluster, node AS seq FROM c WHERE cluster IN (SELECT cluster FROM ok)"""),
    "c04_complete_linkage": (complete_linkage, None),
    "c05_cliques": (cliques, None),
    "c06_shared_hit": (shared_hit, f"""WITH {PAIRS_SQL}, m AS (SELECT p_brand || '/' || p_type || '/' || (p_size // 10) AS cluster, p_partkey AS seq FROM part),
        k AS (SELECT DISTINCT x.cluster, x.seq FROM m x JOIN m y ON x.cluster = y.cluster AND x.seq <> y.seq JOIN pairs ON seq1 = least(x.seq, y.seq) AND seq2 = greatest(x.seq, y.seq))
        SELECT cluster, seq FROM (SELECT *, count(*) OVER (PARTITION BY cluster) AS n FROM k) WHERE n > 1"""),
    "c09_p08_numbered": (numbered, f"""WITH {MEMBERS_SQL}, s AS (SELECT cluster, count(*) AS n, min(seq) AS s FROM members GROUP BY 1 HAVING count(*) > 1)
        SELECT printf('PP_%06d', row_number() OVER (ORDER BY n DESC, s)) AS name, cluster AS old FROM s"""),
    "c08_majority_description": (majority, f"""WITH {FLAGGED_SQL}, m AS (SELECT seq_id % 300 AS cluster, * FROM flagged),
        d AS (SELECT cluster, description, bool_or(good) AS good, count(DISTINCT seq_id) AS n, sum(CAST(best_anno AS INT)) AS a, min(evalue) AS e, max(CAST(dbtype = 'SP' AS INT)) AS sp FROM m GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY cluster ORDER BY good DESC, n + a DESC, e, sp DESC, description) AS r FROM d), z AS (SELECT cluster, count(DISTINCT seq_id) AS size FROM m GROUP BY 1)
        SELECT cluster, CASE WHEN n > 3 THEN description ELSE '*NoShare' END AS description, n AS n_sharing, CAST(floor(100 * n / size) AS INT) AS anno_percent FROM r JOIN z USING (cluster) WHERE r = 1"""),
    "a18_f20_taxa": (taxa, f"WITH {MEMBERS_SQL}, k AS (SELECT cluster, ds, count(*) AS n FROM members GROUP BY ALL) SELECT cluster, CAST(sum(n) AS BIGINT) AS n_seqs, count(*) || 'x' || CASE WHEN max(n) > 1 THEN 'N' ELSE '1' END AS taxa FROM k GROUP BY 1 HAVING sum(n) >= 4"),
    "f20_dataset_counts": (dataset_counts, f"WITH {MEMBERS_SQL} SELECT cluster, " + ", ".join(f"count(*) FILTER (ds = {i}) AS ds{i}" for i in range(4)) + " FROM members GROUP BY 1 HAVING ds0 >= 1 AND ds1 >= 1 AND ds3 <= 3"),
    "a17_correlation_summary": (correlation_summary, f"""WITH {PAIRS_SQL}, {R.COUNTS_SQL}, {MEMBERS_SQL}, p AS (SELECT x.cluster, seq1, seq2 FROM pairs JOIN members x ON x.seq = seq1 JOIN members y ON y.seq = seq2 AND x.cluster = y.cluster),
        j AS (SELECT p.*, CAST(a.n AS DOUBLE) AS x, CAST(b.n AS DOUBLE) AS y FROM p JOIN reps a ON a.seq_id = seq1 JOIN reps b ON b.seq_id = seq2 AND a.lib = b.lib AND a.rep = b.rep),
        s AS (SELECT cluster, seq1, seq2, count(*) AS n, sum(x) AS sx, sum(y) AS sy, sum(x * x) AS sxx, sum(y * y) AS syy, sum(x * y) AS sxy FROM j GROUP BY ALL),
        c AS (SELECT cluster, CASE WHEN n * sxx - sx * sx > 1e-12 AND n * syy - sy * sy > 1e-12 THEN (n * sxy - sx * sy) / sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)) ELSE 0 END AS pcc FROM s)
        SELECT cluster, CAST(floor(100 * avg(CASE WHEN pcc >= 0.1 THEN 1.0 WHEN pcc < 0.1 THEN 0 END)) AS INT) AS pcc_percent, round(min(pcc), 6) AS min_pcc FROM (SELECT DISTINCT cluster FROM members) LEFT JOIN c USING (cluster) GROUP BY 1"""),
    "a08_size_histogram": (size_histogram, f"""WITH {MEMBERS_SQL}, s AS (SELECT cluster, count(*) AS n FROM members GROUP BY 1) SELECT 'user' AS method, """ + ", ".join(f"count(*) FILTER (n {w}) AS size_{k}" for k, w in ((2, "= 2"), (3, "= 3"), (4, "= 4"), (5, "BETWEEN 5 AND 10"), (11, "BETWEEN 11 AND 15"), (16, "BETWEEN 16 AND 20"), (21, "BETWEEN 21 AND 25"), (26, "> 25"))) + """,
        count(*) AS n_clusters, CAST(sum(n) AS BIGINT) AS n_seqs, round(avg(n), 6) AS mean_size, round(stddev_pop(n), 6) AS sd_size FROM s"""),
    "a08_score_summary": (score_summary, """WITH c AS (SELECT right(p_brand, 1) AS method, p_size AS con_len, p_partkey % 9 AS sd_len, CASE WHEN p_size % 4 > 0 THEN p_size / 50 END AS score1, CAST(p_partkey % 11 AS DOUBLE) AS score2 FROM part)
        SELECT method, round(avg(con_len), 6) AS mean_con_len, round(avg(sd_len), 6) AS mean_sd_len, round(avg(score1), 6) AS mean_score1, round(stddev_pop(score1), 6) AS sd_score1, round(avg(score2), 6) AS mean_score2, round(stddev_pop(score2), 6) AS sd_score2 FROM c GROUP BY 1"""),
    "a20_menus": (menus, f"WITH {R.DETAIL_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS kind, {c} AS value, count(*) AS n FROM detail GROUP BY {c}" for c in ("dbtype", "taxonomy", "species"))),
    "m02_consensus": (consensus, f"WITH {ALIGNED_SQL}, {consensus_sql('true')}"),
    "m02_consensus_nt": (consensus_nt, f"WITH {ALIGNED_SQL}, {consensus_sql('false')}"),
    "m07_trim": (trim, f"""WITH RECURSIVE t AS (SELECT conv_id, turn, min(CASE WHEN conv_id % 3 = 0 THEN 'aa' ELSE '' END || repeat('-', CAST(conv_id % 17 AS BIGINT))
          || replace(regexp_replace(regexp_replace(lower(text), '[^a-z ]', '', 'g'), '[^aeiou ]', '-', 'g'), ' ', repeat('-', turn * 2)) || repeat('-', CAST(conv_id % 17 AS BIGINT)) || CASE WHEN conv_id % 4 = 0 THEN 'e' ELSE '' END) AS t FROM conversations GROUP BY ALL),
        way AS (SELECT conv_id, turn, 1 AS d, t AS s, len(t) AS size FROM t UNION ALL SELECT conv_id, turn, -1, reverse(t), len(t) FROM t),
        w AS (SELECT conv_id, turn, d, s, size, 0 AS i, 0 AS gaps, 0 AS chars, 0 AS skips, false AS ingap, CASE WHEN d = 1 THEN 0 ELSE size END AS cut, false AS done FROM way UNION ALL
          SELECT conv_id, turn, d, s, size, i + 1, CASE WHEN letter THEN CASE WHEN ingap THEN 0 ELSE gaps END ELSE gaps + 1 END, CASE WHEN letter THEN CASE WHEN ingap THEN 1 ELSE chars + 1 END ELSE chars END,
            CASE WHEN letter AND ingap AND gaps <= 10 THEN skips + 1 ELSE skips END, ingap OR NOT letter, CASE WHEN letter AND ingap AND gaps > 10 THEN CASE WHEN d = 1 THEN i ELSE size - 1 - i END ELSE cut END,
            letter AND CASE WHEN ingap THEN CASE WHEN gaps <= 10 THEN skips + 1 ELSE skips END > 3 ELSE chars + 1 > 4 END
          FROM (SELECT *, s[i + 1] <> '-' AS letter FROM w WHERE NOT done AND i < CASE WHEN d = 1 THEN size ELSE size - 1 END)),
        e AS (SELECT conv_id, turn, d, arg_max(cut, i) AS cut FROM w GROUP BY ALL)
        SELECT conv_id, turn, CAST(max(cut) FILTER (d = 1) AS INT) AS first, CAST(max(cut) FILTER (d = -1) AS INT) AS "end" FROM e GROUP BY ALL"""),
    "m03_m06_msa_scores": (msa_scores, f"""WITH {ALIGNED_SQL}, k AS (SELECT x.cluster, x.pos, x.letter AS a, y.letter AS b, CASE WHEN x.letter = '-' AND y.letter = '-' THEN 0 WHEN x.letter = '-' OR y.letter = '-' THEN -4 WHEN x.letter = y.letter THEN 4 ELSE -1 END AS s
          FROM chars x JOIN chars y ON x.cluster = y.cluster AND x.pos = y.pos AND x.member < y.member WHERE x.letter <> '~' AND y.letter <> '~'),
        z AS (SELECT cluster, count(DISTINCT member) AS m, count(DISTINCT pos) AS c FROM chars GROUP BY 1), s AS (SELECT cluster, sum(s) AS s FROM k GROUP BY 1),
        l AS (SELECT cluster, coalesce(stddev_samp(len(replace(t, '-', ''))), 0) AS sd FROM aligned GROUP BY 1)
        SELECT cluster, round(s / (m * (m - 1) / 2 * c), 6) AS sum_of_pairs, round(sd, 6) AS sd_len FROM z JOIN s USING (cluster) JOIN l USING (cluster) WHERE m > 1"""),
    "m04_entropy": (entropy, f"""WITH {ALIGNED_SQL}, ch AS (SELECT cluster, member, pos, CASE letter WHEN '~' THEN '-' ELSE letter END AS letter FROM chars), g AS (SELECT cluster, pos, letter, count(*) AS n FROM ch GROUP BY ALL), c AS (SELECT *, count(*) OVER (PARTITION BY cluster, pos) AS k FROM g),
        w AS (SELECT cluster, member, avg(1 / (n * k)) AS w FROM ch JOIN c USING (cluster, pos, letter) GROUP BY ALL), p AS (SELECT cluster, pos, letter, sum(w) AS p FROM ch JOIN w USING (cluster, member) GROUP BY ALL),
        h AS (SELECT cluster, pos, -sum(p * ln(p)) AS h FROM p GROUP BY ALL), z AS (SELECT cluster, ln(least(count(*), 21)) AS s FROM aligned GROUP BY 1)
        SELECT cluster, round(avg(1 - CASE WHEN s > 0 THEN h / s ELSE 0 END), 6) AS conservation FROM h JOIN z USING (cluster) GROUP BY 1"""),
    "e03_snps": (snps, """WITH b AS (SELECT l_partkey % 100 AS contig, l_linenumber AS pos, CASE WHEN l_quantity > 48 THEN 'T' WHEN l_quantity > 44 THEN 'G' ELSE 'A' END AS base, CAST(count(*) AS INT) AS n FROM lineitem GROUP BY ALL),
        r AS (SELECT *, sum(n) OVER w AS depth, row_number() OVER (PARTITION BY contig, pos ORDER BY n DESC, base) AS r FROM b WINDOW w AS (PARTITION BY contig, pos)),
        k AS (SELECT *, unnest(range(n, CAST(depth AS INT) + 1)) AS k FROM r WHERE r > 1 AND n >= 2),
        t AS (SELECT contig, pos, base, n, sum(exp(lgamma(depth + 1) - lgamma(k + 1) - lgamma(depth - k + 1) + k * ln(0.1 / 3) + (depth - k) * ln(1 - 0.1 / 3))) AS p FROM k GROUP BY ALL) SELECT contig, pos, base, n, round(p, 6) AS p FROM t WHERE p <= 0.01"""),
}
