"""Exports, reports and drill-downs, and a user's own methods."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from strandlake.operators import hits as H
from strandlake.operators import ontology as O
from strandlake.plans.extensions import Registry
from strandlake.plans.filters import Directed, TermFilter, apply
from strandlake.plans.views import snps_of, terms_of
from strandlake.queries import ontology as G
from strandlake.queries import roles as R
from strandlake.queries.ontology import ALL_SQL, DIRECT_SQL, GRAPH, START
from strandlake.queries.roles import COUNTS_SQL, HITS_SQL, rounded
from strandlake.sources import exports as X


def hit_terms(spark, sf):
    return O.terms_of_hits(G.inherited(spark, sf), G.leveled(spark, sf), inherited=True)


def term_holders(spark, sf):
    return O.holders(G.sequence_terms(spark, sf, G.start(spark, sf)), G.start(spark, sf))


def term_hits(spark, sf):
    return G.direct(spark, sf).join(G.start(spark, sf), "gonum").select("gonum", "hit_id")


def terms_of_sequence(spark, sf):
    return terms_of(G.sequence_terms(spark, sf), G.leveled(spark, sf), 7, inherited=True)


def term_filter(spark, sf):
    terms = G.leveled(spark, sf)
    rows = G.term_info(spark, sf, apply(terms, TermFilter(domain="BP", level=(2, 7)))).join(terms, "gonum").withColumn("p_up", (F.col("gonum") % 10) / 100 - 0.05)
    spec = TermFilter(evalue=0.0, least_seqs=500, domain="BP", level=(2, 7), enriched=Directed(["p_up"], 0.04, "either"))
    return apply(rows, spec).select("gonum", "n_seqs", "level")


def best_hit_terms(spark, sf):
    best = G.hit_rows(spark, sf).groupBy("seq_id").agg(F.max_by("hit_id", F.struct("bits", -F.col("evalue"), -F.col("hit_id"))).alias("hit_id"))
    return X.best_hit_terms(best, G.direct(spark, sf), R.terms(spark, sf)).select("seq_id", "hit_id", "gonum", "domain", "ec")


def cluster_levels(spark, sf):
    members = R.read(spark, sf, "part").select(F.concat_ws("/", "p_brand", "p_type").alias("cluster"), F.col("p_partkey").alias("seq"))
    return X.cluster_levels(members, R.counts(spark, sf).where("rep = 0"), ["A", "N", "R"])


def merged_counts(spark, sf):
    of = lambda c: R.read(spark, sf, "part").where(c).groupBy(F.col("p_type").alias("domain"), F.col("p_name").alias("name")).agg(F.count(F.lit(1)).alias("n_seqs"))
    return X.merged_counts({"small": of("p_size < 10"), "middle": of("p_size between 10 and 30")}, least_ratio=2)


def sequence_terms_in(spark, sf):
    de = R.read(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("seq_id"))
    rows = X.sequence_terms_in(G.chosen(spark, sf), G.sequence_terms(spark, sf, G.chosen(spark, sf)), de)
    return rows.select("seq_id", F.array_join(F.transform("terms", lambda x: x.cast("string")), ",").alias("terms"))


def overview(spark, sf):
    seqs = R.read(spark, sf, "orders").select(F.col("o_orderkey").alias("seq_id"), F.floor("o_totalprice").alias("len"))
    return X.overview(seqs, R.hits(spark, sf), G.sequence_terms(spark, sf))


def log_p(spark, sf):
    rows = R.read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_tax") == 0.03, None).otherwise(F.col("l_discount")).alias("p"))
    return rounded(X.with_log_p(rows, ["p"]), "p")


def missing_numbers(spark, sf):
    rows = X.flagged_missing(R.read(spark, sf, "lineitem").select("l_returnflag", "l_discount", "l_tax"), {"l_discount": 0.0, "l_tax": 0.05})
    return rounded(rows.groupBy("l_returnflag").agg(F.count("l_discount").alias("n_discount"), F.avg("l_discount").alias("mean_discount"), F.count("l_tax").alias("n_tax")), "mean_discount")


def overlapping_hits(spark, sf):
    return H.overlapping(R.hits(spark, sf))


def snp_view(spark, sf):
    rows = R.read(spark, sf, "lineitem").select((F.col("l_orderkey") % 9).alias("contig"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_returnflag") == "A", "mismatch").otherwise("gap").alias("kind"), F.concat(F.lit("A="), F.col("l_quantity").cast("int").cast("string"), F.lit(" C=2")).alias("bases"))
    return snps_of(rows, 4).groupBy("pos").agg(F.sum(F.col("bases")["A"]).alias("a"), F.sum(F.col("bases")["C"]).alias("c"))


def own_method(spark, sf):
    """A user's method on the matrix of each contrast: the share of a contrast's total that each sequence has."""
    own = Registry()
    own.add("share", lambda g: pd.DataFrame({"seq_id": g["seq_id"], "contrast": g["contrast"], "p": (g["n"] / g["n"].sum()).round(9)}), "seq_id long, contrast string, p double")
    return own.run("share", R.reps(spark, sf).groupBy("seq_id", F.col("lib").alias("contrast")).agg(F.sum("n").alias("n")), "contrast")


LEVEL_JOIN = "JOIN terms USING (gonum) JOIN levels USING (gonum)"

QUERIES = {
    "g10a_g10b_hit_terms": (hit_terms, f"{GRAPH}, {DIRECT_SQL} SELECT hit_id, gonum, domain, level, ec FROM inherited {LEVEL_JOIN}"),
    "g10h_term_holders": (term_holders, f"{ALL_SQL}, {START}, r AS (SELECT start, seq_id, evalue, row_number() OVER (PARTITION BY start ORDER BY evalue, seq_id) AS place FROM st JOIN start ON gonum = start) SELECT * FROM r"),
    "g10f_term_hits": (term_hits, f"{GRAPH}, {DIRECT_SQL}, {START} SELECT gonum, hit_id FROM direct JOIN start ON gonum = start"),
    "v03_terms_of_sequence": (terms_of_sequence, f"{ALL_SQL} SELECT gonum, name, domain, level, hit_id, is_direct FROM st {LEVEL_JOIN} WHERE seq_id = 7"),
    "f15_term_filter": (term_filter, f"""{ALL_SQL}, i AS (SELECT gonum, min(evalue) AS e, count(*) AS n_seqs FROM st GROUP BY 1) SELECT gonum, n_seqs, level FROM i {LEVEL_JOIN}
        WHERE e <= 0 AND n_seqs >= 500 AND domain = 'BP' AND level BETWEEN 2 AND 7 AND abs((gonum % 10) / 100 - 0.05) < 0.04"""),
    "x07_best_hit_terms": (best_hit_terms, f"""{GRAPH}, {DIRECT_SQL}, {G.HITS_SQL}, b AS (SELECT seq_id, first(hit_id ORDER BY bits DESC, evalue, hit_id) AS hit_id FROM h GROUP BY 1)
        SELECT seq_id, hit_id, gonum, domain, ec FROM b JOIN direct USING (hit_id) JOIN terms USING (gonum)"""),
    "x10_cluster_levels": (cluster_levels, f"WITH {COUNTS_SQL} SELECT p_brand || '/' || p_type AS cluster, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (lib = '{x}'), 0) AS BIGINT) AS {x}" for x in "ANR") + " FROM part JOIN counts ON seq_id = p_partkey WHERE rep = 0 GROUP BY 1"),
    "x12_merged_counts": (merged_counts, """WITH m AS (SELECT p_type AS domain, p_name AS name, count(*) FILTER (p_size < 10) AS small, count(*) FILTER (p_size BETWEEN 10 AND 30) AS middle FROM part WHERE p_size <= 30 GROUP BY ALL)
        SELECT * FROM m WHERE greatest(small, middle) >= 2 * greatest(least(small, middle), 1)"""),
    "x13_sequence_terms_in": (sequence_terms_in, f"{ALL_SQL}, {G.CHOSEN} SELECT seq_id, array_to_string(list_sort(list(DISTINCT gonum)), ',') AS terms FROM st JOIN orders ON o_orderkey = seq_id AND o_orderstatus = 'F' WHERE gonum IN (SELECT gonum FROM chosen) GROUP BY 1"),
    "x14_overview": (overview, f"""{ALL_SQL} SELECT 'sequences' AS measure, CAST(count(*) AS DOUBLE) AS value FROM orders UNION ALL SELECT 'mean length', round(avg(floor(o_totalprice)), 2) FROM orders UNION ALL SELECT 'longest', max(floor(o_totalprice)) FROM orders
        UNION ALL SELECT 'sequences with hits', count(DISTINCT l_orderkey) FROM lineitem UNION ALL SELECT 'hits', count(*) FROM lineitem UNION ALL SELECT 'databases', count(DISTINCT l_suppkey % 5) FROM lineitem
        UNION ALL SELECT 'sequences with terms', count(DISTINCT seq_id) FROM st UNION ALL SELECT 'terms', count(DISTINCT gonum) FROM st"""),
    "x12_log_p": (log_p, "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax <> 0.03 THEN round(least(-log10(greatest(l_discount, 1e-300)), 300), 6) END AS p FROM lineitem"),
    "p06_missing_numbers": (missing_numbers, "SELECT l_returnflag, count(*) FILTER (l_discount <> 0) AS n_discount, round(avg(l_discount) FILTER (l_discount <> 0), 6) AS mean_discount, count(*) FILTER (l_tax <> 0.05) AS n_tax FROM lineitem GROUP BY 1"),
    "j10_overlapping_hits": (overlapping_hits, f"WITH {HITS_SQL} SELECT a.seq_id, a.hit_id AS hit1, b.hit_id AS hit2 FROM hits a JOIN hits b ON a.seq_id = b.seq_id AND a.hit_id < b.hit_id WHERE a.seq_start < b.seq_end AND b.seq_start < a.seq_end"),
    "v05_snp_view": (snp_view, "SELECT l_linenumber AS pos, CAST(sum(CAST(l_quantity AS INT)) AS BIGINT) AS a, CAST(count(*) * 2 AS BIGINT) AS c FROM lineitem WHERE l_orderkey % 9 = 4 AND l_returnflag = 'A' GROUP BY 1"),
    "u01_own_method": (own_method, f"WITH {COUNTS_SQL} SELECT seq_id, lib AS contrast, round(n / sum(n) OVER (PARTITION BY lib), 9) AS p FROM counts WHERE rep = 0"),
}
