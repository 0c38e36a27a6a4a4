"""Merged datasets and graphs, stored p-values, cross-references and tables with the details of hits."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import hits as H
from strandlake.operators import merge as M
from strandlake.operators import ontology as O
from strandlake.plans.filters import BestHitFilter, apply
from strandlake.plans.lineage import shared_folder
from strandlake.plans.results import Results
from strandlake.plans.tables import with_hits
from strandlake.plans.views import best_hit_table
from strandlake.queries import hits as HQ
from strandlake.queries import ontology as G
from strandlake.queries import roles as R
from strandlake.queries.ontology import ALL_SQL, LEVELS_SQL, PATHS_SQL
from strandlake.queries.roles import DETAIL_SQL, FLAGGED_SQL, TERMS_SQL


def datasets(spark, sf):
    """Orders as sequences of three datasets, by customer; their lines are hits of parts and counts of return flags."""
    orders = R.read(spark, sf, "orders").select((F.col("o_custkey") % 3).alias("d"), F.col("o_orderkey").alias("k"))
    lines = R.read(spark, sf, "lineitem").join(orders, F.col("l_orderkey") == F.col("k"))
    seq = F.format_string("o%08d", F.col("k")).alias("seq")
    hits = lines.select("d", seq, F.format_string("p%08d", "l_partkey").alias("hit"), "l_extendedprice").groupBy("d", "seq", "hit").agg(F.max("l_extendedprice").alias("bits"))
    counts = lines.select("d", seq, F.concat("l_returnflag", "l_linestatus").alias("lib"), "l_quantity").groupBy("d", "seq", "lib").agg(F.sum("l_quantity").cast("long").alias("n"))
    of = lambda t, d: t.where(F.col("d") == d).drop("d")
    return {f"ds{d}": {"sequences": of(orders.select("d", seq), d), "hits": of(hits, d), "counts": of(counts, d)} for d in (0, 1, 2)}


def merged_in_two_steps(spark, sf):
    """The first two datasets, then the third added to the numbers that these gave."""
    all_ = datasets(spark, sf)
    first = M.merged({k: all_[k] for k in ("ds0", "ds1")})
    return M.merged(all_, {k: first[k] for k in ("seq_keys", "hit_keys", "lib_keys")})


def merged_hits(spark, sf):
    return merged_in_two_steps(spark, sf)["hits"].select("seq_id", "hit_id", "bits")


def merged_counts(spark, sf):
    return merged_in_two_steps(spark, sf)["counts"].select("seq_id", "lib_id", "n")


KEYS_SQL = """o AS (SELECT o_custkey % 3 AS d, o_orderkey AS k FROM orders), l AS (SELECT d, k, l_partkey, l_returnflag || l_linestatus AS lib, l_extendedprice, l_quantity FROM lineitem JOIN o ON l_orderkey = k),
sk AS (SELECT k, row_number() OVER (ORDER BY d, k) AS seq_id FROM o),
hk AS (SELECT l_partkey, row_number() OVER (ORDER BY d, l_partkey) AS hit_id FROM (SELECT l_partkey, min(d) AS d FROM l GROUP BY 1)),
lk AS (SELECT lib, row_number() OVER (ORDER BY d, lib) AS lib_id FROM (SELECT lib, min(d) AS d FROM l GROUP BY 1))"""


def two_graphs(spark, sf):
    """One dataset lacks every third term's edges, the other has all, and other ones for even terms."""
    edges, terms = R.edges(spark, sf), R.terms(spark, sf)
    g = F.col("child")
    one = edges.where((g % 3 != 1) & (F.col("rel") < 3))
    two = edges.where((g % 2 == 1) & (F.col("rel") < 3)).unionByName(edges.where((g % 2 == 0) & (g > 2)).select("child", F.lit(1).alias("parent"), F.lit(2).alias("rel")))
    named = terms.withColumn("level", F.lit(0))
    return [named.where("gonum % 3 <> 2"), named.withColumn("name", F.upper("name"))], [one, two]


def merged_terms(spark, sf):
    terms, graphs = two_graphs(spark, sf)
    return M.merged_ontology(terms, graphs, G.roots(spark))[0].select("gonum", "name", "level")


def merged_paths(spark, sf):
    terms, graphs = two_graphs(spark, sf)
    return M.merged_ontology(terms, graphs, G.roots(spark))[2].select("child", "ancestor", "rel", "distance")


GRAPHS_SQL = TERMS_SQL.replace("edges AS (", "all_edges AS (") + """,
two AS (SELECT child, parent, rel FROM all_edges WHERE child % 2 = 1 AND rel < 3 UNION SELECT child, 1, 2 FROM all_edges WHERE child % 2 = 0 AND child > 2),
edges AS (SELECT child, parent, rel FROM all_edges WHERE child % 3 <> 1 AND rel < 3 UNION SELECT child, parent, rel FROM two WHERE child % 3 = 1 OR child NOT IN (SELECT child FROM all_edges WHERE rel < 3))"""


def stored(spark, sf):
    """Two columns of p-values, of which the second is replaced after terms were tested with it."""
    store = Results(spark, shared_folder(spark, "results"))
    orders = R.read(spark, sf, "orders")
    one = orders.select(F.col("o_orderkey").alias("seq_id"), ((F.col("o_custkey") % 100) / 200 - 0.15).alias("p"))
    two = orders.select(F.col("o_orderkey").alias("seq_id"), ((F.col("o_orderkey") % 50) / 250 - 0.1).alias("p"))
    g = F.col("gonum")
    tested = R.terms(spark, sf).select("gonum", F.when(g % 13 == 0, float("nan")).otherwise((g % 97) / 97).alias("p"))
    store.save("one", one, "A : N", "exact")
    store.save_terms("one", tested, 0.1, "weighted")
    store.save("two", one, "A : R", "exact")
    store.save_terms("two", tested, 0.01, "weighted")
    store.save("two", two, "A : R", "exact")
    return store


def recounted_terms(spark, sf):
    store = stored(spark, sf)
    return O.recounted_hits(G.hit_rows(spark, sf), G.direct(spark, sf), G.closure(spark, sf), store.sequence_values(), store.cutoffs(["one", "two"]), "any", "up", least=3)


def recounted_all(spark, sf):
    store = stored(spark, sf)
    return O.recounted_hits(G.hit_rows(spark, sf), G.direct(spark, sf), G.closure(spark, sf), store.sequence_values(), store.cutoffs(["one", "two"]), "all")


def terms_with_values(spark, sf):
    return stored(spark, sf).with_term_values(G.terms_per_group(spark, sf), ["one", "two"]).select("gonum", "n_groups", F.round("one", 6).alias("one"), "two")


DE_SQL = "de AS (SELECT o_orderkey AS seq_id, (o_custkey % 100) / 200 - 0.15 AS a, (o_orderkey % 50) / 250 - 0.1 AS b FROM orders)"


def entries(spark, sf):
    part = R.read(spark, sf, "part").where("p_partkey % 3 <> 0")
    some = lambda n, c: F.when(F.col("p_size") % n == 0, c).otherwise("")
    key = F.col("p_partkey").cast("string")
    return part.select(F.col("p_partkey").alias("hit_id"), F.concat(F.lit("GO:"), key).alias("go_list"), some(2, F.col("p_type")).alias("interpro"), some(3, F.concat(F.lit("K"), key)).alias("kegg"), some(4, F.col("p_brand")).alias("pfam"), some(5, F.concat_ws(".", F.col("p_size").cast("string"), key)).alias("ec"))


def annotated_hits(spark, sf):
    hits = R.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("hit_id"), F.lit("old").alias("kegg"))
    return O.annotated(hits, entries(spark, sf))


def annotation_counts(spark, sf):
    return O.annotation_counts(annotated_hits(spark, sf))


def details(spark, sf):
    rows = R.details(spark, sf).withColumnRenamed("p_partkey", "hit_id")
    return rows.join(entries(spark, sf).select("hit_id", "kegg"), "hit_id", "left")


def sequence_hits(spark, sf):
    """Orders with the best hit of each and the clusters that it is a member of: by customer, and for some by status."""
    orders = R.read(spark, sf, "orders").select(F.col("o_orderkey").alias("seq_id"), "o_custkey", "o_orderstatus")
    best = R.flagged(spark, sf).where("best_bits").select("seq_id", F.col("l_partkey").alias("hit_id"), "bits", "evalue")
    members = orders.select("seq_id", F.lit("CU").alias("method"), F.concat(F.lit("CU_"), (F.col("o_custkey") % 40).cast("string")).alias("cluster"))
    members = members.unionByName(orders.where("o_orderstatus = 'F'").select("seq_id", F.lit("ST"), F.concat(F.lit("ST_"), F.col("o_orderstatus"))).toDF("seq_id", "method", "cluster"))
    view = with_hits(orders.join(best, "seq_id", "left"), details(spark, sf), "sequence", more={"member": (members, ["seq_id"])})
    return view.select(["seq_id", "bits", "evalue", "hit_description", "hit_species", "hit_kegg", "method", "cluster"])


def order_details(spark, sf):
    return R.read(spark, sf, "orders").select(F.col("o_orderkey").alias("hit_id"), F.col("o_orderpriority").alias("description"), F.col("o_orderstatus").alias("dbtype"))


def pair_hits(spark, sf):
    view = with_hits(H.with_shared_hit(R.pairs(spark, sf), HQ.hits_of_parts(spark, sf)), order_details(spark, sf), "pair")
    return view.select(["seq1", "seq2", "hit_id", "sim", "hit_description", "hit_dbtype"])


def cluster_hits(spark, sf):
    """The best hit of any member of a cluster, with its details."""
    rows = R.flagged(spark, sf).select((F.col("seq_id") % 300).alias("cluster"), F.col("l_partkey").alias("hit_id"), "evalue", "bits")
    best = rows.groupBy("cluster").agg(F.min(F.struct("evalue", (-F.col("bits")).alias("b"), "hit_id")).alias("_b"), F.count(F.lit(1)).alias("n_hits")).select("cluster", "n_hits", "_b.hit_id", "_b.evalue")
    return with_hits(best, details(spark, sf), "cluster").select(["cluster", "n_hits", "hit_id", "evalue", "hit_description", "hit_kegg"])


def best_hit_filters(spark, sf):
    """Five filters of sequences by their best hits, each row marked with the filter that keeps it."""
    rows = R.flagged(spark, sf).withColumns({"hit_cov": F.col("hit_id") % 100, "seq_cov": (F.col("hit_id") * 7) % 100})
    ids = rows.where("l_partkey % 4 = 0").select("hit_id").distinct()
    columns = ["seq_id", "hit_id", "bits", "evalue", "sim", "hit_cov", "seq_cov", "taxonomy", "dbtype"]
    none = rows.select("hit_id").limit(0)
    tables = {k: best_hit_table(d.select(*columns, F.lit(True).alias("_f")), none, "_f", k).drop(f"{k}__f") for k, d in (("bits", rows.where("best_bits")), ("anno", rows.where("best_anno")), ("go", O.best_go_hit(rows, ids)))}
    all_ = R.read(spark, sf, "orders").select(F.col("o_orderkey").alias("seq_id")).join(rows.groupBy("seq_id").agg(F.countDistinct("db").alias("n_databases")), "seq_id", "left")
    for t in tables.values():
        all_ = all_.join(t, "seq_id", "left")
    specs = {
        "anno": BestHitFilter("anno", [("evalue", "<=", 0.05), ("sim", ">=", 20), ("hit_cov", ">=", 30)], databases=(">=", 3)),
        "either": BestHitFilter("bits", [("bits", ">=", 850), ("seq_cov", "<=", 10)], taxonomy="economy", dbtype="SP", how="or", databases=("<=", 4)),
        "go": BestHitFilter("go", [("bits", ">=", 300)], differ="go_both"), "differ": BestHitFilter("bits", [("evalue", "<=", 0.04)], differ="bits_anno"), "bare": BestHitFilter(annotated=False),
    }
    marks = [F.when(spec.column(), F.lit(name)) for name, spec in specs.items()]
    return all_.select("seq_id", F.explode(F.array_compact(F.array(*marks))).alias("filter"))


FILTER_SQL = f"""WITH {FLAGGED_SQL}, f AS MATERIALIZED (SELECT *, hit_id % 100 AS hit_cov, hit_id * 7 % 100 AS seq_cov FROM flagged),
g AS (SELECT *, row_number() OVER (PARTITION BY seq_id ORDER BY bits DESC, CAST(best_bits AS INT) + CAST(best_anno AS INT) DESC, evalue, hit_id) AS n FROM f WHERE l_partkey % 4 = 0),
t AS MATERIALIZED (SELECT o_orderkey AS seq_id, n_databases, b.hit_id AS b, a.hit_id AS a, g.hit_id AS g, b.bits AS b_bits, b.evalue AS b_evalue, b.seq_cov AS b_seq_cov, b.taxonomy AS b_taxonomy, b.dbtype AS b_dbtype, a.evalue AS a_evalue, a.sim AS a_sim, a.hit_cov AS a_hit_cov, g.bits AS g_bits
  FROM orders LEFT JOIN (SELECT seq_id, count(DISTINCT db) AS n_databases FROM f GROUP BY 1) d ON d.seq_id = o_orderkey LEFT JOIN f b ON b.seq_id = o_orderkey AND b.best_bits LEFT JOIN f a ON a.seq_id = o_orderkey AND a.best_anno LEFT JOIN g ON g.seq_id = o_orderkey AND g.n = 1)
SELECT seq_id, 'anno' AS filter FROM t WHERE b IS NOT NULL AND a_evalue <= 0.05 AND a_sim >= 20 AND a_hit_cov >= 30 AND n_databases >= 3
UNION ALL SELECT seq_id, 'either' FROM t WHERE b IS NOT NULL AND (b_bits >= 850 OR b_seq_cov <= 10 OR (b_taxonomy = 'economy' AND b_dbtype = 'SP')) AND n_databases <= 4
UNION ALL SELECT seq_id, 'go' FROM t WHERE b IS NOT NULL AND g_bits >= 300 AND g <> b AND g <> a UNION ALL SELECT seq_id, 'differ' FROM t WHERE b_evalue <= 0.04 AND a <> b UNION ALL SELECT seq_id, 'bare' FROM t WHERE b IS NULL"""

ENTRY_SQL = "e AS (SELECT p_partkey AS hit_id, 'GO:' || p_partkey AS go_list, CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS interpro, CASE WHEN p_size % 3 = 0 THEN 'K' || p_partkey ELSE '' END AS kegg, CASE WHEN p_size % 4 = 0 THEN p_brand ELSE '' END AS pfam, CASE WHEN p_size % 5 = 0 THEN p_size || '.' || p_partkey ELSE '' END AS ec FROM part WHERE p_partkey % 3 <> 0)"
ANNOTATED_SQL = f"{ENTRY_SQL}, a AS (SELECT h.hit_id, " + ", ".join(f"coalesce({c}, '') AS {c}" for c in O.CROSS_REFERENCES) + " FROM (SELECT DISTINCT l_partkey AS hit_id FROM lineitem) h LEFT JOIN e USING (hit_id))"

QUERIES = {
    "j15_merged_hits": (merged_hits, f"WITH {KEYS_SQL} SELECT seq_id, hit_id, max(l_extendedprice) AS bits FROM l JOIN sk USING (k) JOIN hk USING (l_partkey) GROUP BY ALL"),
    "j15_merged_counts": (merged_counts, f"WITH {KEYS_SQL} SELECT seq_id, lib_id, CAST(sum(l_quantity) AS BIGINT) AS n FROM l JOIN sk USING (k) JOIN lk USING (lib) GROUP BY ALL"),
    "g12_merged_terms": (merged_terms, f"WITH RECURSIVE {GRAPHS_SQL}, {LEVELS_SQL} SELECT gonum, CASE WHEN gonum % 3 <> 2 THEN name ELSE upper(name) END AS name, CAST(level AS INT) AS level FROM terms LEFT JOIN levels USING (gonum)"),
    "g12_merged_paths": (merged_paths, f"WITH RECURSIVE {GRAPHS_SQL}, {PATHS_SQL} SELECT child, ancestor, rel, distance FROM paths"),
    "d08_f16_recounted_terms": (recounted_terms, f"{ALL_SQL}, {DE_SQL} SELECT gonum, count(*) AS n_seqs FROM st JOIN de USING (seq_id) WHERE (a > 0 AND a < 0.1) OR (b > 0 AND b < 0.05) GROUP BY 1 HAVING count(*) >= 3"),
    "f16_recounted_all": (recounted_all, f"{ALL_SQL}, {DE_SQL} SELECT gonum, count(*) AS n_seqs FROM st JOIN de USING (seq_id) WHERE abs(a) < 0.1 AND abs(b) < 0.05 GROUP BY 1"),
    "d08_x08_terms_with_values": (terms_with_values, f"SELECT gonum, n_groups, CASE WHEN gonum % 13 <> 0 THEN round((gonum % 97) / 97, 6) END AS one, CAST(NULL AS DOUBLE) AS two FROM ({G.QUERIES['x11_x08_terms_per_group'][1]})"),
    "j12_annotated_hits": (annotated_hits, f"WITH {ANNOTATED_SQL} SELECT * FROM a"),
    "j12_annotation_counts": (annotation_counts, f"WITH {ANNOTATED_SQL} " + " UNION ALL ".join(f"SELECT '{c}' AS kind, count(*) FILTER ({c} <> '') AS n_hits FROM a" for c in O.CROSS_REFERENCES)),
    "j04_sequence_hits": (sequence_hits, f"""WITH {FLAGGED_SQL}, {ENTRY_SQL}, m AS (SELECT o_orderkey AS seq_id, 'CU' AS method, 'CU_' || o_custkey % 40 AS cluster FROM orders UNION ALL SELECT o_orderkey, 'ST', 'ST_F' FROM orders WHERE o_orderstatus = 'F'),
        b AS (SELECT * FROM flagged WHERE best_bits) SELECT o_orderkey AS seq_id, bits, evalue, description AS hit_description, species AS hit_species, kegg AS hit_kegg, method, cluster
        FROM orders LEFT JOIN b ON b.seq_id = o_orderkey LEFT JOIN e ON e.hit_id = b.l_partkey LEFT JOIN m ON m.seq_id = o_orderkey"""),
    "j05_pair_hits": (pair_hits, f"WITH {R.PAIRS_SQL} SELECT p.seq1, p.seq2, h.hit_id, sim, o_orderpriority AS hit_description, o_orderstatus AS hit_dbtype FROM pairs p LEFT JOIN ({HQ.QUERIES['j06_shared_hit'][1]}) h USING (seq1, seq2) LEFT JOIN orders ON o_orderkey = h.hit_id"),
    "j05_cluster_hits": (cluster_hits, f"""WITH {FLAGGED_SQL}, {ENTRY_SQL}, r AS (SELECT seq_id % 300 AS cluster, l_partkey AS hit_id, evalue, row_number() OVER (PARTITION BY seq_id % 300 ORDER BY evalue, bits DESC, l_partkey) AS n, count(*) OVER (PARTITION BY seq_id % 300) AS n_hits FROM flagged)
        SELECT cluster, n_hits, r.hit_id, evalue, d.description AS hit_description, kegg AS hit_kegg FROM r LEFT JOIN detail d ON d.p_partkey = r.hit_id LEFT JOIN e ON e.hit_id = r.hit_id WHERE n = 1"""),
    "f06_best_hit_filters": (best_hit_filters, FILTER_SQL),
}
