"""The term graph and what sequences inherit through it."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.operators import ontology as O
from strandlake.queries import roles as R
from strandlake.queries.roles import TERMS_SQL

LEVELS_SQL = """walk AS (SELECT 1 AS gonum, 1 AS level UNION SELECT e.child, w.level + 1 FROM walk w JOIN edges e ON e.parent = w.gonum AND e.rel <> 3), levels AS (SELECT gonum, max(level) AS level FROM walk GROUP BY 1)"""
PATHS_SQL = """steps AS (SELECT child, parent, min(rel) AS rel FROM edges WHERE rel <> 3 GROUP BY ALL),
ways AS (SELECT child, parent AS ancestor, rel, 1 AS d FROM steps UNION SELECT w.child, s.parent, least(w.rel, s.rel), d + 1 FROM ways w JOIN steps s ON s.child = w.ancestor),
near AS (SELECT child, ancestor, min(d) AS d FROM ways GROUP BY ALL),
paths AS (SELECT child, ancestor, min(rel) AS rel, d AS distance FROM ways w JOIN near n USING (child, ancestor, d) GROUP BY ALL)"""
GRAPH = f"WITH RECURSIVE {TERMS_SQL}, {LEVELS_SQL}, {PATHS_SQL}"
#: Entries are parts; most have their own term, some one of the first 200 too, with an evidence code.
DIRECT_SQL = """codes AS (SELECT * FROM (VALUES (0, 'IDA'), (1, 'IEA'), (2, 'IBA'), (3, 'TAS')) v(k, ec)),
direct AS (SELECT DISTINCT CAST(p_partkey AS BIGINT) AS hit_id, CAST(p_partkey AS INT) + 1 AS gonum, ec FROM part JOIN codes ON k = p_size % 4 WHERE p_partkey % 3 <> 0
  UNION SELECT p_partkey, CAST(p_partkey * 11 % 200 AS INT) + 1, ec FROM part JOIN codes ON k = (p_size + 1) % 4 WHERE p_partkey % 5 = 0),
own AS (SELECT hit_id, gonum, min(ec) AS ec FROM direct GROUP BY ALL),
inherited AS (SELECT hit_id, gonum, ec, true AS is_direct FROM own UNION ALL
  SELECT hit_id, ancestor, '(' || min(ec) || ')', false FROM direct JOIN paths ON child = gonum WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.hit_id = direct.hit_id AND o.gonum = ancestor) GROUP BY hit_id, ancestor)"""
HITS_SQL = "h AS (SELECT l_orderkey AS seq_id, l_partkey AS hit_id, max(floor(l_extendedprice / 100)) AS bits, min(l_discount) AS evalue FROM lineitem GROUP BY ALL)"
SEQ_SQL = """st AS (SELECT seq_id, gonum, arg_min(hit_id, {'a': -bits, 'b': evalue, 'c': h.hit_id}) AS hit_id, arg_min(evalue, {'a': -bits, 'b': evalue, 'c': h.hit_id}) AS evalue, bool_or(is_direct) AS is_direct
  FROM h JOIN inherited USING (hit_id) GROUP BY ALL)"""
ALL_SQL = f"{GRAPH}, {DIRECT_SQL}, {HITS_SQL}, {SEQ_SQL}"


def direct(spark, sf):
    ec = lambda k: F.element_at(F.array(*map(F.lit, ("IDA", "IEA", "IBA", "TAS"))), (k % 4 + 1).cast("int"))
    rows = R.read(spark, sf, "part")
    key = F.col("p_partkey")
    two = F.array(F.when(key % 3 != 0, F.struct((key.cast("int") + 1).alias("gonum"), ec(F.col("p_size")).alias("ec"))), F.when(key % 5 == 0, F.struct((((key * 11) % 200).cast("int") + 1).alias("gonum"), ec(F.col("p_size") + 1).alias("ec"))))
    return O.direct_terms(rows.select(key.alias("hit_id"), F.array_compact(two).alias("go")))


def hit_rows(spark, sf):
    return R.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("seq_id"), F.col("l_partkey").alias("hit_id")).agg(F.max(F.floor(F.col("l_extendedprice") / 100)).cast("double").alias("bits"), F.min("l_discount").alias("evalue"))


def roots(spark):
    return spark.createDataFrame([(1,)], "gonum int")


def levels(spark, sf):
    return O.levels(R.edges(spark, sf), roots(spark))


def leveled(spark, sf):
    return R.terms(spark, sf).join(levels(spark, sf), "gonum")


def closure(spark, sf):
    return O.closure(R.edges(spark, sf))


def inherited(spark, sf):
    return O.inherited_terms(direct(spark, sf), closure(spark, sf))


def sequence_terms(spark, sf, only=None):
    return O.sequence_terms(hit_rows(spark, sf), direct(spark, sf), closure(spark, sf), only=only)


def term_info(spark, sf, only=None):
    return O.term_info(sequence_terms(spark, sf, only))


def evidence(spark, sf):
    rows = O.evidence_columns(inherited(spark, sf))
    return rows.select("gonum", "experimental", "phylogenetic", "author", "electronic")


def terms_per_group(spark, sf):
    members = R.read(spark, sf, "orders").select(F.col("o_custkey").alias("group"), F.col("o_orderkey").alias("seq_id"))
    terms = leveled(spark, sf)
    rows = sequence_terms(spark, sf, terms.where("domain = 'BP' AND level BETWEEN 2 AND 6"))
    return O.terms_per_group(members, rows, terms, domain="BP", level=(2, 6), evalue=0.05, above=10)


def start(spark, sf):
    return R.terms(spark, sf).where("gonum % 20 = 0").select("gonum")


def ancestors(spark, sf):
    return O.ancestors(closure(spark, sf), leveled(spark, sf), start(spark, sf))


def descendants(spark, sf):
    return O.descendants(closure(spark, sf), leveled(spark, sf), R.edges(spark, sf), start(spark, sf))


def neighbours(spark, sf):
    return O.neighbours(R.edges(spark, sf), start(spark, sf))


def inheriting_hits(spark, sf):
    return O.inheriting_hits(direct(spark, sf), closure(spark, sf), leveled(spark, sf), start(spark, sf))


def root_paths(spark, sf):
    rows = O.root_paths(R.edges(spark, sf), start(spark, sf))
    return rows.select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def longest_paths(spark, sf):
    rows = O.longest_root_paths(R.edges(spark, sf), start(spark, sf))
    return rows.select("start", F.array_join(F.transform("path", lambda x: x.cast("string")), ">").alias("path"))


def chosen(spark, sf):
    return R.terms(spark, sf).where("gonum % 7 = 0 OR gonum < 12")


def terminal(spark, sf):
    return O.terminal_terms(chosen(spark, sf), closure(spark, sf)).select("gonum", "domain")


def related(spark, sf):
    return O.related_in_table(chosen(spark, sf), closure(spark, sf), start(spark, sf)).select("gonum")


def marked(spark, sf):
    return O.marked_ancestors(chosen(spark, sf), closure(spark, sf))


def used(spark, sf):
    return O.used_only(closure(spark, sf), chosen(spark, sf)).select("child", "ancestor", "distance")


def merged(spark, sf):
    t = R.terms(spark, sf)
    return O.merged_graph([t.where("gonum % 3 = 0").withColumn("name", F.lit("first")), t.where("gonum % 2 = 0"), t.withColumn("domain", F.lit("XX"))])


def slim(spark, sf):
    return O.slim(R.terms(spark, sf), start(spark, sf)).select("gonum", "is_slim")


CHOSEN = "chosen AS (SELECT * FROM terms WHERE gonum % 7 = 0 OR gonum < 12)"
START = "start AS (SELECT gonum AS start FROM terms WHERE gonum % 20 = 0)"
WALK_UP = """up AS (SELECT start, [start] AS path FROM start UNION ALL SELECT up.start, list_prepend(s.parent, path) FROM up JOIN steps s ON s.child = path[1])"""
EVIDENCE = lambda name: f"""array_to_string(list_concat(coalesce(list_sort(list(DISTINCT ec) FILTER (own AND ec IN {O.EVIDENCE[name] if len(O.EVIDENCE[name]) > 1 else "('" + O.EVIDENCE[name][0] + "')"})), []),
  list_transform(list_filter(coalesce(list_sort(list(DISTINCT ec) FILTER (NOT own AND ec IN {O.EVIDENCE[name]})), []), lambda x: NOT list_contains(coalesce(list(DISTINCT ec) FILTER (own), []), x)), lambda x: '(' || x || ')')), ',') AS {name}"""  # noqa: E731

QUERIES = {
    "g01_levels": (levels, f"WITH RECURSIVE {TERMS_SQL}, {LEVELS_SQL} SELECT * FROM levels"),
    "g02_closure": (closure, f"{GRAPH} SELECT child, ancestor, rel, distance FROM paths"),
    "g03_g04_inherited_terms": (inherited, f"{GRAPH}, {DIRECT_SQL} SELECT * FROM inherited"),
    "w06_g05_sequence_terms": (sequence_terms, f"{ALL_SQL} SELECT * FROM st"),
    "a06_term_info": (term_info, f"{ALL_SQL} SELECT gonum, min(evalue) AS best_evalue, count(*) AS n_seqs, CAST(sum(CAST(is_direct AS INT)) AS BIGINT) AS n_direct FROM st GROUP BY 1"),
    "a07_evidence": (evidence, f"{GRAPH}, {DIRECT_SQL}, e AS (SELECT gonum, regexp_replace(ec, '[()]', '', 'g') AS ec, is_direct AS own FROM inherited) SELECT gonum, " + ", ".join(map(EVIDENCE, ("experimental", "phylogenetic", "author", "electronic"))) + " FROM e GROUP BY 1"),
    "x11_x08_terms_per_group": (terms_per_group, f"""{ALL_SQL}, g AS (SELECT gonum, count(DISTINCT o_custkey) AS n_groups FROM st JOIN orders ON o_orderkey = seq_id WHERE evalue <= 0.05 GROUP BY 1 HAVING count(DISTINCT o_custkey) > 10)
        SELECT gonum, name, domain, level, n_groups FROM g JOIN terms USING (gonum) JOIN levels USING (gonum) WHERE domain = 'BP' AND level BETWEEN 2 AND 6"""),
    "g10c_ancestors": (ancestors, f"{GRAPH}, {START} SELECT DISTINCT start, ancestor AS gonum, level FROM start JOIN paths ON child = start JOIN levels ON gonum = ancestor"),
    "g10d_descendants": (descendants, f"""{GRAPH}, {START}, d AS (SELECT DISTINCT start, child AS gonum, false AS replaced FROM start JOIN paths ON ancestor = start),
        x AS (SELECT * FROM d UNION ALL SELECT start, parent, true FROM start JOIN edges ON child = start AND rel = 3 WHERE start NOT IN (SELECT start FROM d)) SELECT start, gonum, level, replaced FROM x JOIN levels USING (gonum)"""),
    "g10e_neighbours": (neighbours, f"""{GRAPH}, {START}, n AS (SELECT start, parent AS gonum, 'parent' AS side, rel FROM start JOIN edges ON child = start UNION ALL SELECT start, child, 'child', rel FROM start JOIN edges ON parent = start)
        SELECT start, gonum, side, CASE WHEN bool_or(rel = 3) THEN CASE side WHEN 'parent' THEN 'replaced by' ELSE 'alternate' END WHEN bool_or(rel = 1) AND bool_or(rel = 2) THEN 'both' WHEN bool_or(rel = 1) THEN 'is_a' ELSE 'part_of' END AS relation FROM n GROUP BY start, gonum, side"""),
    "g10g_inheriting_hits": (inheriting_hits, f"{GRAPH}, {DIRECT_SQL}, {START} SELECT start, hit_id, arg_min(child, {{'l': level, 'c': child}}) AS via FROM start JOIN paths ON ancestor = start JOIN direct d ON d.gonum = child JOIN levels l ON l.gonum = child GROUP BY ALL"),
    "g08_root_paths": (root_paths, f"{GRAPH}, {START}, {WALK_UP} SELECT start, array_to_string(path, '>') AS path FROM up WHERE path[1] NOT IN (SELECT child FROM steps)"),
    "g09_longest_paths": (
        longest_paths,
        f"""{GRAPH}, {START}, {WALK_UP}, whole AS (SELECT start, path FROM up WHERE path[1] NOT IN (SELECT child FROM steps)),
inside AS (SELECT DISTINCT a.start, a.path FROM whole a JOIN whole b ON a.start = b.start AND len(a.path) < len(b.path) AND list_filter(b.path, lambda x: list_contains(a.path, x)) = a.path)
SELECT start, array_to_string(path, '>') AS path FROM whole ANTI JOIN inside USING (start, path)""",
    ),
    "l10_terminal_terms": (terminal, f"{GRAPH}, {CHOSEN} SELECT gonum, domain FROM chosen WHERE gonum NOT IN (SELECT ancestor FROM paths JOIN chosen ON gonum = child)"),
    "l11_related_terms": (related, f"{GRAPH}, {CHOSEN}, {START} SELECT gonum FROM chosen WHERE gonum IN (SELECT start FROM start) OR gonum IN (SELECT ancestor FROM paths JOIN start ON child = start) OR gonum IN (SELECT child FROM paths JOIN start ON ancestor = start)"),
    "g11_marked_ancestors": (marked, f"{GRAPH}, {CHOSEN} SELECT DISTINCT ancestor AS gonum, CASE WHEN ancestor IN (SELECT gonum FROM chosen) THEN '*' ELSE '' END AS mark FROM paths JOIN chosen ON gonum = child"),
    "g06_used_only": (used, f"{GRAPH}, {CHOSEN} SELECT child, ancestor, distance FROM paths WHERE child IN (SELECT gonum FROM chosen) AND ancestor IN (SELECT gonum FROM chosen)"),
    "g12_merged_graph": (merged, f"WITH {TERMS_SQL} SELECT gonum, CASE WHEN gonum % 3 = 0 THEN 'first' ELSE name END AS name, CASE WHEN gonum % 3 = 0 OR gonum % 2 = 0 THEN domain ELSE 'XX' END AS domain FROM terms"),
    "g07_slim": (slim, f"WITH {TERMS_SQL} SELECT gonum, gonum % 20 = 0 AS is_slim FROM terms"),
}
