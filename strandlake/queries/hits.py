"""Hit ranking, flags and summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlake.functions import descriptions as D
from strandlake.operators import hits as H
from strandlake.plans.filters import HitFilter, apply
from strandlake.queries import roles as R
from strandlake.queries.roles import DETAIL_SQL, FLAGGED_SQL, HITS_SQL


def rank_per_database(spark, sf):
    return H.rank_per_database(R.hits(spark, sf)).select("seq_id", "hit_id", "db", "rank")


def hit_flags(spark, sf):
    return R.flagged(spark, sf).select("seq_id", "hit_id", "place", "best_bits", "best_anno", "first_species", "first_description", "best_rank", H.flag_number().alias("flags"))


def hits_by_hit(spark, sf):
    """The hit table: filtered hits grouped by entry, most sequences first."""
    spec = HitFilter(evalue=0.08, least={"sim": 10.0}, best=("best_bits", "best_anno", "best_rank"), databases=(("SP", "economy"), ("TR", "economy"), ("SP", "small"), ("TR", "large")))
    rows = apply(R.flagged(spark, sf), spec)
    parts = rows.withColumn("hit_id", F.col("l_partkey"))
    return H.by_hit(parts).orderBy(F.desc("n_seqs"), F.desc("bits"), "hit_id")


def species_counts(spark, sf):
    return H.species_counts(R.flagged(spark, sf))


def database_counts(spark, sf):
    return H.database_counts(R.flagged(spark, sf))


def unique_hit_counts(spark, sf):
    return H.unique_hit_counts(R.flagged(spark, sf).withColumn("hit_id", F.col("l_partkey")))


def crowded_hits(spark, sf):
    """Hits of sixteen orders as those of one sequence, with up to four terms each, ranked anew."""
    rows = H.rank_per_database(R.hits(spark, sf).withColumn("seq_id", F.floor(F.col("seq_id") / 16)))
    rows = rows.join(R.details(spark, sf).withColumnRenamed("p_partkey", "l_partkey"), "l_partkey")
    return rows.withColumn("go", F.array_repeat(F.lit(1), (F.col("l_partkey") % 5).cast("int")))


def prune_hits(spark, sf):
    return H.prune(crowded_hits(spark, sf)).select("seq_id", "hit_id", "db", "rank")


def prune_alignments(spark, sf):
    """Places are cut to tens, so that alignments repeat."""
    tens = lambda c: (F.floor(F.col(c) / 10) * 10).cast("int")
    rows = crowded_hits(spark, sf).withColumns({"bits": F.floor(F.col("bits") / 300) * 300.0, "evalue": F.round("evalue", 1), "sim": F.lit(50.0), "seq_start": tens("seq_start"), "seq_end": tens("seq_end")})
    return H.prune(rows, by="alignment").select("seq_id", "hit_id", "db", "rank")


def merge_hits(spark, sf):
    return H.merge_hits(R.flagged(spark, sf), top=1).select("seq_id", "hit_id")


def hits_of_parts(spark, sf):
    """Here parts are sequences and orders are hits."""
    rows = R.hits(spark, sf).select(F.col("l_partkey").alias("seq_id"), F.col("seq_id").alias("hit_id"), "bits")
    return rows.groupBy("seq_id", "hit_id").agg(F.max("bits").alias("bits"))


def shared_hit(spark, sf):
    """The pairs are given."""
    return H.shared_hit(R.pairs(spark, sf).select("seq1", "seq2"), hits_of_parts(spark, sf))


def unhit_entries(spark, sf):
    known = R.read(spark, sf, "part").select((F.col("p_size") % 5).alias("db"), F.col("p_partkey").alias("hit_id"))
    seen = R.read(spark, sf, "lineitem").where("l_discount = 0.1 AND l_quantity > 40").select(F.col("l_partkey").alias("hit_id"))
    return H.unhit_entries(seen, known)


def contained_hits(spark, sf):
    return H.contained(R.hits(spark, sf), flank=2)


def distinct_regions(spark, sf):
    return H.distinct_regions(R.hits(spark, sf), flank=2)


def first_in_file(spark, sf):
    rows = R.read(spark, sf, "lineitem").select(F.col("l_partkey").alias("seq1"), F.col("l_suppkey").alias("seq2"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("line"), F.col("l_quantity").alias("sim"))
    return H.first_in_file(rows)


def best_go_hit(spark, sf):
    from strandlake.operators import ontology as O

    direct = R.read(spark, sf, "part").where("p_size % 4 = 0").select(F.col("p_partkey").alias("l_partkey"))
    rows = R.flagged(spark, sf)
    ids = rows.join(direct, "l_partkey", "left_semi").select("hit_id").distinct()
    return O.best_go_hit(rows, ids).select("seq_id", "hit_id", "bits")


def new_hits(spark, sf):
    rows = R.hits(spark, sf).select("seq_id", F.col("l_partkey").alias("hit_id"), "db")
    return H.new_hits(rows.where("db < 3"), rows.where("db >= 3")).select("seq_id", "hit_id").distinct()


def description_forms(spark, sf):
    rows = R.details(spark, sf)
    return rows.select("p_partkey", D.is_good(F.col("description")).alias("good"), D.unique_form(F.col("description")).alias("uniq"), D.species(F.col("species")).alias("species2"), D.brief(F.col("description")).alias("brief"), D.database_label(F.col("dbtype"), F.col("taxonomy")).alias("label"), D.go_id(F.col("p_partkey")).alias("go_id"))


def prune_sql(bits: str, evalue: str, sim: str, start: str, end: str, alignment: bool) -> str:
    """The walk over neighbours, a step for each row; the last one kept is carried along."""
    same = "x.bits = p.bits AND x.evalue = p.evalue AND x.sim = p.sim AND x.a = p.a AND x.b = p.b" if alignment else "true"
    return f"""{DETAIL_SQL}, {HITS_SQL}, c AS (SELECT * REPLACE (seq_id // 16 AS seq_id) FROM hits), k AS (SELECT *, row_number() OVER (PARTITION BY seq_id, db ORDER BY bits DESC, evalue, hit_id) AS rank FROM c),
        m AS (SELECT k.seq_id, k.db, hit_id, k.rank, {bits} AS bits, {evalue} AS evalue, {sim} AS sim, {start} AS a, {end} AS b, description AS d, good, k.l_partkey % 5 AS go FROM k JOIN detail ON p_partkey = k.l_partkey),
        n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY seq_id, db ORDER BY d, bits DESC, evalue, sim DESC, rank, hit_id) AS n FROM m),
        w AS (SELECT seq_id, db, n, n AS last, CAST(NULL AS BIGINT) AS gone FROM n WHERE n = 1 UNION ALL
          SELECT seq_id, db, n, CASE WHEN fresh OR better THEN n ELSE last END, CASE WHEN fresh THEN NULL WHEN better THEN last ELSE n END FROM (
            SELECT x.seq_id, x.db, x.n, w.last, x.d <> l.d OR NOT ({same}) AS fresh,
              (x.good AND NOT l.good) OR (CASE WHEN x.go > 0 AND l.go = 0 THEN x.bits >= 0.7 * l.bits WHEN x.go > l.go THEN x.bits >= l.bits ELSE false END) AS better
            FROM w JOIN n x ON x.seq_id = w.seq_id AND x.db = w.db AND x.n = w.n + 1 JOIN n p ON p.seq_id = w.seq_id AND p.db = w.db AND p.n = w.n JOIN n l ON l.seq_id = w.seq_id AND l.db = w.db AND l.n = w.last)),
        kept AS (SELECT * FROM n WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.seq_id = n.seq_id AND w.db = n.db AND w.gone = n.n)),
        top AS (SELECT *, row_number() OVER (PARTITION BY seq_id, db ORDER BY rank, hit_id) AS t FROM kept)
        SELECT seq_id, hit_id, db, CASE WHEN t = 1 THEN 1 ELSE rank END AS rank FROM top"""


COUNT3 = "CAST(sum(CAST(best_bits AS INT)) AS BIGINT) AS n_best_bits, CAST(sum(CAST(best_anno AS INT)) AS BIGINT) AS n_best_anno"

QUERIES = {
    "w01_rank_per_database": (rank_per_database, f"WITH {HITS_SQL} SELECT seq_id, hit_id, db, row_number() OVER (PARTITION BY seq_id, db ORDER BY bits DESC, evalue, hit_id) AS rank FROM hits"),
    "w02_w03_w04_hit_flags": (hit_flags, f"""WITH {FLAGGED_SQL} SELECT seq_id, hit_id, place, best_bits, best_anno, first_species, first_description, best_rank,
        CAST(CASE WHEN best_rank THEN 2 ELSE 0 END + CASE WHEN first_species THEN 4 ELSE 0 END + CASE WHEN first_description THEN 8 ELSE 0 END + CASE WHEN best_bits THEN 16 ELSE 0 END + CASE WHEN best_anno THEN 32 ELSE 0 END AS INT) AS flags FROM flagged"""),
    "a02_f10_j02_hits_by_hit": (hits_by_hit, f"""WITH {FLAGGED_SQL}, kept AS (SELECT * FROM flagged WHERE evalue <= 0.08 AND sim >= 10 AND (best_bits OR best_anno OR best_rank)
        AND ((dbtype IN ('SP', 'TR') AND taxonomy = 'economy') OR (dbtype = 'SP' AND taxonomy = 'small') OR (dbtype = 'TR' AND taxonomy = 'large'))),
        best AS (SELECT l_partkey, bits, evalue, sim, seq_id, row_number() OVER (PARTITION BY l_partkey ORDER BY bits DESC, evalue, sim DESC, seq_id) AS r FROM kept)
        SELECT k.l_partkey AS hit_id, count(DISTINCT k.seq_id) AS n_seqs, {COUNT3.replace('best_bits AS INT', 'k.best_bits AS INT').replace('best_anno AS INT', 'k.best_anno AS INT')}, CAST(sum(CAST(best_rank AS INT)) AS BIGINT) AS n_rank1,
        any_value(b.bits) AS bits, any_value(b.evalue) AS evalue, any_value(b.sim) AS sim, any_value(b.seq_id) AS best_seq FROM kept k JOIN best b ON b.l_partkey = k.l_partkey AND r = 1 GROUP BY 1"""),
    "a03_l08_species_counts": (species_counts, f"WITH {FLAGGED_SQL} SELECT regexp_replace(species, ' strain$', '') AS species, count(*) AS n_hits, {COUNT3} FROM flagged GROUP BY 1"),
    "a04_database_counts": (database_counts, f"""WITH {FLAGGED_SQL}, one AS (SELECT seq_id, min(db) AS db FROM flagged GROUP BY 1 HAVING min(db) = max(db)), n AS (SELECT db, count(*) AS n_only FROM one GROUP BY 1)
        SELECT db, count(*) AS n_hits, {COUNT3}, coalesce(any_value(n_only), 0) AS n_only FROM flagged LEFT JOIN n USING (db) GROUP BY 1"""),
    "a05_unique_hit_counts": (unique_hit_counts, f"WITH {FLAGGED_SQL} SELECT l_partkey AS hit_id, count(DISTINCT seq_id) AS n_seqs, CAST(sum(CAST(best_bits AS INT)) AS BIGINT) AS n_best, min(evalue) AS best_evalue FROM flagged GROUP BY 1"),
    "w07_prune_hits": (prune_hits, f"WITH RECURSIVE {prune_sql('bits', 'evalue', 'sim', 'seq_start', 'seq_end', False)}"),
    "w07_prune_alignments": (prune_alignments, f"WITH RECURSIVE {prune_sql('floor(bits / 300) * 300', 'round(evalue, 1)', '50', 'seq_start // 10', 'seq_end // 10', True)}"),
    "w08_merge_hits": (merge_hits, f"WITH {FLAGGED_SQL} SELECT seq_id, hit_id FROM flagged WHERE rank <= 1 OR best_bits OR best_anno"),
    "j06_shared_hit": (shared_hit, f"""WITH {HITS_SQL}, h AS (SELECT l_partkey AS seq_id, seq_id AS hit_id, max(bits) AS bits FROM hits GROUP BY l_partkey, hits.seq_id)
        SELECT a.seq_id AS seq1, b.seq_id AS seq2, first(hit_id ORDER BY a.bits + b.bits DESC, hit_id) AS hit_id FROM h a JOIN h b USING (hit_id) WHERE a.seq_id < b.seq_id GROUP BY ALL"""),
    "j08_unhit_entries": (unhit_entries, """WITH s AS (SELECT DISTINCT l_partkey AS hit_id, 1 AS seen FROM lineitem WHERE l_discount = 0.1 AND l_quantity > 40)
        SELECT p_size % 5 AS db, count(*) AS n_known, count(seen) AS n_hit, count(*) - count(seen) AS n_unhit FROM s RIGHT JOIN part ON p_partkey = hit_id GROUP BY 1"""),
    "j09_contained_hits": (contained_hits, f"""WITH {HITS_SQL} SELECT i.seq_id, i.hit_id AS inner_hit, o.hit_id AS outer_hit FROM hits i JOIN hits o ON i.seq_id = o.seq_id AND i.frame = o.frame
        WHERE (o.bits > i.bits OR (o.bits = i.bits AND o.hit_id < i.hit_id)) AND i.seq_start >= o.seq_start - 2 AND i.seq_end <= o.seq_end + 2"""),
    "j09_distinct_regions": (distinct_regions, None),
    "w10_first_in_file": (first_in_file, "SELECT l_partkey AS seq1, l_suppkey AS seq2, min(l_orderkey * 10 + l_linenumber) AS line, arg_min(l_quantity, l_orderkey * 10 + l_linenumber) AS sim FROM lineitem GROUP BY ALL"),
    "w05_best_go_hit": (best_go_hit, f"""WITH {FLAGGED_SQL}, g AS (SELECT f.*, row_number() OVER (PARTITION BY seq_id ORDER BY bits DESC, CAST(best_bits AS INT) + CAST(best_anno AS INT) DESC, evalue, hit_id) AS n
        FROM flagged f JOIN part ON p_partkey = l_partkey AND p_size % 4 = 0) SELECT seq_id, hit_id, bits FROM g WHERE n = 1"""),
    "j13_new_hits": (new_hits, f"WITH {HITS_SQL} SELECT DISTINCT seq_id, l_partkey AS hit_id FROM hits a WHERE db >= 3 AND NOT EXISTS (SELECT 1 FROM hits b WHERE b.db < 3 AND b.seq_id = a.seq_id AND b.l_partkey = a.l_partkey)"),
    "s01_s07_description_forms": (description_forms, f"""WITH {DETAIL_SQL} SELECT p_partkey, good, uniq, regexp_replace(species, ' strain$', '') AS species2, lower(description) AS brief,
        dbtype || substr(taxonomy, 1, 3) AS label, printf('GO:%07d', p_partkey) AS go_id FROM detail"""),
}
