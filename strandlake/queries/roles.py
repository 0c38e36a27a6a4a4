"""The parts that the test tables play, as DataFrames and as SQL of the same rows.

sequences are orders, hits are line items, hit entries are parts, databases are suppliers' numbers, libraries are return
flags with line status as replicate, terms are part numbers in a graph of halves and thirds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DETAIL_SQL = """detail AS (
  SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'Uncharacterized protein' WHEN 1 THEN 'protein Os03g0850800' ELSE p_name END AS description,
    CASE p_size % 5 WHEN 0 THEN 'protein' WHEN 1 THEN 'protein os03g085080' ELSE lower(p_name) END AS uniq, p_size % 5 > 1 AS good,
    p_type || ' ' || p_brand || ' strain' AS species, lower(p_type || ' ' || p_brand) AS species2,
    CASE p_size % 3 WHEN 0 THEN 'SP' WHEN 1 THEN 'TR' ELSE 'GB' END AS dbtype, lower(p_type) AS taxonomy, p_size % 7 <> 0 AS is_aa FROM part)"""


def details(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    return read(spark, sf_dir, "part").select(
        "p_partkey", F.when(size % 5 == 0, "Uncharacterized protein").when(size % 5 == 1, "protein Os03g0850800").otherwise(F.col("p_name")).alias("description"),
        F.concat_ws(" ", "p_type", "p_brand", F.lit("strain")).alias("species"),
        F.when(size % 3 == 0, "SP").when(size % 3 == 1, "TR").otherwise("GB").alias("dbtype"), F.lower("p_type").alias("taxonomy"), (size % 7 != 0).alias("is_aa"),
    )


HITS_SQL = """hits AS (
  SELECT l_orderkey AS seq_id, (l_partkey * 1000000 + l_suppkey) * 1000 + CAST(l_quantity AS BIGINT) * 10 + l_linenumber AS hit_id, l_partkey, l_suppkey % 5 AS db, floor(l_extendedprice / 100) AS bits, l_discount AS evalue,
    l_quantity AS sim, (l_linenumber * 37) % 100 + 1 AS seq_start, (l_linenumber * 37) % 100 + 1 + CAST(l_quantity AS INT) AS seq_end, CAST(l_suppkey % 3 + 1 AS INT) AS frame FROM lineitem)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("l_linenumber") * 37) % 100 + 1
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("seq_id"), ((F.col("l_partkey") * 1000000 + F.col("l_suppkey")) * 1000 + F.col("l_quantity").cast("long") * 10 + F.col("l_linenumber")).alias("hit_id"), "l_partkey", (F.col("l_suppkey") % 5).alias("db"),
        F.floor(F.col("l_extendedprice") / 100).cast("double").alias("bits"), F.col("l_discount").alias("evalue"), F.col("l_quantity").alias("sim"),
        start.alias("seq_start"), (start + F.col("l_quantity").cast("int")).alias("seq_end"), (F.col("l_suppkey") % 3 + 1).cast("int").alias("frame"),
    )


FLAGGED_SQL = f"""{DETAIL_SQL}, {HITS_SQL},
ranked AS (SELECT h.*, row_number() OVER (PARTITION BY seq_id, db ORDER BY bits DESC, evalue, hit_id) AS rank FROM hits h),
placed AS MATERIALIZED (SELECT r.*, description, uniq, good, species, species2, dbtype, taxonomy, is_aa,
    row_number() OVER (PARTITION BY seq_id ORDER BY bits DESC, (dbtype = 'SP') DESC, (dbtype = 'TR') DESC, evalue, good DESC, rank, hit_id) AS place
  FROM ranked r JOIN detail USING (p_partkey_)),
annos AS MATERIALIZED (SELECT seq_id, coalesce(min(place) FILTER (is_aa AND good), min(place) FILTER (is_aa), min(place)) AS anno, min(place) FILTER (dbtype = 'SP' AND good AND is_aa) AS other FROM placed GROUP BY 1),
picked AS MATERIALIZED (SELECT a.seq_id, CASE WHEN o.bits >= 0.7 * x.bits THEN other ELSE anno END AS anno FROM annos a
  JOIN placed x ON x.seq_id = a.seq_id AND x.place = a.anno LEFT JOIN placed o ON o.seq_id = a.seq_id AND o.place = a.other),
flagged AS MATERIALIZED (SELECT p.* REPLACE (CASE WHEN place = 1 OR place = anno THEN 1 ELSE p.rank END AS rank), place = 1 AS best_bits, place = anno AS best_anno, p.rank = 1 OR place = 1 OR place = anno AS best_rank,
    row_number() OVER (PARTITION BY seq_id, species2 ORDER BY place) = 1 AS first_species,
    row_number() OVER (PARTITION BY seq_id, uniq ORDER BY place) = 1 AS first_description FROM placed p JOIN picked USING (seq_id))""".replace("JOIN detail USING (p_partkey_)", "JOIN detail d ON d.p_partkey = r.l_partkey")


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.operators import hits as H

    return H.ranked_with_flags(hits(spark, sf_dir), details(spark, sf_dir).withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", prefer="SP")


COUNTS_SQL = """reps AS (SELECT l_partkey AS seq_id, l_returnflag AS lib, CASE l_linestatus WHEN 'F' THEN 1 ELSE 2 END AS rep, CAST(sum(l_quantity) AS BIGINT) AS n FROM lineitem GROUP BY ALL),
counts AS (SELECT * FROM reps UNION ALL SELECT seq_id, lib, 0, CAST(sum(n) AS BIGINT) FROM reps GROUP BY ALL),
lengths AS (SELECT p_partkey AS seq_id, p_size * 100 AS len FROM part),
sizes AS (SELECT lib, CAST(sum(n) AS BIGINT) AS size FROM counts WHERE rep = 0 GROUP BY 1)"""


def reps(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("seq_id"), F.col("l_returnflag").alias("lib"), F.when(F.col("l_linestatus") == "F", 1).otherwise(2).alias("rep"))
    return rows.agg(F.sum("l_quantity").cast("long").alias("n"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from strandlake.operators import expression as E

    return E.with_totals(reps(spark, sf_dir))


def lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("seq_id"), (F.col("p_size") * 100).alias("len"))


TERMS_SQL = """terms AS (SELECT CAST(p_partkey AS INT) + 1 AS gonum, p_name AS name, CASE p_size % 3 WHEN 0 THEN 'BP' WHEN 1 THEN 'CC' ELSE 'MF' END AS domain FROM part),
edges AS (SELECT gonum AS child, gonum // 2 AS parent, 1 AS rel FROM terms WHERE gonum > 1
  UNION SELECT gonum, gonum // 3, 2 FROM terms WHERE gonum > 2 AND gonum % 3 = 0
  UNION SELECT gonum, gonum - 1, 3 FROM terms WHERE gonum % 50 = 0)"""


def terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    rows = read(spark, sf_dir, "part")
    return rows.select((F.col("p_partkey").cast("int") + 1).alias("gonum"), F.col("p_name").alias("name"), F.when(size % 3 == 0, "BP").when(size % 3 == 1, "CC").otherwise("MF").alias("domain"))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = F.col("gonum")
    t = terms(spark, sf_dir)
    rows = t.where(g > 1).select(g.alias("child"), F.floor(g / 2).cast("int").alias("parent"), F.lit(1).alias("rel"))
    rows = rows.union(t.where((g > 2) & (g % 3 == 0)).select(g, F.floor(g / 3).cast("int"), F.lit(2)))
    return rows.union(t.where(g % 50 == 0).select(g, g - 1, F.lit(3))).distinct()


PAIRS_SQL = """lines AS (SELECT l_orderkey, l_partkey AS part, min(l_extendedprice) AS price, min(l_quantity) AS qty, min(l_discount) AS disc FROM lineitem GROUP BY ALL),
pairs AS MATERIALIZED (SELECT a.part AS seq1, b.part AS seq2, a.part % 4 AS ds1, b.part % 4 AS ds2, min(a.disc + b.disc) AS evalue, max(a.qty + b.qty) AS sim,
    CAST(max(floor((a.price + b.price) / 1000)) AS BIGINT) AS bits, CAST(max(a.qty) AS INT) * 2 AS cov1, CAST(max(b.qty) AS INT) * 2 AS cov2, CAST(max(a.qty + b.qty) AS INT) AS aln
  FROM lines a JOIN lines b USING (l_orderkey) WHERE a.part < b.part GROUP BY ALL)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").groupBy("l_orderkey", F.col("l_partkey").alias("part")).agg(F.min("l_extendedprice").alias("price"), F.min("l_quantity").alias("qty"), F.min("l_discount").alias("disc"))
    a, b = lines.toDF("o", "seq1", "p1", "q1", "d1"), lines.toDF("o", "seq2", "p2", "q2", "d2")
    rows = a.join(b, "o").where("seq1 < seq2")
    ds = [(F.col(f"seq{i}") % 4).alias(f"ds{i}") for i in (1, 2)]
    return rows.groupBy("seq1", "seq2").agg(
        F.min(F.col("d1") + F.col("d2")).alias("evalue"), F.max(F.col("q1") + F.col("q2")).alias("sim"), F.max(F.floor((F.col("p1") + F.col("p2")) / 1000)).cast("long").alias("bits"),
        (F.max("q1").cast("int") * 2).alias("cov1"), (F.max("q2").cast("int") * 2).alias("cov2"), F.max(F.col("q1") + F.col("q2")).cast("int").alias("aln"),
    ).select("seq1", "seq2", *ds, "evalue", "sim", "bits", "cov1", "cov2", "aln")


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})
