"""UniProt flat files and OBO ontologies, read by record."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.operators.ontology import EVIDENCE


def _entries(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "//\n").text(path).withColumnRenamed("value", "v")
    return rows.select(F.regexp_replace("v", "\r", "").alias("v")).where(F.col("v").rlike(r"(?m)^ID   "))


def read_uniprot(spark: SparkSession, path: str) -> DataFrame:
    """hit_id, go (array of gonum, ec), kegg, pfam, ec, interpro. An evidence code that is not known is UNK; EC numbers
    count in the recommended name only."""
    all_ = lambda pattern: F.regexp_extract_all("v", F.lit(pattern), F.lit(1))
    known = [c for codes in EVIDENCE.values() for c in codes]
    code = lambda x: F.regexp_extract(x, r"; (\w+):", 1)
    go = F.transform(all_(r"(?m)^DR   GO; (GO:\d+;.*)$"), lambda x: F.struct(F.regexp_extract(x, r"GO:0*(\d+)", 1).cast("int").alias("gonum"), F.when(code(F.regexp_replace(x, r"^.*; ", "; ")).isin(*known), code(F.regexp_replace(x, r"^.*; ", "; "))).otherwise("UNK").alias("ec")))
    name = F.regexp_extract("v", r"(?ms)^DE   RecName:(.*?)(?=^DE   (?:AltName|SubName|Contains|Includes|Flags)|^(?!DE))", 1)
    return _entries(spark, path).select(
        F.regexp_extract("v", r"(?m)^ID   (\S+)", 1).alias("hit_id"), go.alias("go"),
        F.array_join(all_(r"(?m)^DR   KEGG; ([^;]+);"), ";").alias("kegg"), F.array_join(all_(r"(?m)^DR   Pfam; ([^;]+);"), ";").alias("pfam"),
        F.array_join(F.regexp_extract_all(name, F.lit(r"EC=([\d.n-]+)"), F.lit(1)), ";").alias("ec"), F.array_join(all_(r"(?m)^DR   InterPro; ([^;]+);"), ";").alias("interpro"),
    )


def uniprot_fasta(spark: SparkSession, path: str, kind: str = "sp", skip: DataFrame | None = None) -> DataFrame:
    """name, header, seq of entries: ``sp|AC|ID`` and the full name, OS and GN. Ids in ``skip`` (hit_id) are left out."""
    one = lambda pattern: F.regexp_extract("v", pattern, 1)
    full = F.trim(F.regexp_replace(one(r"(?m)Full=([^;{]+)"), r"\s+", " "))
    species = F.regexp_replace(F.regexp_replace(F.array_join(F.regexp_extract_all("v", F.lit(r"(?m)^OS   (.*)$"), F.lit(1)), " "), r"\.$", ""), r"\s+", " ")
    gene = one(r"(?m)^GN   Name=([^;{]+)")
    rows = _entries(spark, path).select(
        one(r"(?m)^ID   (\S+)").alias("hit_id"), one(r"(?m)^AC   (\w+)").alias("ac"), full.alias("full"), species.alias("os"), F.trim(gene).alias("gn"),
        F.regexp_replace(one(r"(?ms)^SQ   [^\n]*\n(.*)$"), r"\s", "").alias("seq"),
    )
    if skip is not None:
        rows = rows.join(skip.select("hit_id"), "hit_id", "left_anti")
    tail = F.when(F.col("gn") != "", F.concat(F.lit("GN="), "gn"))
    return rows.select(F.concat_ws("|", F.lit(kind), "ac", "hit_id").alias("name"), F.concat_ws(" ", "full", F.concat(F.lit("OS="), "os"), tail).alias("header"), "seq")


def _stanzas(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("lineSep", "[Term]").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), r"(?s)\n\[Typedef\].*$", "\n").alias("v"))
    return rows.where(F.col("v").rlike(r"(?m)^id: GO:\d+"))


def read_terms(spark: SparkSession, path: str) -> DataFrame:
    """gonum, name, domain (BP, CC, MF), subsets (array) and obsolete."""
    one = lambda pattern: F.regexp_extract("v", pattern, 1)
    space = one(r"(?m)^namespace: (\S+)")
    domain = F.when(space == "biological_process", "BP").when(space == "cellular_component", "CC").when(space == "molecular_function", "MF")
    return _stanzas(spark, path).select(
        one(r"(?m)^id: GO:0*(\d+)").cast("int").alias("gonum"), F.trim(one(r"(?m)^name: (.*)$")).alias("name"), domain.alias("domain"),
        F.regexp_extract_all("v", F.lit(r"(?m)^subset: (\S+)"), F.lit(1)).alias("subsets"), F.col("v").rlike(r"(?m)^is_obsolete: true").alias("obsolete"),
    )


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    """child, parent, rel: 1 is_a, 2 part_of, 3 from an alternate id to its term. Obsolete terms have none of 1 and 2."""
    rows = _stanzas(spark, path).select("v", F.regexp_extract("v", r"(?m)^id: GO:0*(\d+)", 1).cast("int").alias("id"), F.col("v").rlike(r"(?m)^is_obsolete: true").alias("obsolete"))
    found = lambda pattern, rel: rows.select("id", "obsolete", F.explode(F.regexp_extract_all("v", F.lit(pattern), F.lit(1))).alias("o"), F.lit(rel).alias("rel"))
    up = found(r"(?m)^is_a: GO:0*(\d+)", 1).unionByName(found(r"(?m)^relationship: part_of GO:0*(\d+)", 2)).where("NOT obsolete")
    alt = found(r"(?m)^alt_id: GO:0*(\d+)", 3)
    return up.select(F.col("id").alias("child"), F.col("o").cast("int").alias("parent"), "rel").unionByName(alt.select(F.col("o").cast("int").alias("child"), F.col("id").alias("parent"), "rel")).distinct()


def read_slim(spark: SparkSession, path: str) -> DataFrame:
    """gonum and name of a subset's own file."""
    return read_terms(spark, path).where("NOT obsolete").select("gonum", "name")
