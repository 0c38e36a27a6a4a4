"""FASTA and quality files, and writers of FASTA.

Files are read as records that a line with ``>`` begins, so a record may lie anywhere in a file and large files split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.functions import sequences as Q

#: Least lengths of nucleotide and amino-acid sequences.
LEAST_NT, LEAST_AA = 9, 3
NT_LETTERS, AA_LETTERS = "ACGTN", "ABCDEFGHIKLMNPQRSTVWXYZ*"


class InputError(ValueError):
    """A file breaks a rule that the load depends on."""


def records(spark: SparkSession, path: str) -> DataFrame:
    """header (without ``>``) and lines of each record; lines that start with ``#`` or ``/`` and blank ones are left out."""
    rows = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "\r", "").alias("v"))
    rows = rows.select(F.regexp_replace("v", r"^(?:[#/][^\n]*\n|\s)*>?", "").alias("v")).where("v <> ''")
    lines = F.split("v", "\n")
    kept = F.filter(F.slice(lines, 2, 1 << 30), lambda x: (F.trim(x) != "") & ~x.rlike("^[#/]"))
    return rows.select(F.trim(F.get(lines, F.lit(0))).alias("header"), F.transform(kept, F.trim).alias("lines"))


def read_fasta(spark: SparkSession, path: str, protein: bool = False, check: bool = True) -> DataFrame:
    """name, header, seq, len. The name is the first word, characters other than letters, digits, ``_`` and ``.`` become
    ``_``; letters that are not residues become N or X; sequences below the least length are left out. Names that repeat,
    ignoring case, are an error."""
    letters, unknown, least = (AA_LETTERS, "X", LEAST_AA) if protein else (NT_LETTERS, "N", LEAST_NT)
    rows = records(spark, path).select(
        F.regexp_replace(F.regexp_extract("header", r"^(\S*)", 1), r"[^\w.]", "_").alias("name"), "header",
        F.regexp_replace(F.upper(F.regexp_replace(F.array_join("lines", ""), r"\s", "")), f"[^{letters}]", unknown).alias("seq"),
    )
    rows = rows.withColumn("len", F.length("seq")).where(F.col("len") >= least)
    if check:
        twice = rows.groupBy(F.lower("name").alias("n")).agg(F.count(F.lit(1)).alias("c")).where("c > 1").head(1)
        if twice:
            raise InputError(f"the name {twice[0].n} is used more than once in {path}")
    return rows


def is_protein(spark: SparkSession, path: str, lines: int = 10) -> bool:
    """From the first lines of a file: each counts for the kind that most of its letters are of; the side that leads by
    more than three, or has more lines in the end."""
    first = spark.read.text(path).where(~F.col("value").rlike("^[>#/]|^\\s*$")).limit(lines + 1)
    nt = F.length(F.regexp_replace(F.upper("value"), "[^ACGTNU]", ""))
    lead = 0
    for r in first.select((nt * 2 > F.length(F.trim("value"))).alias("nt")).collect():  # eleven lines
        lead += -1 if r.nt else 1
        if abs(lead) > 3:
            break
    return lead > 0


def read_quality(spark: SparkSession, path: str, sequences: DataFrame, check: bool = True) -> DataFrame:
    """name and quality, an array of numbers. A repeated name, or a length that is not the sequence's, is an error;
    ``quality_warnings`` tells what is missing."""
    rows = records(spark, path).select(
        F.regexp_replace(F.regexp_extract("header", r"^(\S*)", 1), r"[^\w.]", "_").alias("name"),
        F.filter(F.split(F.array_join("lines", " "), r"\s+"), lambda x: x != "").cast("array<int>").alias("quality"),
    )
    if check:
        twice = rows.groupBy("name").agg(F.count(F.lit(1)).alias("c")).where("c > 1").head(1)
        wrong = rows.join(sequences.select("name", "len"), "name").where("size(quality) <> len").head(1)
        for found, what in ((twice, "is used more than once"), (wrong, "has qualities of another length")):
            if found:
                raise InputError(f"{found[0]['name']} {what} in {path}")
    return rows


def quality_warnings(quality: DataFrame, sequences: DataFrame) -> DataFrame:
    """name and problem of sequences without quality and of qualities without sequence."""
    q, s = quality.select("name"), sequences.select("name")
    return s.join(q, "name", "left_anti").withColumn("problem", F.lit("no quality")).unionByName(q.join(s, "name", "left_anti").withColumn("problem", F.lit("no sequence")))


def numbered_names(rows: DataFrame, prefix: str, order: str = "name", width: int = 6) -> DataFrame:
    """Adds ``seq_name``: PREFIX_ and a padded number in the order of a column."""
    from strandlake.operators.stats import numbered_rows

    return numbered_rows(rows, F.col(order)).withColumn("seq_name", F.concat_ws("_", F.lit(prefix), F.lpad(F.col("row").cast("string"), width, "0"))).drop("row")


def fasta_lines(name: Column, seq: Column, header: Column | None = None) -> Column:
    return F.concat(F.lit(">"), name if header is None else F.concat_ws(" ", name, header), F.lit("\n"), seq)


def write_fasta(rows: DataFrame, path: str, name: str = "name", seq: str = "seq", header: str | None = None) -> None:
    rows.select(fasta_lines(F.col(name), F.col(seq), F.col(header) if header else None).alias("value")).write.text(path)


def combined(datasets: dict[str, DataFrame]) -> DataFrame:
    """name (``dataset|sequence``) and seq of several datasets, for a search of all against all."""
    parts = [d.select(F.concat(F.lit(f"{k}|"), "name").alias("name"), "seq") for k, d in datasets.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def translated(orfs: DataFrame) -> DataFrame:
    """name, seq (amino acids) and header of sequences with name, cds and frame; frame 0 has none."""
    aa = F.regexp_replace(Q.translate(F.col("cds")), r"\*$", "")
    rows = orfs.where("frame <> 0").withColumn("_a", aa)
    return rows.select("name", F.col("_a").alias("seq"), F.concat(F.lit("AAlen="), F.length("_a").cast("string"), F.lit(" frame="), F.col("frame").cast("string")).alias("header"))


def hit_fasta(hits: DataFrame) -> DataFrame:
    """name, seq, header of the distinct hits of a table, by name: ``type|rep|id`` for UniProt, ``n1|id`` and so on for
    others, then the description and OS=species. ``hits`` has hit_id, dbtype, description, species, seq, db."""
    rows = hits.dropDuplicates(["hit_id"])
    kind = F.when(F.col("dbtype").isin("SP", "TR"), F.lower("dbtype")).otherwise(F.concat(F.lit("n"), F.col("db").cast("string")))
    return rows.select(F.concat_ws("|", kind, "hit_id").alias("name"), "seq", F.concat_ws(" ", "description", F.concat(F.lit("OS="), "species")).alias("header")).orderBy("name")
