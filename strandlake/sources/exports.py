"""Exports and reports. Each is a DataFrame that Spark writes in parallel; only ``to_text`` is for small tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_tsv(rows: DataFrame, path: str, columns: Sequence[str] | None = None) -> None:
    """Tab-separated with a header in each file; spaces in column names become ``-``."""
    rows = rows.select(*columns) if columns else rows
    rows.toDF(*[c.replace(" ", "-") for c in rows.columns]).write.option("sep", "\t").option("header", True).csv(path)


def to_text(rows: DataFrame, most: int = 10_000) -> str:
    """A small table as text, for a clipboard: at most ``most`` rows."""
    return rows.limit(most).toPandas().to_csv(sep="\t", index=False)


def best_hit_terms(best: DataFrame, direct: DataFrame, terms: DataFrame) -> DataFrame:
    """seq_id, hit_id and each of the best hit's own terms with name and domain."""
    return best.join(direct, "hit_id").join(terms, "gonum").select("seq_id", "hit_id", "gonum", "name", "domain", "ec")


def member_sequences(members: DataFrame, sequences: DataFrame, cluster: str = "cluster", seq: str = "seq") -> DataFrame:
    """name (``cluster|sequence``) and seq of the members of clusters or pairs, to write as FASTA."""
    return members.join(sequences.select(F.col("name").alias(seq), F.col("seq").alias("_s")), seq).select(F.concat_ws("|", cluster, seq).alias("name"), F.col("_s").alias("seq"))


def cluster_levels(members: DataFrame, levels: DataFrame, libraries: Sequence[str], value: str = "n") -> DataFrame:
    """cluster and a column per library: the sum over its members of counts or TPM."""
    return members.join(levels, members.seq == levels.seq_id).groupBy("cluster").pivot("lib", list(libraries)).agg(F.sum(value)).fillna(0)


def merged_counts(files: dict[str, DataFrame], least_ratio: float | None = None) -> DataFrame:
    """domain, name and a count column per file of term tables (domain, name, n_seqs), 0 where a file lacks a term. With
    ``least_ratio``, only rows whose greatest count is that many times the least (at least 1)."""
    long = None
    for name, df in files.items():
        part = df.select("domain", "name", "n_seqs", F.lit(name).alias("_f"))
        long = part if long is None else long.unionByName(part)
    wide = long.groupBy("domain", "name").pivot("_f", list(files)).agg(F.max("n_seqs")).fillna(0, list(files))
    if least_ratio is None:
        return wide
    columns = [F.col(c) for c in files]
    return wide.where(F.greatest(*columns) >= least_ratio * F.greatest(F.least(*columns), F.lit(1)))


def with_log_p(rows: DataFrame, columns: Sequence[str]) -> DataFrame:
    """P-value columns as -log10; 0 becomes the largest value that a p-value can have."""
    return rows.withColumns({c: F.when(F.col(c).isNotNull(), F.least(-F.log10(F.greatest(F.col(c), F.lit(1e-300))), F.lit(300.0))) for c in columns})


def sequence_terms_in(table: DataFrame, seq_terms: DataFrame, de: DataFrame | None = None) -> DataFrame:
    """seq_id and its terms that are in a table of terms, as an array; with ``de``, of those sequences only."""
    rows = seq_terms.join(table.select("gonum"), "gonum", "left_semi")
    rows = rows if de is None else rows.join(de.select("seq_id"), "seq_id", "left_semi")
    return rows.groupBy("seq_id").agg(F.sort_array(F.collect_set("gonum")).alias("terms"))


def overview(sequences: DataFrame, hits: DataFrame, seq_terms: DataFrame) -> DataFrame:
    """measure and value: sequences, their lengths, those with hits and with terms, hits, databases, terms. One row each."""
    one = lambda name, df, c: df.agg(c.cast("double").alias("value")).select(F.lit(name).alias("measure"), "value")
    n = F.count(F.lit(1))
    parts = [
        one("sequences", sequences, n), one("mean length", sequences, F.round(F.avg("len"), 2)), one("longest", sequences, F.max("len")),
        one("sequences with hits", hits, F.countDistinct("seq_id")), one("hits", hits, n), one("databases", hits, F.countDistinct("db")),
        one("sequences with terms", seq_terms, F.countDistinct("seq_id")), one("terms", seq_terms, F.countDistinct("gonum")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def kaks_input(aligned: DataFrame, path: str, files: int) -> None:
    """Gap-free codon pairs, ``seq1:seq2`` and the two texts, over so many files. ``aligned`` has seq1, seq2, cds1, cds2."""
    cut = lambda c: F.transform(F.sequence(F.lit(0), F.floor(F.length(c) / 3).cast("int") - 1), lambda i: F.substring(c, i * 3 + 1, F.lit(3)))
    rows = aligned.where((F.length("cds1") >= 3) & (F.length("cds1") == F.length("cds2")))
    both = F.filter(F.zip_with(cut(F.col("cds1")), cut(F.col("cds2")), lambda x, y: F.struct(x.alias("x"), y.alias("y"))), lambda c: ~c["x"].contains("-") & ~c["y"].contains("-"))
    text = lambda k: F.array_join(F.transform("_k", lambda c: c[k]), "")
    rows = rows.withColumn("_k", both).where(F.size("_k") > 0)
    rows.select(F.concat(F.concat_ws(":", "seq1", "seq2"), F.lit("\n"), text("x"), F.lit("\n"), text("y"), F.lit("\n")).alias("value")).repartition(files).write.text(path)


def flagged_missing(rows: DataFrame, columns: dict[str, float]) -> DataFrame:
    """Columns in which a number stands for a missing value, as nulls; ``columns`` gives each column's number."""
    return rows.withColumns({c: F.when(F.col(c) != v, F.col(c)) for c, v in columns.items()})


def with_sentinels(rows: DataFrame, columns: dict[str, float]) -> DataFrame:
    """Nulls as the numbers that other programs expect for them."""
    return rows.fillna(columns)
