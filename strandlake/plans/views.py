"""Tables and detail views put together from a choice of columns: only the joins that a column asks for are planned."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.plans.filters import apply


@dataclass(frozen=True)
class Field:
    """A column of a table: the name shown, the group it is listed under, and its expression or source table."""

    name: str
    group: str
    source: str = "own"
    expression: Column | None = None

    def column(self) -> Column:
        return (F.col(self.name) if self.expression is None else self.expression).alias(self.name)


@dataclass(frozen=True)
class TableView:
    """A table with joined tables: ``joins`` maps a source to (DataFrame with one row per key, key columns)."""

    base: DataFrame
    fields: Sequence[Field]
    joins: dict[str, tuple[DataFrame, list[str]]]

    def select(self, names: Sequence[str], spec=None, filter_sources: Sequence[str] = (), order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
        """The named columns of the rows that a filter keeps. Sources are joined (left) if a column or the filter uses
        them; the engine prunes the rest of their columns."""
        chosen = [next(f for f in self.fields if f.name == n) for n in names]
        df = self.base
        for source in dict.fromkeys([*[f.source for f in chosen if f.source != "own"], *filter_sources]):
            other, key = self.joins[source]
            df = df.join(other, key, "left")
        df = apply(df, spec)
        df = df.orderBy(*order) if order else df
        df = df.limit(limit) if limit else df
        return df.select(*[f.column() for f in chosen])


def best_hit_table(hits: DataFrame, details: DataFrame, flag: str, prefix: str) -> DataFrame:
    """seq_id and the columns of the best hit of a kind, each with a prefix: one of the tables that a sequence view joins."""
    rows = hits.where(F.col(flag)).join(details, "hit_id", "left")
    return rows.select("seq_id", *[F.col(c).alias(f"{prefix}_{c}") for c in rows.columns if c != "seq_id"])


def hits_of(hits: DataFrame, seq_id, mode: str = "all") -> DataFrame:
    """Hits of one sequence by bits, e-value and similarity: all, best, best of each database, or the distinct species,
    descriptions or regions."""
    flag = {"all": None, "best": F.col("best_bits") | F.col("best_anno"), "database": F.col("best_rank"), "species": F.col("first_species"), "description": F.col("first_description"), "region": F.col("region")}[mode]
    rows = hits.where(F.col("seq_id") == seq_id)
    return (rows if flag is None else rows.where(flag)).orderBy(F.desc("bits"), "evalue", F.desc("sim"), "hit_id")


def counts_of(counts: DataFrame, seq_id, libraries: Sequence[str]) -> DataFrame:
    """Replicate counts of one sequence, a row per replicate and a column per library."""
    return counts.where(F.col("seq_id") == seq_id).groupBy("rep").pivot("lib", list(libraries)).agg(F.sum("n")).orderBy("rep")


def terms_of(seq_terms: DataFrame, terms: DataFrame, seq_id, inherited: bool = False) -> DataFrame:
    rows = seq_terms.where(F.col("seq_id") == seq_id)
    rows = rows if inherited else rows.where("is_direct")
    return rows.join(terms, "gonum").select("gonum", "name", "domain", "level", "hit_id", "is_direct").orderBy("domain", "level", "gonum")


def pairs_of(pairs: DataFrame, seq) -> DataFrame:
    return pairs.where((F.col("seq1") == seq) | (F.col("seq2") == seq)).orderBy("evalue", "seq1", "seq2")


def drill(rows: DataFrame, selected: DataFrame, key: str, left: Sequence[str]) -> DataFrame:
    """Rows of another table that belong to selected ones: ``left`` names the columns that may hold the key (a pair has
    two). Each row once."""
    ids = selected.select(F.col(key).alias("_k")).distinct()
    if len(left) == 1:
        return rows.join(ids, F.col(left[0]) == F.col("_k"), "left_semi")
    found = rows.join(ids, F.col(left[0]) == F.col("_k"), "left_semi")
    for name in left[1:]:
        found = found.unionByName(rows.join(ids, F.col(name) == F.col("_k"), "left_semi"))
    return found.distinct()


def snps_of(snps: DataFrame, contig) -> DataFrame:
    """Mismatch SNPs of one contig with their base counts, ``A=4 C=2``, as a map."""
    rows = snps.where((F.col("contig") == contig) & (F.col("kind") == "mismatch"))
    return rows.withColumn("bases", F.transform_values(F.str_to_map("bases", F.lit(" "), F.lit("=")), lambda _, v: v.cast("int"))).orderBy("pos")
