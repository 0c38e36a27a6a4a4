"""Merging datasets: numbers that stay the same when more is added, and one graph of terms from several."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.operators import ontology
from strandlake.operators.stats import numbered_rows
from strandlake.sources.fasta import InputError, numbered_names


def union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def surrogate_keys(rows: DataFrame, key: str, known: DataFrame | None = None, order: str | None = None) -> DataFrame:
    """key and id of every value of a column: those of ``known`` as they are, new ones from one above its greatest id on,
    by ``order`` (its least value; the key itself by default) and then by key. Nulls have no number. A repeated value has
    one number. Numbers are given to sorted ranges in all tasks; no task sees all keys."""
    fresh = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order or key).alias("_o"))
    first = 0
    if known is not None:
        fresh = fresh.join(known.select(key), key, "left_anti")
        first = known.agg(F.max("id")).first()[0] or 0
    new = numbered_rows(fresh, F.col("_o"), F.col(key)).select(key, (F.col("row") + first).cast("long").alias("id"))
    return new if known is None else known.select(key, "id").unionByName(new)


def merged(datasets: dict[str, dict[str, DataFrame]], known: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """One database from several: ``sequences`` (seq_id, ds, seq), ``hits`` (seq_id, hit_id and the hits' other columns),
    ``counts`` (seq_id, lib_id, n), and the keys that were given: ``seq_keys``, ``hit_keys``, ``lib_keys``.

    Each dataset has tables sequences (seq), hits (seq, hit, ...) and counts (seq, lib, n) with names. A name of a sequence
    that two datasets have is an error; hits and libraries of the same name are the same. Numbers follow the order of the
    datasets, then names. With ``known`` keys of an earlier merge, its numbers stay and only new names get new ones. Hits
    and counts of sequences that no dataset lists are left out."""
    known = known or {}
    table = lambda kind: union([d[kind].withColumns({"ds": F.lit(name), "_at": F.lit(i)}) for i, (name, d) in enumerate(datasets.items())])
    sequences, hits, counts = table("sequences"), table("hits"), table("counts")
    twice = sequences.groupBy("seq").agg(F.countDistinct("ds").alias("n")).where("n > 1").head(1)
    if twice:
        raise InputError(f"the sequence {twice[0].seq} is in more than one dataset")
    seq_keys = surrogate_keys(sequences, "seq", known.get("seq_keys"), "_at")
    hit_keys = surrogate_keys(hits, "hit", known.get("hit_keys"), "_at")
    lib_keys = surrogate_keys(counts, "lib", known.get("lib_keys"), "_at")
    seq_id = lambda d: d.join(seq_keys.withColumnRenamed("id", "seq_id"), "seq").drop("_at")
    listed = sequences.select("ds", "seq").distinct()
    own = lambda d: seq_id(d.join(listed, ["ds", "seq"], "left_semi"))
    return {
        "sequences": seq_id(sequences), "hits": own(hits).join(hit_keys.withColumnRenamed("id", "hit_id"), "hit").drop("seq", "hit", "ds"),
        "counts": own(counts).join(lib_keys.withColumnRenamed("id", "lib_id"), "lib").drop("seq", "lib", "ds"), "seq_keys": seq_keys, "hit_keys": hit_keys, "lib_keys": lib_keys,
    }


def instantiated(reads: DataFrame, prefix: str | None = None, order: str = "name") -> tuple[DataFrame, DataFrame]:
    """Sequences of one read each, and their members. Sequences have seq_name, name, seq, len, n_reads; the name is the
    read's own, or with a ``prefix`` PREFIX_ and the read's number in order of a column, padded to the digits of their
    count. Members have seq_name, name, orientation, start and percent aligned. ``reads`` has name and seq."""
    if prefix is None:
        rows = reads.withColumn("seq_name", F.col("name"))
    else:
        rows = numbered_names(reads, prefix, order, len(str(reads.count())))
    rows = rows.withColumns({"len": F.length("seq"), "n_reads": F.lit(1)})
    members = rows.select("seq_name", "name", F.lit("U").alias("orientation"), F.lit(1).alias("start"), F.lit(100).alias("percent_aligned"))
    return rows.select("seq_name", "name", "seq", "len", "n_reads"), members


def merged_edges(graphs: list[DataFrame]) -> DataFrame:
    """Edges (child, parent, rel) of several datasets: of each child, all that the first dataset with any has."""
    rows = union([g.select("child", "parent", "rel").withColumn("_at", F.lit(i)) for i, g in enumerate(graphs)]).distinct()
    first = rows.groupBy("child").agg(F.min("_at").alias("_at"))
    return rows.join(first, ["child", "_at"], "left_semi").drop("_at")


def merged_ontology(terms: list[DataFrame], graphs: list[DataFrame], roots: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Terms with levels, edges and paths of the union of several datasets' graphs. A term's description and its edges are
    those of the first dataset that has any. Since edges of several datasets may join to longer ways, levels and paths are
    worked out anew and the datasets' own are not looked at; terms that no root leads to have a null level. Edges whose
    ends no dataset describes are left out."""
    info = ontology.merged_graph([t.drop("level") for t in terms])
    edges = ontology.used_only(merged_edges(graphs), info, "child", "parent")
    return info.join(ontology.levels(edges, roots), "gonum", "left"), edges, ontology.closure(edges)
