"""Mixing sources to target weights with hash-threshold histograms.

Each row has a hash that does not depend on order or partitions. Per source, the words are summed by hash bucket, the
bucket that crosses the budget is found from the running sum, and only that bucket is summed again by the next bits.
Rows under the threshold are taken; nothing is sorted. Budget that is left because the row at the threshold is too long
goes to a further round over the rows that still fit, so thresholds are nested and a row's copies follow from its own
hash, its size and one row of decisions per source.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import WORD, word_count, written

HASH_BITS = 60
LEVEL_BITS = 14
LEVELS = 2
ROUNDS = 3

__all__ = ["WORD", "cycled_weights", "mix", "source_targets", "with_copies"]


def cycled_weights(sources: DataFrame, weights: Sequence[float] = (3, 1, 2), source: str = "source") -> DataFrame:
    """Weights dealt in turn to sources by code point, null last. ``sources`` has one row per source."""
    place = F.row_number().over(Window.orderBy(F.col(source).asc_nulls_last())) - 1
    dealt = F.array(*[F.lit(float(w)) for w in weights])
    return sources.select(source, F.element_at(dealt, (place % len(weights) + 1).cast("int")).alias("weight"))


def source_targets(sized: DataFrame, budget_share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """Fill a budget of ``budget_share`` times all words by weight, no source above ``max_epochs`` times its own words.

    ``sized`` has one row per source: source, source_size, weight. The level at which sources fill is found by repeated
    sums over that table: sources whose share is above their limit stop there, and the rest share what is left.
    Adds ``target``. A source without words has the target 0; weights of null or below 0 count as 0.
    """
    weight = F.greatest(F.coalesce("weight", F.lit(0.0)), F.lit(0.0))
    rows = sized.withColumns({"weight": weight, "_limit": F.col("source_size") * float(max_epochs)})
    total = rows.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = 0.0, -1
    while True:
        full = F.col("_limit") <= F.lit(level) * F.col("weight")
        n, held, weights = rows.agg(
            F.coalesce(F.sum(full.cast("int")), F.lit(0)),
            F.coalesce(F.sum(F.when(full, F.col("_limit"))), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0)),
        ).first()
        if n == stopped or not weights:
            break
        stopped, level = n, max(level, (budget_share * total - held) / weights)
    target = F.least(F.col("_limit"), F.lit(level) * F.col("weight"))
    return rows.withColumn("target", target.cast("double")).drop("_limit")


def _threshold(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Adds to ``state`` (source, budget, low, most) the highest hash ``cut`` so that rows with low <= hash < cut and a
    size of at most ``most`` have no more than ``budget`` words, and the words ``got`` of those rows."""
    now = state.withColumns({"from_": F.col("low"), "to_": F.lit(1 << HASH_BITS).cast("long"), "got": F.lit(0).cast("long")})
    for level in range(LEVELS):
        shift = HASH_BITS - LEVEL_BITS * (level + 1)
        here = (
            rows.join(now.select(F.col("source").alias("_s"), "from_", "to_", "most"), F.col("source").eqNullSafe(F.col("_s")))
            .where((F.col("hash") >= F.col("from_")) & (F.col("hash") < F.col("to_")) & (F.col("size") <= F.col("most")))
            .groupBy("source", F.shiftright("hash", shift).alias("bucket"))
            .agg(F.sum("size").alias("words"))
        )
        run = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        over = (
            here.withColumn("upto", run)
            .join(now.select(F.col("source").alias("_s"), "budget", "got"), F.col("source").eqNullSafe(F.col("_s")))
            .groupBy("source")
            .agg(
                F.min(F.when(F.col("upto") + F.col("got") > F.col("budget"), F.col("bucket"))).alias("edge"),
                F.max(F.when(F.col("upto") + F.col("got") <= F.col("budget"), F.col("upto"))).alias("below"),
            )
        )
        over = over.withColumnRenamed("source", "_o")
        edge = F.shiftleft("edge", shift)
        now = written(
            now.join(over, F.col("source").eqNullSafe(F.col("_o")), "left").select(
                *state.columns,
                F.when(F.col("edge").isNull(), F.col("to_")).otherwise(F.greatest(edge, F.col("from_"))).alias("from_"),
                F.when(F.col("edge").isNull(), F.col("to_")).otherwise(F.least(edge + F.lit(1 << shift), F.col("to_"))).alias("to_"),
                (F.col("got") + F.coalesce("below", F.lit(0))).alias("got"),
            ),
            "mix-level",
        )
    return now.select(*state.columns, F.col("from_").alias("cut"), "got")


def mix(docs: DataFrame, weights: DataFrame, budget_share: float = 1.5, max_epochs: float = 2.0, source: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row of decisions per source: source, source_size, target, whole (copies of every row), cuts (thresholds).

    ``weights`` has one row per source: source, weight; a source that it lacks has the weight 0. Rows are told apart by
    the hash of id and text; equal rows are taken or left together. A null or empty text has no words and costs nothing: it
    comes as often as its source is taken whole.
    An empty table gives no rows. Other columns are not looked at, so their names cannot clash.
    """
    rows = written(_sized(docs, source, text, id_col).select("source", "size", "hash"), "mix-rows")
    sized = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = weights.select(F.col(source).alias("_w"), F.col("weight").cast("double").alias("weight"))
    sized = written(sized.join(named, F.col("source").eqNullSafe(F.col("_w")), "left").drop("_w"), "mix-sources")
    targets = written(source_targets(sized, budget_share, max_epochs), "mix-targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    state = targets.withColumn("whole", whole).select(
        "source", "source_size", "target", "whole",
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"),
        F.lit(0).cast("long").alias("low"), F.lit((1 << 62)).cast("long").alias("most"),
        F.array().cast("array<struct<cut:bigint,most:bigint>>").alias("cuts"),
    )
    for _ in range(ROUNDS):
        state = state.withColumn("most", F.least("most", F.floor("budget")))
        found = _threshold(rows, state)
        state = found.select(
            "source", "source_size", "target", "whole",
            (F.col("budget") - F.col("got")).alias("budget"), F.col("cut").alias("low"), "most",
            F.concat("cuts", F.array(F.struct("cut", "most"))).alias("cuts"),
        )
    return written(state.select("source", "source_size", "target", "whole", "cuts"), "mix-decisions")


def _sized(docs: DataFrame, source: str, text: str, id_col: str) -> DataFrame:
    spread = F.xxhash64(F.col(id_col), F.col(text))
    return docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.shiftrightunsigned(F.xxhash64(spread, F.lit("mix")), 64 - HASH_BITS).alias("hash"),
    )


def _copies() -> Column:
    under = F.exists("cuts", lambda c: (F.col("hash") < c["cut"]) & (F.col("size") <= c["most"]) & (F.col("size") > 0))
    return (F.col("whole") + under.cast("int")).alias("copies")


def with_copies(docs: DataFrame, decisions: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Every row with its size, its source's size and target, and the copies of it that the mix takes."""
    rows = _sized(docs, source, text, id_col).join(decisions.withColumnRenamed("source", "_d"), F.col("source").eqNullSafe(F.col("_d")))
    return rows.select("doc_id", "source", "size", "source_size", "target", _copies())


def mixed(docs: DataFrame, decisions: DataFrame, source: str = "source", text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The rows of the mix itself, in the columns of ``docs``: each row as often as the mix takes it."""
    names = {c: f"_in_{i}" for i, c in enumerate(docs.columns)}
    kept = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    spread = F.xxhash64(F.col(names[id_col]), F.col(names[text]))
    rows = kept.withColumns({"size": word_count(F.col(names[text])), "hash": F.shiftrightunsigned(F.xxhash64(spread, F.lit("mix")), 64 - HASH_BITS)})
    chosen = rows.join(decisions, F.col(names[source]).eqNullSafe(F.col("source"))).withColumn("copies", _copies())
    again = chosen.withColumn("_copy", F.explode(F.array_repeat(F.lit(1), F.col("copies"))))
    return again.select(*[F.col(n).alias(c) for c, n in names.items()])
