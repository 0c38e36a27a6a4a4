"""Column statistics, quartiles, histograms, table order, samples and set operations on tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.plans.lineage import cut


def column_stats(df: DataFrame, columns: list[str]) -> DataFrame:
    """A row per column: n, mean, sd (of a sample; 0 for a mean of 0), median, low, high, range and sum over its
    non-null values. One pass: the columns are turned into rows of sums, not scanned one by one."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as double)" for c in columns)
    rows = df.selectExpr(f"stack({len(columns)}, {pairs}) as (column, value)").where("value IS NOT NULL")
    v = F.col("value")
    sd = F.when(F.avg(v) == 0, 0.0).otherwise(F.coalesce(F.stddev_samp(v), F.lit(0.0)))
    return rows.groupBy("column").agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), sd.alias("sd"), F.percentile(v, 0.5).alias("median"),
        F.min(v).alias("low"), F.max(v).alias("high"), (F.max(v) - F.min(v)).alias("range"), F.sum(v).alias("sum"),
    )


def ranged(df: DataFrame, by: str, order: str) -> DataFrame:
    """Rows in the order of ``by`` and ``order``, cut into ranges of like size that ``_part`` numbers: what ``running`` reads."""
    return cut(df.orderBy(by, order).withColumn("_part", F.spark_partition_id()))


def running(rows: DataFrame, by: str, order: str, value: Column, name: str, how: str = "sum", later: bool = False) -> DataFrame:
    """Adds the sum or least of ``value`` over the rows of a group up to this one, or from this one on. ``rows`` come from
    ``ranged``; no two rows of a group share ``order``. A task has one group's rows of one range, however large the
    group; what the ranges before it hold is added from a row for each range."""
    of, both = {"sum": (F.sum, lambda a, b: a + F.coalesce(b, F.lit(0))), "min": (F.min, F.least)}[how]
    direction = F.desc if later else F.asc
    ends = rows.groupBy(by, "_part").agg(of(value).alias("_end"))
    before = Window.partitionBy("_by").orderBy(direction("_at")).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(F.col(by).alias("_by"), F.col("_part").alias("_at"), "_end").withColumn("_far", of("_end").over(before)).drop("_end")
    own = rows.withColumn(name, of(value).over(Window.partitionBy(by, "_part").orderBy(direction(order))))
    joined = own.join(ends, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_part") == F.col("_at")))
    return joined.withColumn(name, both(F.col(name), F.col("_far"))).drop("_by", "_at", "_far")


def with_total(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """Adds the sum of ``value`` over a group."""
    sums = rows.groupBy(by).agg(F.sum(value).alias(name)).withColumnRenamed(by, "_by")
    return rows.join(sums, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def quartiles(df: DataFrame, by: str, value: str) -> DataFrame:
    """q1, median and q3 by the rule that leaves the median out of both halves where n is odd.

    Values are counted before they are ordered, so a group costs a row for each distinct value, not one for each row; they
    are ordered in ranges, so no task has to hold a group."""
    counts = df.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("_m"))
    counts = with_total(running(ranged(counts, by, value), by, value, F.col("_m"), "_upto"), by, "_m", "_n")
    n = F.max("_n")
    at = lambda k: F.min(F.when(F.col("_upto") >= k, F.col(value)))
    half = F.floor(F.col("_n") / 2)
    counts = counts.withColumns({"_a": half, "_b": F.col("_n") - half})
    lower = lambda k: (at(F.floor((k + 1) / 2)) + at(F.floor(k / 2) + 1)) / 2
    q1 = lower(F.col("_a"))
    q3 = (at(F.col("_b") + F.floor((F.col("_a") + 1) / 2)) + at(F.col("_b") + F.floor(F.col("_a") / 2) + 1)) / 2
    one = n == 1
    return counts.groupBy(by).agg(n.alias("n"), F.when(one, F.min(value)).otherwise(q1).alias("q1"), lower(F.col("_n")).alias("median"), F.when(one, F.max(value)).otherwise(q3).alias("q3"))


def sd_without_zeros(df: DataFrame, by: str, value: str) -> DataFrame:
    v = F.when(F.col(value) != 0, F.col(value))
    return df.groupBy(by).agg(F.count(v).alias("n"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("sd"))


def histogram(df: DataFrame, value: str, edges: list[float], by: str | None = None) -> DataFrame:
    """bin (number from 0), low, high and n: values from each edge up to the next, the last bin is open. Empty bins are
    left out; values below the first edge have no bin."""
    place = reduce(lambda acc, i: F.when(F.col(value) >= edges[i], i).otherwise(acc), range(len(edges)), F.lit(None).cast("int"))
    low = F.element_at(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin") + 1)
    high = F.get(F.array(*[F.lit(float(e)) for e in edges]), F.col("bin") + 1)
    keys = [by, "bin"] if by else ["bin"]
    return df.withColumn("bin", place).where("bin IS NOT NULL").groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).select(*keys, low.alias("low"), high.alias("high"), "n")


def cumulative_counts(df: DataFrame, value: str, cuts: list[float], by: str) -> DataFrame:
    """Rows below each cut, per group, in long form: cut, n."""
    rows = df.groupBy(by).agg(*[F.sum((F.col(value) < c).cast("long")).alias(f"_{i}") for i, c in enumerate(cuts)])
    pairs = ", ".join(f"cast({c!r} as double), `_{i}`" for i, c in enumerate(cuts))
    return rows.selectExpr(by, f"stack({len(cuts)}, {pairs}) as (cut, n)")


def table_order(column: str, kind: str = "number", ascending: bool = True) -> list[Column]:
    """Order of a table by a column: text without regard to case; ``de`` (p-values and fold changes) by absolute value,
    positive first, missing last either way; numbers with nulls first, or last when descending."""
    c = F.col(column)
    if kind == "text":
        low = F.lower(c)
        return [low.asc_nulls_first() if ascending else low.desc_nulls_last()]
    if kind == "de":
        return [F.abs(c).asc_nulls_last() if ascending else F.abs(c).desc_nulls_last(), c.desc_nulls_last()]
    return [c.asc_nulls_first() if ascending else c.desc_nulls_last()]


def sample_filter(df: DataFrame, conditions: list[Column], low: int = 20, high: int = 1000, otherwise: Column | None = None) -> DataFrame:
    """The rows of the first condition that leaves from ``low`` to ``high`` rows; without one, all rows of the condition
    ``otherwise``, or where that is not given, any ``high`` rows of the table. All conditions are counted in one pass."""
    counts = df.agg(*[F.sum(F.coalesce(c, F.lit(False)).cast("long")) for c in conditions]).first()
    for condition, n in zip(conditions, counts, strict=True):
        if low <= (n or 0) <= high:
            return df.where(condition)
    return df.limit(high) if otherwise is None else df.where(otherwise)


def menu(df: DataFrame, columns: list[str]) -> DataFrame:
    """kind, value, n: the distinct values of text columns, as a choice offers them, with their rows; in order of value. All
    columns are counted in one pass; a null value is a choice of its own."""
    pairs = ", ".join(f"'{c}', cast(`{c}` as string)" for c in columns)
    return df.selectExpr(f"stack({len(columns)}, {pairs}) as (kind, value)").groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).orderBy("kind", "value")


def added(table: DataFrame, more: DataFrame, key: list[str]) -> DataFrame:
    """The table and those rows of ``more`` whose key it lacks."""
    return table.unionByName(more.join(table.select(*key), key, "left_anti").dropDuplicates(key))


def without(table: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    return table.join(chosen.select(*key).distinct(), key, "left_anti")


def only(table: DataFrame, chosen: DataFrame, key: list[str]) -> DataFrame:
    return table.join(chosen.select(*key).distinct(), key, "left_semi")


def numbered_rows(df: DataFrame, *order: Column) -> DataFrame:
    """Rows with their place in an order, from 1. Rows are sorted into ranges in all tasks; a count per range gives the
    place where it starts, so no task sees the whole table."""
    placed = df.orderBy(*order).withColumn("_part", F.spark_partition_id())
    placed = cut(placed.withColumn("_in", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1))
    starts = placed.groupBy("_part").agg(F.max("_in").alias("_n"))
    starts = starts.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return placed.join(starts, "_part").withColumn("row", F.col("_start") + F.col("_in")).drop("_part", "_in", "_start")
