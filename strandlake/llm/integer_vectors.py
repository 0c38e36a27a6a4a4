"""Vectors of whole numbers: reading them, exact inner products, and the best of a block of scores.

Components are kept as doubles. Whole numbers are exact in doubles up to 2^53, and no partial sum of an inner product is
above the product of the two lengths, so doubles give exact scores below that; beyond it Python's own integers do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import written

#: A component x becomes floor(SCALE * x).
SCALE = 256
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: No score: below all others, and never returned.
NONE = np.iinfo(np.int64).min
#: Bytes of vectors in a block, which is what a task holds of a table at once.
BLOCK_BYTES = 16 << 20


def whole(rows: DataFrame, *more: str, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """vec_id (long), vector (doubles, all whole), length, and the columns ``more``, of rows that take part.

    A null id, a null vector, a null or non-finite component, a component whose scaled value is no double, and vectors of
    another length than the most frequent one (the longer of two as frequent) take no part. Rows that share an id are one
    row, the greatest in order of vector and ``more``, so repeated rows count once.
    """
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x * scale) == float("inf"))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"), *more)
    own = own.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", bad))
    most = own.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    own = own.where(F.size("vector") == (most["dim"] if most else 0))
    # floor() of Spark gives a long, so larger values, which are whole already, pass it by
    floor = lambda x: F.when(F.abs(x * scale) < EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale)
    one = own.groupBy("vec_id").agg(F.max(F.struct(F.transform("vector", floor).alias("vector"), *more)).alias("_r"))
    square = F.aggregate("_r.vector", F.lit(0.0), lambda a, x: a + x * x)
    return one.select("vec_id", "_r.vector", F.sqrt(square).alias("length"), *[f"_r.{c}" for c in more])


def dimension(rows: DataFrame) -> int:
    """Components of the vectors of ``whole`` rows; 0 for an empty table."""
    first = rows.select(F.size("vector")).first()
    return first[0] if first else 0


def in_blocks(rows: DataFrame, block_rows: int, name: str, *order: Column) -> DataFrame:
    """The rows in their order, cut into blocks of ``block_rows``, which the column ``block`` numbers from 0. Rows are
    dealt into ranges and sorted there; a block is where a row stands plus the rows of the ranges before its own, so it
    does not depend on how many ranges there are. Written, so that a lost executor does not deal anew."""
    n = rows.count()
    dealt = rows.repartitionByRange(max(1, -(-n // block_rows)), *order).sortWithinPartitions(*order)
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), name)
    placed = placed.withColumns({"_range": F.shiftright("_at", 33), "_at": F.col("_at").bitwiseAND((1 << 33) - 1)})
    before, starts = 0, []
    for r in placed.groupBy("_range").count().orderBy("_range").collect():  # a row per range
        starts.append((r["_range"], before))
        before += r["count"]
    ranges = F.broadcast(rows.sparkSession.createDataFrame(starts, "_range long, _before long"))  # two numbers per range
    return placed.join(ranges, "_range").withColumn("block", F.floor((F.col("_before") + F.col("_at")) / block_rows).cast("int")).drop("_range", "_at", "_before")


def rows_of(dim: int) -> int:
    """Vectors of that many components in a block."""
    return max(64, BLOCK_BYTES // (8 * max(1, dim)))


def stacked(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    """The vectors of an Arrow column as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten()).reshape(-1, dim)


def dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of the rows of two matrices of whole numbers, exact, as longs. A score that no long can hold
    comes out as the nearest that one can, above the mark for no score."""
    size = lambda m: float(np.sqrt((m * m).sum(1).max(initial=0)))
    if size(a) * size(b) < EXACT:
        return (a @ b.T).astype(np.int64)
    x, y = ([[int(v) for v in row] for row in m] for m in (a, b))
    return np.array([[min(MOST, max(LEAST + 2, sum(p * q for p, q in zip(u, v, strict=True)))) for v in y] for u in x], np.int64).reshape(len(a), len(b))


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k greatest scores of each row and the ids of their columns, greatest first, ties by smaller id; NONE where a
    row has fewer. ``ids`` ascend. ``scores`` is used up."""
    n = len(scores)
    top, own = np.full((n, k), NONE), np.full((n, k), -1, np.int64)
    rows = np.arange(n)
    for i in range(min(k, scores.shape[1])):
        at = scores.argmax(1)  # the first of equal ones
        top[:, i] = scores[rows, at]
        own[:, i] = ids[at]
        scores[rows, at] = NONE
    return top, own


def merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best of two lists for each row."""
    scores, ids = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
    order = np.lexsort((ids, -np.maximum(scores, NONE + 1)), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


def ratio(bound: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a candidate's length, as seen from a direction, has to reach so that its score with a vector of that length is
    the bound at least: minus infinity where any will do, infinity where none can."""
    with np.errstate(divide="ignore", invalid="ignore"):
        found = bound / length
    return np.where(length > 0, found, np.where(bound > 0, np.inf, -np.inf))
