"""Exact search for the greatest inner products, by descending length.

Vectors are dealt into blocks in order of length. A query's k-th best score among the longest vectors tells how long a
vector has to be to matter, so a query meets only the first blocks, and with queries in order of that need, a block meets
only the first blocks of queries. Within a pair of blocks the walk goes on by descending length; vectors are rotated so
that their first components hold most of their length (the singular vectors of the table), and a sum over these plus the
product of the lengths of the rest (Cauchy-Schwarz) rules most pairs out before exact whole-number scores are taken.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.integer_vectors import EXACT, NONE, best_of, dimension, dots, in_blocks, merged, ratio, rows_of, stacked
from strandlake.llm.common import handed_back, written

#: The longest vectors, which give each query its first bound.
HEAD = 1024
#: Queries in a block, and vectors that a walk takes at once.
QUERY_ROWS, STEP = 1024, 2048
#: Shares of the rotated components in the first and second partial sum.
PARTIAL = (0.25, 0.5)
#: Bounds are doubles; they count as met within this share.
SLACK = 1e-9
#: Numbers gathered at once for pairs that are scored one by one, and the share of pairs up to which they are.
GATHER, SPARSE = 1 << 21, 0.1


def rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """The right singular vectors of all vectors, scaled to one length, greatest first. Each task sums its outer products;
    the driver gets their sum, dim x dim numbers."""

    def outer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            v = stacked(batch.column(0), dim)
            size = np.sqrt((v * v).sum(1, keepdims=True))
            v = v[np.isfinite(size[:, 0]) & (size[:, 0] > 0)] / size[np.isfinite(size) & (size > 0)][:, None]
            total += v.T @ v
        for i in range(dim):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(dim, i), pa.int32()), pa.array(np.arange(dim), pa.int32()), pa.array(total[i])], names=["i", "j", "x"])

    sums = rows.select("vector").mapInArrow(outer, "i int, j int, x double").groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    gram = np.zeros((dim, dim))
    for r in sums:
        gram[r.i, r.j] = r.x
    return np.linalg.eigh(gram)[1][:, ::-1] if dim else gram


def walk(points: np.ndarray, own: np.ndarray, least: np.ndarray, vectors: np.ndarray, ids: np.ndarray, turn: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores and ids of each point in a block of vectors, which come by descending length; only scores that
    reach ``least`` have to be found. A point's own id is no candidate."""
    dim = turn.shape[0]
    cuts = [max(1, int(dim * p)) for p in PARTIAL] if dim else [0, 0]
    with np.errstate(over="ignore", invalid="ignore"):
        lq, lv = (np.sqrt((m * m).sum(1)) for m in (points, vectors))
        rq, rv = points @ turn, vectors @ turn
        tail = [[np.sqrt((m[:, c:] ** 2).sum(1)) for m in (rq, rv)] for c in cuts]
    exact = lq.max(initial=0) * lv.max(initial=0) < EXACT
    found = np.full((len(points), k), NONE), np.full((len(points), k), -1, np.int64)
    bound = least.copy()
    for a in range(0, len(vectors), STEP):
        live = np.flatnonzero(~(ratio(bound, lq) > lv[a] * (1 + SLACK)))  # a bound that is no number keeps its point
        if not len(live):
            break
        cols = a + np.argsort(ids[a : a + STEP], kind="stable")
        with np.errstate(over="ignore", invalid="ignore"):
            aim = bound[live, None] - SLACK * lq[live, None] * lv[cols]
            part = rq[live, : cuts[0]] @ rv[cols, : cuts[0]].T
            keep = ~(part + tail[0][0][live, None] * tail[0][1][cols] < aim)
        scores = np.full(keep.shape, NONE)
        if exact and keep.mean() < SPARSE:
            i, j = np.nonzero(keep)
            for s in range(0, len(i), max(1, GATHER // max(1, dim))):
                x, y = (w[s : s + max(1, GATHER // max(1, dim))] for w in (i, j))
                more = (rq[live[x], cuts[0] : cuts[1]] * rv[cols[y], cuts[0] : cuts[1]]).sum(1)
                on = ~(part[x, y] + more + tail[1][0][live[x]] * tail[1][1][cols[y]] < aim[x, y])
                x, y = x[on], y[on]
                scores[x, y] = (points[live[x]] * vectors[cols[y]]).sum(1).astype(np.int64)
        else:
            x, y = np.flatnonzero(keep.any(1)), np.flatnonzero(keep.any(0))
            at = np.ix_(x, y)
            scores[at] = np.where(keep[at], dots(points[live[x]], vectors[cols[y]]), NONE)
        scores[own[live, None] == ids[cols]] = NONE
        rows = np.flatnonzero((scores > NONE).any(1))
        if len(rows):
            who = live[rows]
            top = merged((found[0][who], found[1][who]), best_of(scores[rows], ids[cols], k), k)
            found[0][who], found[1][who] = top
            last = top[0][:, -1]
            bound[who] = np.where(last > NONE, np.maximum(bound[who], last), bound[who])
    return found


def search(rows: DataFrame, queries: DataFrame, k: int = 5, query_rows: int = QUERY_ROWS, block_rows: int | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score (long): for each query its k rows of greatest inner product (all, if fewer),
    equal scores by smaller id.

    Both tables are rows of ``integer_vectors.whole``; of the candidates only the row with the query's own id is left out.
    Zero vectors take part and score 0. An empty table of rows or queries gives none.
    """
    spark, dim = rows.sparkSession, dimension(rows)
    block_rows = block_rows or rows_of(dim)
    vectors = in_blocks(rows.select("vec_id", "length", "vector"), block_rows, "by-length", F.desc("length"), F.asc("vec_id"))
    tops = {r["block"]: r["top"] for r in vectors.groupBy("block").agg(F.max("length").alias("top")).collect()}  # a number per block
    blocks = np.array(sorted(tops), np.int64)
    reach_of = np.array([tops[b] for b in blocks.tolist()])
    turn = rotation(vectors, dim)
    head = vectors.orderBy(F.desc("length"), "vec_id").limit(HEAD).select("vec_id", "vector").orderBy("vec_id").collect()
    head_ids, head_vectors = np.array([r.vec_id for r in head], np.int64), np.array([r.vector for r in head]).reshape(len(head), dim)

    def aimed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                own, length, points = part.column(0).to_numpy(), part.column(1).to_numpy(), stacked(part.column(2), dim)
                scores = dots(points, head_vectors)
                scores[own[:, None] == head_ids] = NONE
                last = best_of(scores, head_ids, k)[0][:, -1]
                least = np.where(last > NONE, last.astype(float), -np.inf)
                need = ratio(least, length)
                reach = [int(blocks[at[-1]]) + 1 if len(at := np.flatnonzero(~(x > reach_of * (1 + SLACK)))) else 0 for x in need]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(least), pa.array(reach, pa.int32())], names=["query_id", "vector", "least", "reach"])

    asked = queries.select("vec_id", "length", "vector").mapInArrow(aimed, "query_id long, vector array<double>, least double, reach int")
    asked = in_blocks(written(asked, "aimed").where("reach > 0"), query_rows, "by-need", F.desc("reach"), F.asc("query_id")).withColumnRenamed("block", "part")
    parts = asked.groupBy("part").agg(F.max("reach").alias("reach")).collect()  # a number per block of queries
    met = [(int(b), [int(r["part"]) for r in parts if r["reach"] > b]) for b in blocks]
    readers = spark.createDataFrame(met, "block int, parts array<int>")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 3
        if left.num_rows and right.num_rows:
            order = np.argsort(-right.column("length").to_numpy(), kind="stable")
            own = left.column("query_id").to_numpy()
            scores, ids = walk(stacked(left.column("vector"), dim), own, left.column("least").to_numpy(), stacked(right.column("vector"), dim)[order], right.column("vec_id").to_numpy()[order], turn, k)
            at = scores > NONE
            out = [np.repeat(own, at.sum(1)), ids[at], scores[at]]
        handed_back()
        return pa.table(dict(zip(("query_id", "vec_id", "score"), out, strict=True)))

    left = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("reach") - 1)))
    right = vectors.join(readers, "block").withColumn("part", F.explode("parts")).drop("parts")
    found = left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInArrow(score, "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
