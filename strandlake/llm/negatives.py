"""Hard negatives by lists that the anchors of a cluster share.

Anchors are clustered by direction. For a cluster, a vector's score with any member of length 1 is at most its own length
times the cosine of its angle to the centre less the widest angle of a member: each cluster's candidates are sorted by
that bound once, and every member walks the same list until what is left cannot change its result. A first walk finds
positives among the rows of a label, a second one the negatives within each positive's window.

A cluster that is large is cut into several, its list into slices; each task has one cluster and one slice. Candidates
that are below what every member needs are left out of the list before it is dealt.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import handed_back, written
from strandlake.llm.integer_vectors import LEAST, MOST, NONE, best_of, dimension, dots, in_blocks, merged, ratio, rows_of, stacked, whole

#: Anchors in a cluster, entries of a list that a walk takes at once.
MEMBERS, STEP = 256, 1024
#: Anchors that place the centres, and rows that give a first bound, at most about so many: those of the smallest hashes.
SAMPLE, SEED_ROWS = 8192, 1024
#: Bounds are doubles: an angle counts as so much smaller, a length as so much greater.
ANGLE_SLACK, SLACK = 1e-7, 1e-9
#: Rows of a list that are handed on at once.
ROUTED = 4096
#: A row counts as a negative from so many percent of the positive's score.
PERCENT = 80


def directions(vectors: np.ndarray) -> np.ndarray:
    """The vectors at length 1; those of no length, or of one that is no number, are 0."""
    with np.errstate(all="ignore"):
        size = np.sqrt((vectors * vectors).sum(1, keepdims=True))
        out = vectors / size
    return np.where(np.isfinite(size) & (size > 0), out, 0.0)


def centres(anchors: DataFrame, dim: int, members: int, seed: int = 7) -> np.ndarray:
    """Directions of clusters of about ``members`` anchors, from a bounded sample of them. Results do not depend on them."""
    n = anchors.count()
    some = anchors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").collect()
    points = directions(np.array([r.vector for r in some]).reshape(len(some), dim))
    points = points[(points != 0).any(1)]
    k = min(len(points), max(1, n // members))
    if not k:
        return np.eye(1, dim)
    rng = np.random.default_rng(seed)
    found = points[rng.choice(len(points), k, replace=False)]
    for _ in range(8):
        place = (points @ found.T).argmax(1)
        sums = np.zeros_like(found)
        np.add.at(sums, place, points)
        size = np.sqrt((sums * sums).sum(1))
        found = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], found)
    return found


def bounds(vectors: np.ndarray, middle: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For each vector and cone, what the score with a vector of length 1 inside that cone is at most."""
    with np.errstate(all="ignore"):
        size = np.sqrt((vectors * vectors).sum(1, keepdims=True))
        angle = np.arccos(np.clip(directions(vectors) @ middle.T, -1, 1))
        found = size * np.cos(np.maximum(0, angle - width - ANGLE_SLACK)) + SLACK * size
    return np.nan_to_num(np.where(np.isfinite(size), found, np.inf), nan=np.inf)


def allowed(scores: np.ndarray, floor: np.ndarray, cap: np.ndarray, own: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The scores within each row's window, with NONE in place of others and of the row's own id."""
    return np.where((scores >= floor[:, None]) & (scores <= cap[:, None]) & (own[:, None] != ids), scores, NONE)


def walk(points: np.ndarray, own: np.ndarray, floor: np.ndarray, cap: np.ndarray, least: np.ndarray, vectors: np.ndarray, reach: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best scores within each member's window, and their ids. ``reach`` are the list's bounds. A member leaves the
    walk when the bound of the next entry, times its length, is below the score that it needs."""
    order = np.lexsort((ids, -reach))  # the list, sorted once for all members
    with np.errstate(over="ignore"):
        length = np.sqrt((points * points).sum(1))
    found = np.full((len(points), k), NONE), np.full((len(points), k), -1, np.int64)
    need = least.copy()
    live = np.arange(len(points))
    for a in range(0, len(order), STEP):
        live = live[~(ratio(need[live], length[live]) > reach[order[a]])]
        if not len(live):
            break
        cols = order[a : a + STEP]
        cols = cols[np.argsort(ids[cols], kind="stable")]
        _, first, copy = np.unique(own[live], return_index=True, return_inverse=True)  # windows of one anchor share its scores
        scores = allowed(dots(points[live[first]], vectors[cols])[copy], floor[live], cap[live], own[live], ids[cols])
        some = np.flatnonzero((scores > NONE).any(1))
        if len(some):
            who = live[some]
            top = merged((found[0][who], found[1][who]), best_of(scores[some], ids[cols], k), k)
            found[0][who], found[1][who] = top
            last = top[0][:, -1]
            need[who] = np.where(last > NONE, np.maximum(need[who], last), need[who])
    return found


def shared_lists(rows: DataFrame, asks: DataFrame, same: bool, k: int, members: int = MEMBERS, slice_rows: int | None = None) -> DataFrame:
    """anchor_id, tag, vec_id, score: for each ask its k best rows of the same label (or of any other one) with a score from
    ``floor`` to ``cap``. ``asks`` has anchor_id, tag, label, vector, floor and cap; ``rows`` vec_id, label and vector. An
    anchor may ask several times with other tags. Its own row is no candidate."""
    spark, dim = rows.sparkSession, dimension(rows)
    slices = max(1, -(-rows.count() // (slice_rows or rows_of(dim))))
    middle = centres(asks.select(F.col("anchor_id").alias("vec_id"), "vector").dropDuplicates(["vec_id"]), dim, members)
    seeds = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SEED_ROWS).orderBy("vec_id").collect()
    seed_ids, seed_labels = np.array([r.vec_id for r in seeds], np.int64), np.array([r.label for r in seeds], object)
    seed_vectors = np.array([r.vector for r in seeds]).reshape(len(seeds), dim)

    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 1024):
                part = batch.slice(s, 1024)
                own, label = part.column(0).to_numpy(), np.array(part.column(2).to_pylist(), object)
                points, floor, cap = stacked(part.column(3), dim), part.column(4).to_numpy(), part.column(5).to_numpy()
                cosine = np.clip(directions(points) @ middle.T, -1, 1)
                scores = allowed(dots(points, seed_vectors), floor, cap, own, seed_ids)
                scores[(label[:, None] == seed_labels) != same] = NONE
                last = best_of(scores, seed_ids, k)[0][:, -1]
                least = np.maximum(last, floor).astype(float)
                least = np.where((last == NONE) & (floor == LEAST), -np.inf, least)
                with np.errstate(over="ignore"):
                    need = ratio(least, np.sqrt((points * points).sum(1)))
                flat = (directions(points) == 0).all(1)  # no direction: a cluster of their own, as wide as can be
                at = np.where(flat, -1, cosine.argmax(1))
                angle = np.where(flat, np.pi, np.arccos(cosine.max(1)))
                columns = [*batch.slice(s, 1024).columns, pa.array(at, pa.int32()), pa.array(angle), pa.array(least), pa.array(need)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor_id", "tag", "label", "vector", "floor", "cap", "centre", "angle", "least", "need"])

    own_schema = "anchor_id long, tag long, label string, vector array<double>, floor long, cap long"
    where = asks.select("anchor_id", "tag", "label", "vector", "floor", "cap").mapInArrow(placed, f"{own_schema}, centre int, angle double, least double, need double")
    cut = in_blocks(written(where, "placed"), members, "members", F.col("label"), F.col("centre"), F.col("angle"), F.col("anchor_id"), F.col("tag"))
    key = ["block", "label", "centre"]
    table = cut.groupBy(*key).agg(F.max("angle").alias("width"), F.min("need").alias("need")).orderBy(*key).collect()  # a row per cluster
    numbers = spark.createDataFrame([(i, r.block, r.label, r.centre) for i, r in enumerate(table)], "part int, block int, label string, centre int")
    member = cut.join(numbers, key).drop(*key, "angle", "need")
    codes = {x: i for i, x in enumerate(sorted({r.label for r in table}))}
    part_code = np.array([codes[r.label] for r in table], np.int64)
    part_middle = middle[[max(0, r.centre) for r in table]] if table else np.zeros((0, dim))
    part_width, part_need = (np.array([r[c] for r in table], float) for c in ("width", "need"))

    def routed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in range(0, batch.num_rows, 256):
                block = batch.slice(s, 256)
                code = np.array([codes.get(x, -1) for x in block.column(1).to_pylist()])
                vectors = stacked(block.column(2), dim)
                for p in range(0, len(table), 4096):
                    on = slice(p, p + 4096)
                    got = bounds(vectors, part_middle[on], part_width[on])
                    i, j = np.nonzero(((code[:, None] == part_code[on]) == same) & ~(got < part_need[on]))
                    for t in range(0, len(i), ROUTED):
                        x, y = i[t : t + ROUTED], j[t : t + ROUTED]
                        take = pa.array(x)
                        columns = [pa.array(y + p, pa.int32()), block.column(3).take(take), block.column(0).take(take), block.column(2).take(take), pa.array(got[x, y])]
                        yield pa.RecordBatch.from_arrays(columns, names=["part", "slice", "vec_id", "vector", "reach"])

    own = rows.select("vec_id", "label", "vector", F.pmod(F.xxhash64("vec_id"), F.lit(slices)).cast("int").alias("slice"))
    lists = written(own.mapInArrow(routed, "part int, slice int, vec_id long, vector array<double>, reach double"), "lists")

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)] * 4
        if left.num_rows and right.num_rows:
            anchors, tags, floor, cap, least = (left.column(c).to_numpy() for c in ("anchor_id", "tag", "floor", "cap", "least"))
            scores, ids = walk(stacked(left.column("vector"), dim), anchors, floor, cap, least, stacked(right.column("vector"), dim), right.column("reach").to_numpy(), right.column("vec_id").to_numpy(), k)
            at = scores > NONE
            out = [np.repeat(anchors, at.sum(1)), np.repeat(tags, at.sum(1)), ids[at], scores[at]]
        handed_back()
        return pa.table(dict(zip(("anchor_id", "tag", "vec_id", "score"), out, strict=True)))

    pairs = lists.select("part", F.col("slice").alias("of_slice")).distinct()
    asking = member.withColumnRenamed("part", "of_part").join(pairs, F.col("of_part") == F.col("part")).drop("part")
    found = asking.groupBy("of_part", "of_slice").cogroup(lists.groupBy("part", "slice")).applyInArrow(score, "anchor_id long, tag long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("anchor_id", "tag").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k)


def labelled(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, label (string) and vector of rows that take part, as ``integer_vectors.whole`` has them; a null label takes
    no part."""
    own = rows.where(F.col(label_col).isNotNull()).select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("embedding"), F.col(label_col).cast("string").alias("label"))
    return written(whole(own, "label").select("vec_id", "label", "vector"), "labelled")


def mine(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, percent: int = PERCENT, members: int = MEMBERS, slice_rows: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Both tables are ``labelled`` rows. An anchor's positives are its first other rows of its label by score, then smaller
    id. For each of them, the negatives are the first rows of other labels, in the same order, with a score of at least
    ``percent`` of the positive's and at most that; a positive below 0 has none. Fewer rows than asked for give all there
    are; an anchor without positives, or an empty table, gives no rows.
    """
    every = anchors.select(F.col("vec_id").alias("anchor_id"), F.lit(0).cast("long").alias("tag"), "label", "vector", F.lit(LEAST).alias("floor"), F.lit(MOST).alias("cap"))
    near = shared_lists(rows, every, True, positives, members, slice_rows)
    near = written(near.select("anchor_id", F.col("vec_id").alias("tag"), F.col("score").alias("cap")), "positives")
    # the least whole number that is percent of the score: exact in decimals, where longs may run over
    floor = F.ceil(F.col("cap").cast("decimal(20,0)") * percent / 100).cast("long")
    asks = near.withColumn("floor", floor).where("floor <= cap").join(anchors.select(F.col("vec_id").alias("anchor_id"), "label", "vector"), "anchor_id")
    found = shared_lists(rows, written(asks, "asks"), False, negatives, members * max(1, positives), slice_rows)
    rows_ = found.withColumnsRenamed({"tag": "positive_id", "vec_id": "negative_id", "score": "negative_score"})
    return rows_.join(near.withColumnsRenamed({"tag": "positive_id", "cap": "positive_score"}), ["anchor_id", "positive_id"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
