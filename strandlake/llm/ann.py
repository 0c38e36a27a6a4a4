"""Approximate nearest neighbours by balanced posting lists.

Centroids come from hierarchical balanced clustering of a bounded sample and are held in memory with a graph of their
neighbours. Every vector is filed under its nearest centroids: vectors near a border lie in several lists. A query walks
the graph, takes the nearest lists until they hold enough vectors, keeps those within a ratio of the last one's distance,
and is scored against these lists only. Lists are packed into groups of bounded size, long lists over several, so no task gets an unbounded one.

The inner product is searched as a distance: each vector gets a last component that gives all the same length, and each
query, whose length does not change the order of its neighbours, is brought to that length too.

How far the ratio has to reach depends on the table: tight groups or lengths that vary ask for more lists. So it is measured:
a bounded number of queries is compared with all rows in one pass, and the ratio is the least that finds ``RECALL`` of
their true neighbours. These comparisons set the ratio only; results come from the lists.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.llm.common import written

#: At most about so many vectors are read to place the centroids: those with the smallest hashes of their ids.
SAMPLE = 20_000
#: At most so many centroids, which with their graph are the only data that all tasks hold.
MAX_LISTS = 4096
#: Vectors that a list is meant to hold, and that a group of lists may hold.
LIST_ROWS = 256
GROUP_ROWS = 1 << 15
#: A vector is filed under centroids up to (1 + REPLICATE) times as far as the nearest, REPLICAS at most.
REPLICATE, REPLICAS = 0.05, 4
#: Square of how near two lists' centroids may be, as a share of the vector's distance, for a vector to be in both.
APART = 0.25
#: A query reads lists whose centroid is up to (1 + PRUNE) times as far as the nearest that it needs for k others, or
#: further where the measured queries need it.
PRUNE = 0.15
#: At most so many queries, those with the smallest hashes, are measured, and the share of their neighbours to be found.
MEASURED, RECALL = 256, 0.98
#: Width of the walk over the graph, for filing and for queries.
WALK_FILE, WALK_QUERY = 24, 512
NEIGHBOURS = 16


@dataclass
class Index:
    """Centroids (with the extra component), their graph, the square of the greatest length and the dimension. Lengths
    are in units of ``unit``, the greatest component of the table, so that squares stay in range."""

    centroids: np.ndarray
    graph: np.ndarray
    top2: float
    dim: int
    unit: float = 1.0

    def walk(self, points: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroids that a best-first walk of that width finds for each point: numbers and squared
        distances, nearest first; missing ones have the number -1."""
        n, c = len(points), len(self.centroids)
        width = min(width, c)
        norms = (self.centroids**2).sum(1)
        own = (points**2).sum(1)
        seen = np.zeros((n, c), bool)
        ids = np.full((n, width), -1)
        dist = np.full((n, width), np.inf)
        spread = np.zeros((n, width), bool)
        rows = np.arange(n)
        entries = np.unique(np.linspace(0, c - 1, min(c, NEIGHBOURS)).astype(int))
        near = np.broadcast_to(entries, (n, len(entries)))
        live = rows
        while len(live):
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            d = own[live, None] + norms[near] - 2 * np.einsum("nd,nkd->nk", points[live], self.centroids[near])
            d = np.where(fresh, np.maximum(d, 0), np.inf)
            all_d = np.concatenate([dist[live], d], 1)
            all_i = np.concatenate([ids[live], near], 1)
            all_s = np.concatenate([spread[live], np.zeros_like(fresh)], 1)
            order = np.argsort(all_d, 1, kind="stable")[:, :width]
            dist[live], ids[live], spread[live] = (np.take_along_axis(x, order, 1) for x in (all_d, all_i, all_s))
            ready = ~spread[live] & np.isfinite(dist[live])
            some = ready.any(1)
            live, at = live[some], ready[some].argmax(1)
            spread[live, at] = True
            near = self.graph[ids[live, at]]
        return np.where(np.isfinite(dist), ids, -1), dist

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        """Vectors with their last component, all of the same length."""
        vectors = vectors / self.unit
        return np.concatenate([vectors, np.sqrt(np.maximum(self.top2 - (vectors**2).sum(1, keepdims=True), 0))], 1)

    def file(self, vectors: np.ndarray) -> Iterator[tuple[int, int]]:
        """(row, list) for each vector and each list that it goes to: its nearest, and others at a like distance that
        are not next to a list it already has."""
        ids, dist = self.walk(self.lift(vectors), WALK_FILE)
        for row, (own, d) in enumerate(zip(ids, dist, strict=True)):
            got = [own[0]]
            for c, x in zip(own[1:], d[1:], strict=True):
                if c < 0 or len(got) == REPLICAS or x > (1 + REPLICATE) ** 2 * d[0]:
                    break
                if all(((self.centroids[c] - self.centroids[g]) ** 2).sum() > APART * x for g in got):
                    got.append(c)
            yield from ((row, int(g)) for g in got)

    def aim(self, queries: np.ndarray) -> np.ndarray:
        """Queries as points among the lifted vectors: of their greatest length, with a last component of 0."""
        queries = queries / np.maximum(np.abs(queries).max(1, keepdims=True), np.finfo(float).tiny)
        queries = queries * (np.sqrt(self.top2) / np.maximum(np.linalg.norm(queries, axis=1, keepdims=True), np.finfo(float).tiny))
        return np.concatenate([queries, np.zeros((len(queries), 1))], 1)

    def needed(self, query: np.ndarray, held: list[list[int]], sizes: np.ndarray, least: int) -> list[float]:
        """For each of a query's neighbours, given by the lists that hold it, the ratio at which ``lists`` reads one."""
        point = self.aim(query[None])[0]
        d = np.maximum((point**2).sum() + (self.centroids**2).sum(1) - 2 * self.centroids @ point, 0)
        base = self._reach(order := np.argsort(d, kind="stable"), d[order], 0.0, sizes, least)
        if base is None:
            return [0.0] * len(held)
        return [float(np.sqrt(d[own].min() / base) - 1) if base else (np.inf if d[own].min() else 0.0) for own in held]

    def lists(self, queries: np.ndarray, prune: float, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """The lists that each query reads: in order of distance, those that hold ``least`` vectors together, and others
        up to (1 + prune) times as far as the last of these. ``sizes`` are the lists' numbers of vectors. Where a walk
        ends before that, all centroids are looked at."""
        points = self.aim(queries)
        ids, dist = self.walk(points, WALK_QUERY)
        norms = (self.centroids**2).sum(1)
        out = []
        for point, i, d in zip(points, ids, dist, strict=True):
            i, d = i[i >= 0], d[i >= 0]
            far = self._reach(i, d, prune, sizes, least)
            if len(i) < len(self.centroids) and (far is None or d[-1] <= far):
                d = np.maximum((point**2).sum() + norms - 2 * self.centroids @ point, 0)
                i = np.argsort(d, kind="stable")
                d = d[i]
                far = self._reach(i, d, prune, sizes, least)
            out.append(i if far is None else i[d <= far])
        return out

    @staticmethod
    def _reach(ids: np.ndarray, dist: np.ndarray, prune: float, sizes: np.ndarray, least: int) -> float | None:
        """The square of the distance up to which lists are read; None if these hold too few vectors."""
        held = np.cumsum(sizes[ids])
        last = int(np.searchsorted(held, least))
        return None if last == len(held) else (1 + prune) ** 2 * dist[last]


def balanced(points: np.ndarray, most: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Centroids of groups of at most ``most`` points: a group that is larger is split again. Neighbours stay in order."""
    if len(points) <= most:
        return [points.mean(0)]
    k = min(8, -(-len(points) // most))
    centres = points[rng.choice(len(points), k, replace=False)]
    for _ in range(8):
        d = (points**2).sum(1)[:, None] + (centres**2).sum(1) - 2 * points @ centres.T
        place = d.argmin(1)
        sizes = np.bincount(place, minlength=k)
        centres = np.array([points[place == j].mean(0) if sizes[j] else points[rng.integers(len(points))] for j in range(k)])
    if sizes.max() == len(points):
        return [points.mean(0)]  # points that no cut parts
    order = [0]
    while len(order) < k:  # centres in a chain, each next to a near one
        rest = [j for j in range(k) if j not in order]
        order.append(min(rest, key=lambda j: ((centres[j] - centres[order[-1]]) ** 2).sum()))
    return [c for j in order if sizes[j] for c in balanced(points[place == j], most, rng)]


def usable(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and vector (doubles) of rows that take part: an id, and a vector that is not null or zero and has no null
    or non-finite component. Vectors of another length than the most frequent one take no part either."""
    v = F.col("vector")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    own = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    own = own.where(F.col("vec_id").isNotNull() & v.isNotNull() & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    most = own.groupBy(F.size("vector").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return own.where(F.size("vector") == (most["dim"] if most else 0))


def fit(rows: DataFrame, sample: int = SAMPLE, list_rows: int = LIST_ROWS, seed: int = 7) -> Index | None:
    """Centroids and graph from a bounded sample of ``usable`` rows; None for an empty table."""
    n, unit = rows.agg(F.count(F.lit(1)), F.max(F.array_max(F.transform("vector", F.abs)))).first()
    if not n:
        return None
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + (x / F.lit(unit)) * (x / F.lit(unit)))
    top2 = rows.agg(F.max(square)).first()[0]
    some = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < F.lit(int((1 << 40) * min(1.0, sample / n)))) if n > sample else rows
    points = np.array([r.vector for r in some.orderBy("vec_id").select("vector").collect()])  # bounded by ``sample``
    if not len(points):
        points = np.array([rows.select("vector").first().vector])
    index = Index(points[:0], np.zeros((0, 0), int), float(top2), points.shape[1], float(unit))
    points = index.lift(points)
    lists = min(MAX_LISTS, max(1, n // list_rows))
    most = max(1, -(-len(points) // lists))
    centroids = np.array(balanced(points, most, np.random.default_rng(seed)))
    while len(centroids) > MAX_LISTS:  # groups that came out small: fewer and larger ones
        most += -(-most // 4)
        centroids = np.array(balanced(points, most, np.random.default_rng(seed)))
    k = min(NEIGHBOURS, len(centroids))
    norms = (centroids**2).sum(1)
    graph = np.empty((len(centroids), k + 2), int)
    for i in range(0, len(centroids), 512):
        d = norms[i : i + 512, None] + norms - 2 * centroids[i : i + 512] @ centroids.T
        graph[i : i + 512, :k] = np.argpartition(d, k - 1, 1)[:, :k]
    graph[:, k] = (np.arange(len(centroids)) + 1) % len(centroids)  # a ring, so that every centroid can be reached
    graph[:, k + 1] = np.random.default_rng(seed).permutation(len(centroids))
    for i, row in enumerate(graph):  # an arc that repeats leads back to its own centroid
        graph[i] = np.where(np.isin(np.arange(k + 2), np.unique(row, return_index=True)[1]), row, i)
    return Index(centroids, graph, float(top2), index.dim, float(unit))


def packed(sizes: dict[int, int], group_rows: int) -> tuple[dict[int, list[int]], int]:
    """For each list its groups, and the number of groups: short lists share a group, a long one is split over several.
    The driver holds a number per list, MAX_LISTS at most."""
    groups, n, room = {}, -1, 0
    for k in sorted(sizes):
        if sizes[k] > group_rows:
            parts = -(-sizes[k] // group_rows)
            groups[k] = list(range(n + 1, n + 1 + parts))
            n, room = n + parts, 0
        else:
            if sizes[k] > room:
                n, room = n + 1, group_rows
            room -= sizes[k]
            groups[k] = [n]
    return groups, n + 1


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """Where the scores are among the k greatest, ties and near ties with the last of them included."""
    if len(scores) <= k:
        return np.arange(len(scores))
    least = np.partition(scores, len(scores) - k)[len(scores) - k]
    return np.flatnonzero(scores >= least - 1e-9 * max(1.0, abs(least)))


def measured(rows: DataFrame, queries: DataFrame, postings: DataFrame, index: Index, sizes: np.ndarray, k: int, least: int, recall: float = RECALL) -> float:
    """The least ratio at which lists hold ``recall`` of the true neighbours of at most ``MEASURED`` queries; 0 without
    queries. One pass over ``rows``, of which each task keeps k for each of these queries."""
    few = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(MEASURED).select("vec_id", "vector").collect()
    if not few:
        return 0.0
    own = np.array([r.vec_id for r in few])
    points = np.array([r.vector for r in few])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros((len(own), 0), np.int64), np.zeros((len(own), 0))
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                new = np.asarray(part.column(0))
                s = points @ np.asarray(part.column(1).flatten()).reshape(-1, index.dim).T
                s[own[:, None] == new] = -np.inf
                scores = np.concatenate([scores, s], 1)
                ids = np.concatenate([ids, np.broadcast_to(new, s.shape)], 1)
                if scores.shape[1] > k:
                    top = np.argpartition(-scores, k - 1, 1)[:, :k]
                    ids, scores = np.take_along_axis(ids, top, 1), np.take_along_axis(scores, top, 1)
        at, col = np.nonzero(np.isfinite(scores))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(ids[at, col], pa.int64()), pa.array(scores[at, col], pa.float64())], names=["query", "vec_id", "score"])

    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    once = rows.select("vec_id", "vector").mapInArrow(nearest, "query int, vec_id long, score double").groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    true = once.withColumn("rank", rank).where(F.col("rank") <= k).select("query", "vec_id")
    found = postings.select("list", "vec_id").join(true, "vec_id").groupBy("query", "vec_id").agg(F.collect_set("list").alias("lists"))
    by: dict[int, list[list[int]]] = {}
    for r in found.collect():  # MEASURED * k rows at most
        by.setdefault(r.query, []).append(r.lists)
    ratios = np.sort([x for q, held in by.items() for x in index.needed(points[q], held, sizes, least)])
    return float(max(ratios[int(np.ceil(recall * len(ratios))) - 1], 0.0)) + 1e-9 if len(ratios) else 0.0


def search(rows: DataFrame, queries: DataFrame, k: int = 20, prune: float = PRUNE, index: Index | None = None, group_rows: int = GROUP_ROWS, recall: float = RECALL) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each query its k best rows by inner product, equal scores by smaller id.

    Lists are read up to the ratio ``prune``, or further where ``recall`` of the measured queries' neighbours need it.
    Both tables are ``usable`` rows; the rows with a query's own id are not its candidates. Rows that share an id count
    once, with their best score. Candidates that tie are ordered, not dropped. An empty table gives no rows. Pairs whose
    inner product is beyond the range of doubles have no score and are not returned.
    """
    spark = rows.sparkSession
    index = index or fit(rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")

    def stacked(batch: pa.RecordBatch) -> np.ndarray:
        return np.asarray(batch.column(1).flatten()).reshape(-1, index.dim)

    def filed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                got = list(index.file(stacked(part)))
                take = pa.array([r for r, _ in got], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([c for _, c in got], pa.int32()), part.column(0).take(take), part.column(1).take(take)], names=["list", "vec_id", "vector"])

    postings = written(rows.mapInArrow(filed, "list int, vec_id long, vector array<double>"), "postings")
    ids = postings.groupBy("list", "vec_id").agg(F.count(F.lit(1)).alias("n")).groupBy("list").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("ids"))
    filled = ids.collect()  # MAX_LISTS rows at most
    groups, _ = packed({r["list"]: r["n"] for r in filled}, group_rows)
    held = np.zeros(len(index.centroids), int)
    held[[r["list"] for r in filled]] = [r["ids"] for r in filled]
    least = REPLICAS * (k + 1)  # a vector is in REPLICAS lists at most, so these are k others and the query itself
    prune = max(prune, measured(rows, queries, postings, index, held, k, least, recall))

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 1024):
                part = batch.slice(i, 1024)
                at, to, read = [], [], []
                for row, lists in enumerate(index.lists(stacked(part), prune, held, least)):
                    by: dict[int, list[int]] = {}
                    for c in lists.tolist():
                        for g in groups.get(c, ()):
                            by.setdefault(g, []).append(c)
                    for g, own in by.items():
                        at.append(row)
                        to.append(g)
                        read.append(own)
                take = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), part.column(0).take(take), part.column(1).take(take), pa.array(read, pa.list_(pa.int32()))], names=["group", "query_id", "vector", "lists"])

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if left.num_rows and right.num_rows:
            order = np.argsort(right.column("list").to_numpy(), kind="stable")
            where, ids = right.column("list").to_numpy()[order], right.column("vec_id").to_numpy()[order]
            vectors = np.asarray(right.column("vector").combine_chunks().flatten()).reshape(-1, index.dim)[order]
            asked_by: dict[int, list[int]] = {}
            for i, lists in enumerate(left.column("lists").to_pylist()):
                for c in lists:
                    asked_by.setdefault(c, []).append(i)
            own_ids = left.column("query_id").to_numpy()
            points = np.asarray(left.column("vector").combine_chunks().flatten()).reshape(-1, index.dim)
            found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
            for c, who in sorted(asked_by.items()):
                a, b = np.searchsorted(where, [c, c + 1])
                for i in range(0, len(who), 256):
                    scores = points[who[i : i + 256]] @ vectors[a:b].T
                    for q, s in zip(who[i : i + 256], scores, strict=True):
                        s[ids[a:b] == own_ids[q]] = -np.inf
                        best = _best(s, k)
                        best = best[np.isfinite(s[best])]
                        exact = (vectors[a:b][best] * points[q]).sum(1)  # the same sum wherever a vector lies
                        top = np.lexsort((ids[a:b][best], -exact))[:k]
                        found.setdefault(q, []).append((ids[a:b][best][top], exact[top]))
            for q, parts in found.items():
                v, s = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.lexsort((v, -s))
                v, s = v[order], s[order]
                _, once = np.unique(v, return_index=True)
                once = np.sort(once)[:k]
                out_q += [own_ids[q]] * len(once)
                out_v += v[once].tolist()
                out_s += s[once].tolist()
        return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.float64())})

    places = spark.createDataFrame([(c, g) for c, g in groups.items()], "list int, places array<int>")  # a row per list
    dealt = postings.join(places, "list").withColumn("group", F.element_at("places", (F.pmod(F.xxhash64("vec_id"), F.size("places")) + 1).cast("int"))).drop("places")
    asking = queries.mapInArrow(asked, "group int, query_id long, vector array<double>, lists array<int>")
    found = asking.groupBy("group").cogroup(dealt.groupBy("group")).applyInArrow(score, "query_id long, vec_id long, score double")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
