"""Clusters of sequences from pairs: reciprocal best hits, complete linkage, cliques, shared hits, and their summaries."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.operators.pairs import best_mates
from strandlake.operators.stats import numbered_rows
from strandlake.plans.lineage import cut

#: Default thresholds.
COVERAGE, SIMILARITY, HIT_COVERAGE, HIT_SIMILARITY, GOOD_PCC = 40, 60, 20, 20, 0.8


def edge_filter(pairs: DataFrame, sim: float = SIMILARITY, cov: float = COVERAGE, how: str = "both", rounded: bool = True) -> DataFrame:
    """Pairs of enough similarity whose coverage is enough on both sides or either; values are rounded to whole numbers
    or cut off before they are compared."""
    whole = lambda c: F.floor(F.col(c) + (0.5 if rounded else 0.0))
    a, b = whole("cov1") >= cov, whole("cov2") >= cov
    return pairs.where((whole("sim") >= sim) & ((a & b) if how == "both" else (a | b)))


def reciprocal_best(pairs: DataFrame, sim: float = 0, cov: float = 0, how: str = "both", flag: str | None = None) -> DataFrame:
    """seq1, seq2 of pairs from two datasets that are each other's best mate there, of those with enough similarity and
    coverage (on both sides or either). Similarity is rounded to whole numbers before it is compared. ``flag`` names a column
    that has to be 2: the pair is each side's first in its search. A pair without a similarity above 0 is none."""
    rows = pairs.where("sim > 0") if flag is None else pairs.where((F.col("sim") > 0) & (F.col(flag) == 2))
    rows = edge_filter(rows, sim, cov, how) if sim > 0 or cov > 0 else rows
    best = best_mates(rows.withColumn("sim", F.floor(F.col("sim") + 0.5))).select("seq", "mate")
    ways = best.groupBy(F.least("seq", "mate").alias("seq1"), F.greatest("seq", "mate").alias("seq2"))
    return ways.agg(F.max(F.col("seq") < F.col("mate")).alias("_there"), F.max(F.col("seq") > F.col("mate")).alias("_back")).where("_there AND _back").select("seq1", "seq2")


def components(edges: DataFrame, most: int = 60) -> DataFrame:
    """node and component (its smallest node) over edges seq1, seq2: each round takes the least label of the neighbours,
    then the label of that label. Its joins are merge joins by hint, so that no round broadcasts labels through the driver."""
    both = cut(edges.select(F.col("seq1").alias("node"), F.col("seq2").alias("near")).unionByName(edges.select(F.col("seq2").alias("node"), F.col("seq1").alias("near"))).distinct())
    labels = cut(both.groupBy("node").agg(F.least(F.min("node"), F.min("near")).alias("component")))
    for _ in range(most):
        least = both.join(labels.withColumnRenamed("node", "near").hint("merge"), "near").groupBy("node").agg(F.min("component").alias("_l"))
        low = labels.join(least.hint("merge"), "node").select("node", F.col("component").alias("_old"), F.least("component", "_l").alias("_low"))
        jump = labels.select(F.col("node").alias("_low"), F.col("component").alias("_far"))
        new = cut(low.join(jump.hint("merge"), "_low", "left").select("node", "_old", F.least("_low", F.coalesce("_far", "_low")).alias("component")))
        labels = new.select("node", "component")
        if not new.where("_old <> component").head(1):
            return labels
    raise ValueError("components have not settled")


def mutual_sets(best: DataFrame, n: int) -> DataFrame:
    """cluster (its smallest member), seq of sets of n sequences that are all best mates of one another and of none else:
    n sequences that each have the same n - 1 mates, counting themselves. Repeated pairs count once, loops do not.

    A sequence and its mates as one array is the set's key, so there are no rounds, however long the chains of mates are; only
    the sets found are written to a checkpoint."""
    pairs = best.where("seq1 <> seq2")
    ways = pairs.select(F.explode(F.array(F.struct(F.col("seq1").alias("seq"), F.col("seq2").alias("mate")), F.struct(F.col("seq2").alias("seq"), F.col("seq1").alias("mate")))).alias("_w")).select("_w.*")
    sets = ways.groupBy("seq").agg(F.collect_set("mate").alias("_m")).where(F.size("_m") == n - 1).select(F.sort_array(F.concat("_m", F.array("seq"))).alias("_all"))
    full = cut(sets.groupBy("_all").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == n))
    return full.select(F.col("_all")[0].alias("cluster"), F.explode("_all").alias("seq"))


def complete_linkage(edges: DataFrame) -> DataFrame:
    """cluster (its smallest member's name), seq. Edges are taken in order (best, e-value, bits, names); two clusters are
    merged only if every pair between them is an edge. Clusters of one sequence are left out; loops and further edges of
    a pair do not count.

    Works in rounds: of the pairs of clusters that have all their edges, those are merged whose first edge comes before
    all others of both clusters. A pair that lacks an edge lacks it for good, and no merge puts an earlier edge before
    such a pair, so the result is that of one edge after the other."""
    place = F.struct(*[c.alias(n) for n, c in {"best": -F.col("best"), "evalue": F.col("evalue"), "bits": -F.col("bits"), "seq1": F.col("seq1"), "seq2": F.col("seq2")}.items()])
    pairs = edges.where("seq1 <> seq2").select(F.least("seq1", "seq2").alias("c1"), F.greatest("seq1", "seq2").alias("c2"), place.alias("first"))
    pairs = cut(pairs.groupBy("c1", "c2").agg(F.min("first").alias("first")))
    labels = pairs.select(F.col("c1").alias("seq")).union(pairs.select("c2")).distinct().withColumn("cluster", F.col("seq"))
    while pairs.head(1):
        ends = pairs.select(F.explode(F.array("c1", "c2")).alias("c"), "first")
        least = ends.groupBy("c").agg(F.min("first").alias("first"))
        chosen = pairs.join(least.withColumnRenamed("c", "c1"), ["c1", "first"]).join(least.withColumnRenamed("c", "c2"), ["c2", "first"])
        moves = cut(chosen.select(F.explode(F.array("c1", "c2")).alias("c"), F.col("c1").alias("to")))
        labels = cut(labels.join(moves.select(F.col("c").alias("cluster"), "to"), "cluster", "left").select("seq", F.coalesce("to", "cluster").alias("cluster")))
        for i in "12":
            pairs = pairs.join(moves.withColumnRenamed("c", f"c{i}"), f"c{i}", "left")
            pairs = pairs.withColumns({f"c{i}": F.coalesce("to", f"c{i}"), f"n{i}": F.when(F.col("to").isNull(), 1).otherwise(2)}).drop("to")
        same = pairs.where("c1 <> c2").groupBy(F.least("c1", "c2").alias("a"), F.greatest("c1", "c2").alias("b"))
        sums = same.agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("_n"), F.max(F.col("n1") * F.col("n2")).alias("_parts"))
        pairs = cut(sums.where("_n = _parts").select(F.col("a").alias("c1"), F.col("b").alias("c2"), "first"))  # those with all edges
    whole = labels.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("cluster")
    return labels.join(whole, "cluster").select(F.col("cluster").cast("string").alias("cluster"), "seq")


def _largest(near: dict, nodes: set) -> list:
    """The members, in order, of the largest clique of ``nodes``; of equally large ones the first by members."""
    best: list = []
    stack = [((), frozenset(nodes), frozenset())]
    while stack:
        chosen, open_, shut = stack.pop()
        if len(chosen) + len(open_) < len(best):
            continue
        if not open_ and not shut:
            key = sorted(chosen)
            if len(key) > len(best) or (len(key) == len(best) and key < best):
                best = key
            continue
        pivot = max(open_ | shut, key=lambda x: len(near[x] & open_))
        for x in sorted(open_ - near[pivot], reverse=True):
            stack.append(((*chosen, x), open_ & near[x], shut & near[x]))
            open_, shut = open_ - {x}, shut | {x}
    return best


def _egos(edges: DataFrame) -> DataFrame:
    """a, nodes, links: for each sequence its mates of higher degree (ties: of greater name), and the pairs among these.
    There are never more of them than the square root of twice the number of all pairs."""
    degree = edges.select(F.explode(F.array("seq1", "seq2")).alias("seq")).groupBy("seq").agg(F.count(F.lit(1)).alias("d"))
    for i in (1, 2):
        edges = edges.join(degree.select(F.col("seq").alias(f"seq{i}"), F.col("d").alias(f"d{i}")), f"seq{i}")
    up = F.struct("d1", "seq1") < F.struct("d2", "seq2")
    out = cut(edges.select(F.when(up, F.col("seq1")).otherwise(F.col("seq2")).alias("a"), F.when(up, F.col("seq2")).otherwise(F.col("seq1")).alias("b")))
    onward = out.select(F.col("a").alias("b"), F.col("b").alias("c"))
    corner = out.join(onward, "b").join(out.select("a", F.col("b").alias("c")), ["a", "c"])
    links = corner.groupBy("a").agg(F.collect_list(F.struct("b", "c")).alias("links"))
    return out.groupBy("a").agg(F.collect_list("b").alias("nodes")).join(links, "a", "left")


def cliques(edges: DataFrame) -> DataFrame:
    """cluster (its first member), seq of disjoint cliques of two or more: the largest comes first (then by members); those
    that meet it lose the members it has. Repeated edges count once; an edge with itself or with null is none.

    A clique is found at its member of lowest degree, among that one's mates of higher degree, so that a task holds such a
    neighbourhood and never a component. Each round takes every clique that is the best one of all its members, which
    gives what taking one after the other gives; there are as many rounds as the longest chain of cliques that each wait
    for the next."""
    kind = dict(edges.dtypes)["seq1"]
    left = edges.where("seq1 <> seq2").select(F.least("seq1", "seq2").alias("seq1"), F.greatest("seq1", "seq2").alias("seq2"))
    left = cut(left.distinct())
    taken: list[DataFrame] = []

    def best(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for a, nodes, links in zip(frame["a"].tolist(), frame["nodes"], frame["links"], strict=True):
                near: dict = {x: set() for x in nodes.tolist()}
                for link in links if links is not None else ():
                    near[link["b"]].add(link["c"])
                    near[link["c"]].add(link["b"])
                found = {x: sorted([a, x, *_largest({y: near[y] & near[x] for y in near[x]}, near[x])]) for x in near}
                found[a] = min(found.values(), key=lambda m: (-len(m), m))
                rows += [(x, -len(m), m) for x, m in found.items()]
            yield pd.DataFrame(rows, columns=["seq", "less", "members"])

    while left.head(1):
        found = _egos(left).mapInPandas(best, f"seq {kind}, less int, members array<{kind}>")
        own = found.groupBy("seq").agg(F.min(F.struct("less", "members")).alias("own")).select("seq", "own.members")
        full = cut(own.groupBy("members").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == F.size("members")).select("members"))
        taken.append(full)
        gone = full.select(F.explode("members").alias("seq"))
        for i in (1, 2):
            left = left.join(gone.withColumnRenamed("seq", f"seq{i}"), f"seq{i}", "left_anti")
        left = cut(left)
    none = edges.sparkSession.createDataFrame([], f"members array<{kind}>")
    return reduce(DataFrame.unionByName, taken, none).select(F.col("members")[0].cast("string").alias("cluster"), F.explode("members").alias("seq"))


def by_shared_hit(members: DataFrame, pairs: DataFrame, how: str = "all") -> DataFrame:
    """cluster, seq: sequences with one key (a hit id, or a good description) that have a pair with all, or any, others
    of that key. ``members`` has cluster, seq."""
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    both = pairs.select(F.col("seq1").alias("seq"), F.col("seq2").alias("mate")).unionByName(pairs.select(F.col("seq2").alias("seq"), F.col("seq1").alias("mate"))).distinct()
    mates = members.join(both, "seq").join(members.select("cluster", F.col("seq").alias("mate")), ["cluster", "mate"]).groupBy("cluster", "seq").agg(F.count(F.lit(1)).alias("_m"))
    kept = mates.join(size, "cluster").where((F.col("_m") == F.col("_n") - 1) if how == "all" else (F.col("_m") >= 1)).select("cluster", "seq")
    return kept.withColumn("_k", F.count(F.lit(1)).over(Window.partitionBy("cluster"))).where("_k > 1").drop("_k")


def numbered(clusters: DataFrame, prefix: str) -> DataFrame:
    """cluster, seq with clusters renamed ``PREFIX_000001``, largest first, then by smallest member."""
    sizes = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"), F.min("seq").alias("_s")).where("_n > 1")
    names = numbered_rows(sizes, F.desc("_n"), F.col("_s")).select("cluster", F.format_string(f"{prefix}_%06d", F.col("row").cast("long")).alias("name"))
    return clusters.join(names, "cluster").select(F.col("name").alias("cluster"), "seq")


def majority_description(members: DataFrame, least: int = 1) -> DataFrame:
    """Per cluster the description that most members share: good ones first, then by members with it as annotation or
    any hit, e-value, SwissProt, GO terms, text. ``*NoShare`` where none is shared by more than ``least``.

    ``members`` has cluster, seq, description, good, is_anno, evalue, dbtype, n_go; a row for each hit of a member."""
    rows = members.groupBy("cluster", "description").agg(
        F.max("good").alias("good"), F.countDistinct("seq").alias("n"), F.sum(F.col("is_anno").cast("int")).alias("a"),
        F.min("evalue").alias("e"), F.max((F.col("dbtype") == "SP").cast("int")).alias("sp"), F.max("n_go").alias("go"),
    )
    order = Window.partitionBy("cluster").orderBy(F.desc("good"), F.desc(F.col("n") + F.col("a")), "e", F.desc("sp"), F.desc("go"), "description")
    best = rows.withColumn("_r", F.row_number().over(order)).where("_r = 1")
    size = members.groupBy("cluster").agg(F.countDistinct("seq").alias("_size"))
    named = F.when(F.col("n") > least, F.col("description")).otherwise("*NoShare")
    percent = F.floor(100 * F.col("n") / F.col("_size")).cast("int")
    return best.join(size, "cluster").select("cluster", named.alias("description"), F.col("n").alias("n_sharing"), percent.alias("anno_percent"))


def taxa(members: DataFrame) -> DataFrame:
    """cluster, n_seqs and taxa: ``k x1`` of k datasets with one member each, ``kxN`` where one has more. ``members`` has
    cluster, ds."""
    per = members.groupBy("cluster", "ds").agg(F.count(F.lit(1)).alias("_n"))
    kind = F.concat(F.count(F.lit(1)).cast("string"), F.lit("x"), F.when(F.max("_n") > 1, "N").otherwise("1"))
    return per.groupBy("cluster").agg(F.sum("_n").alias("n_seqs"), kind.alias("taxa"))


def dataset_counts(members: DataFrame, datasets: list) -> DataFrame:
    return members.groupBy("cluster").pivot("ds", datasets).agg(F.count(F.lit(1))).fillna(0)


def pairs_inside(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """seq1, seq2 of the pairs whose sequences are in one cluster, each once."""
    side = lambda n: members.select("cluster", F.col("seq").alias(f"seq{n}"))
    return pairs.select("seq1", "seq2").join(side(1), "seq1").join(side(2), ["cluster", "seq2"]).select("seq1", "seq2").distinct()


def correlation_summary(members: DataFrame, pcc: DataFrame, good: float = GOOD_PCC) -> DataFrame:
    """Per cluster: percent of its pairs at ``good`` or more, and the least; null for clusters without a pair."""
    side = lambda n: members.select("cluster", F.col("seq").alias(f"seq{n}"))
    rows = side(1).join(pcc, "seq1").join(side(2), ["cluster", "seq2"])
    stats = rows.groupBy("cluster").agg(F.floor(100 * F.avg((F.col("pcc") >= good).cast("double"))).cast("int").alias("pcc_percent"), F.min("pcc").alias("min_pcc"))
    return members.select("cluster").distinct().join(stats, "cluster", "left")


def size_bins(n_datasets: int) -> list[tuple[int, int | None]]:
    """Eight ranges of cluster sizes: with up to seven datasets, one for each size up to their number, then up to 5 (10 from
    four datasets on) and in steps of five; with more, fixed ones. The last is open."""
    if n_datasets >= 8:
        return [(2, 2), (3, 5), (6, 10), (11, 20), (21, 30), (31, 40), (41, 50), (51, None)]
    bins = [(i, i) for i in range(2, n_datasets + 1)]
    low, high = max(n_datasets, 1) + 1, 5 if n_datasets < 4 else 10
    while len(bins) < 7:
        bins.append((low, high))
        low, high = high + 1, high + 5
    return [*bins, (low, None)]


def size_histogram(clusters: DataFrame, n_datasets: int = 8) -> DataFrame:
    """Per method: clusters by size, in the ranges of ``size_bins`` (size_LOW), and the number and the mean and population
    SD of sizes."""
    sizes = clusters.groupBy("method", "cluster").agg(F.count(F.lit(1)).alias("size"))
    inside = lambda low, high: F.col("size") >= low if high is None else F.col("size").between(low, high)
    bins = [F.sum(inside(low, high).cast("long")).alias(f"size_{low}") for low, high in size_bins(n_datasets)]
    return sizes.groupBy("method").agg(*bins, F.count(F.lit(1)).alias("n_clusters"), F.sum("size").alias("n_seqs"), F.avg("size").alias("mean_size"), F.stddev_pop("size").alias("sd_size"))


def score_summary(clusters: DataFrame, scores: tuple[str, ...] = ("score1", "score2")) -> DataFrame:
    """Per method: mean length of the consensus and of the lengths' SD, and mean and population SD of each score. ``clusters``
    has a row per cluster with method, con_len, sd_len and the scores; nulls are left out."""
    each = [f(c).alias(f"{name}_{c}") for c in scores for name, f in (("mean", F.avg), ("sd", F.stddev_pop))]
    return clusters.groupBy("method").agg(F.avg("con_len").alias("mean_con_len"), F.avg("sd_len").alias("mean_sd_len"), *each)
