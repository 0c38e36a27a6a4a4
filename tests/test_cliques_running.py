"""Cliques against taking the largest first, and sums along an order that is cut into ranges."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from strandlake.operators import clusters, stats


def largest_first(edges):
    """Cliques taken one after the other: the largest of what is left, the first by members of equally large ones."""
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def grow(clique, mates):
        yield clique
        for x in sorted(mates):
            yield from grow([*clique, x], {y for y in mates & near[x] if y > x})

    out = []
    while near:
        best = min((c for x in near for c in grow([x], {y for y in near[x] if y > x})), key=lambda c: (-len(c), c))
        if len(best) < 2:
            break
        out.append(tuple(best))
        near = {x: m - set(best) for x, m in near.items() if x not in best}
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_cliques_equal_taking_the_largest_first(spark, seed):
    rng = random.Random(seed)
    nodes = list(range(30))
    edges = [(a, b) for a in nodes for b in nodes if a < b and rng.random() < (0.1, 0.25, 0.4)[seed]]
    rows = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in edges] + edges[:5] + [(3, 3), (4, None), (None, None)]
    groups = defaultdict(list)
    for r in clusters.cliques(spark.createDataFrame(rows, "seq1 long, seq2 long")).collect():
        groups[r.cluster].append(r.seq)
    assert sorted(tuple(sorted(g)) for g in groups.values()) == largest_first(edges)
    assert all(c == str(min(g)) for c, g in groups.items())


def test_cliques_of_names_and_of_nothing(spark):
    rows = [("b", "a"), ("b", "c"), ("a", "c"), ("c", "d"), ("d", "e"), ("x", "y")]
    got = sorted(tuple(r) for r in clusters.cliques(spark.createDataFrame(rows, "seq1 string, seq2 string")).collect())
    assert got == [("a", "a"), ("a", "b"), ("a", "c"), ("d", "d"), ("d", "e"), ("x", "x"), ("x", "y")]
    assert clusters.cliques(spark.createDataFrame([], "seq1 string, seq2 string")).count() == 0


def test_running_sums_over_ranges(spark):
    rng = random.Random(5)
    rows = [(None if g == 3 else g, v, rng.randint(1, 9)) for g in range(4) for v in rng.sample(range(1000), (1, 400, 50, 20)[g])]
    df = spark.createDataFrame(rows, "g int, v int, m int").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    try:
        placed = stats.ranged(df, "g", "v")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert placed.select("_part").distinct().count() > 1
    up = stats.running(placed, "g", "v", F.col("m"), "up")
    got = {(r.g, r.v): (r.up, r.low) for r in stats.running(up, "g", "v", F.col("m"), "low", "min", later=True).collect()}
    want = {(g, v): (sum(m for h, w, m in rows if h == g and w <= v), min(m for h, w, m in rows if h == g and w >= v)) for g, v, _ in rows}
    assert got == want


def test_quartiles_of_a_null_group_and_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0), ("a", None)], "g string, v double")
    got = {r.g: tuple(r)[1:] for r in stats.quartiles(df, "g", "v").collect()}
    assert got == {None: (2, 1.0, 2.0, 3.0), "a": (1, 2.0, 2.0, 2.0)}
    assert stats.quartiles(df.limit(0), "g", "v").count() == 0
