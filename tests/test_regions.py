"""Pairs of hits by place against a plain loop over all pairs."""

from __future__ import annotations

import random

import pytest

from strandlake.operators import hits

SCHEMA = "seq_id string, hit_id long, bits double, frame int, seq_start int, seq_end int, low string"


def rows_of(seed):
    rng = random.Random(seed)
    rows = []
    for n in range(220):
        start, length = rng.randint(1, 3000), rng.choice([0, 30, 400, 499, 500, 501, 2600])
        a, b = start, start + length
        rows.append(("s1" if n % 3 else "s2", n, float(rng.randint(40, 60)), rng.randint(1, 2), *((b, a) if rng.random() < 0.4 else (a, b)), "x"))
    return [*rows, ("s1", 500, 90.0, 1, None, 5000, "x"), ("s1", 501, None, 1, 1, 5000, "x"), (None, 502, 90.0, 1, 1, 5000, "x"), ("s1", 503, 90.0, None, 1, 5000, "x")]


@pytest.mark.parametrize("flank", [0, 7])
def test_contained_hits_equal_all_pairs(spark, flank):
    rows = rows_of(flank)
    want = set()
    for s, h, x, f, a, b, _ in rows:
        for t, g, y, e, c, d, _ in rows:
            if None in (s, t, x, y, f, e, a, c) or (s, f, a > b) != (t, e, c > d) or not (y > x or (y == x and g < h)):
                continue
            if min(a, b) >= min(c, d) - flank and max(a, b) <= max(c, d) + flank:
                want.add((s, h, g))
    got = [tuple(r) for r in hits.contained(spark.createDataFrame(rows, SCHEMA), flank).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_overlapping_hits_equal_all_pairs(spark):
    rows = rows_of(3)
    want = set()
    for s, h, _, _, a, b, _ in rows:
        for t, g, _, _, c, d, _ in rows:
            if None not in (s, t, a, c) and s == t and h < g and min(a, b) < max(c, d) and min(c, d) < max(a, b):
                want.add((s, h, g))
    got = [tuple(r) for r in hits.overlapping(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == want and want


def test_pairs_of_no_hits(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert hits.contained(none).count() == 0 and hits.overlapping(none).count() == 0
