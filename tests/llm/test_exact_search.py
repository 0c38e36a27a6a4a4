"""Exact search and hard negatives against plain loops over Python integers, and rearranged texts against slices."""

from __future__ import annotations

import hashlib
import math
import random
import re

import numpy as np
import pytest

from strandlake.llm import fim, integer_vectors, negatives, topk

ROW = "vec_id long, embedding array<double>, label int, length string, block string, part string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, l, "a", "b", "c") for i, v, l in rows], ROW)


def ints(rows):
    """The rows that take part, as lists of Python integers."""
    ok = [(i, v, l) for i, v, l in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    sizes = [len(v) for _, v, _ in ok]
    dim = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    out = {}
    for i, v, l in ok:
        if len(v) == dim:
            out[i] = max(out.get(i, ([-math.inf], 0)), ([math.floor(256 * x) for x in v], l), key=lambda r: r[0])
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b, strict=True))


def slow_topk(rows, asks, k):
    out = []
    for q in sorted(asks):
        best = sorted((-dot(rows[q][0], v), i) for i, (v, _) in rows.items() if i != q)[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


def slow_negatives(rows, anchors, k, percent):
    out = []
    for a in sorted(anchors):
        v, label = rows[a]
        scored = sorted((-dot(v, w), i, m) for i, (w, m) in rows.items() if i != a)
        for p, i, _ in [r for r in scored if r[2] == label][:k]:
            found = [(s, j) for s, j, m in scored if m != label and percent * -p <= 100 * -s <= 100 * -p][:k]
            out += [(a, i, n + 1, j, -p, -s) for n, (s, j) in enumerate(found)]
    return sorted(out)


def crowd(kind, n=700, dim=12, seed=3):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, dim)) * np.linspace(2, 0.1, dim)
    if kind == "units":
        v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lengths":
        v *= rng.lognormal(0, 1.5, size=(n, 1))
    if kind == "groups":
        v = v[rng.integers(0, 30, n)] + rng.normal(size=(n, dim)) * 0.01
    if kind == "copies":
        v[rng.random(n) < 0.4] = v[0]
    if kind == "huge":
        v *= 1e6
    return [(int(i), x.tolist(), int(rng.integers(0, 4))) for i, x in enumerate(v)]


def odd(rows):
    """The rows with zero vectors, nulls, other lengths, repeats and other rows of an id added."""
    dim = len(rows[0][1])
    nan, inf = float("nan"), float("inf")
    extra = [(5000 + i, [0.0] * dim, i % 2) for i in range(6)] + [(None, rows[0][1], 0), (6000, None, 1), (6010, [nan] * dim, 1), (6020, [inf] * dim, 1), (6030, [None] * dim, 1)]
    return rows + extra + [(6040, [1.0], 0), (6050, [], 0), rows[3], rows[3], (10, [0.25] * dim, rows[10][2]), (-50, rows[7][1], 2), (6060, rows[7][1], 3)]


@pytest.mark.parametrize("kind", ["units", "lengths", "groups", "copies", "huge"])
def test_topk_equals_brute_force(spark, kind):
    rows = odd(crowd(kind))
    own = integer_vectors.whole(table(spark, rows)).cache()
    got = topk.search(own, own.where("vec_id % 10 = 0"), k=5, query_rows=16, block_rows=100).collect()
    want = ints(rows)
    assert sorted(map(tuple, got)) == slow_topk(want, [i for i in want if i % 10 == 0], 5)


def test_topk_scores_beyond_longs_and_small_tables(spark):
    rows = [(1, [1e200, 0.0], 0), (2, [1e200, 1.0], 0), (3, [-1e200, 5.0], 0), (50, [1.0, 2.0], 0)]
    own = integer_vectors.whole(table(spark, rows))
    got = topk.search(own, own, k=5).collect()
    most = (1 << 63) - 1
    assert [(r.rank, r.vec_id, r.score) for r in sorted(got) if r.query_id == 1] == [(1, 2, most), (2, 50, most), (3, 3, -most + 1)]
    none = integer_vectors.whole(table(spark, []))
    assert topk.search(none, none).collect() == []
    assert topk.search(own, own.where("false")).collect() == []
    one = own.where("vec_id = 50")
    assert topk.search(one, one).collect() == []


@pytest.mark.parametrize("kind", ["units", "lengths", "groups", "copies", "huge"])
def test_negatives_equal_brute_force(spark, kind):
    rows = odd(crowd(kind, n=500))
    own = negatives.labelled(table(spark, rows))
    got = negatives.mine(own, own.where("vec_id % 10 = 0"), members=8, slice_rows=150).collect()
    want = ints([r for r in rows if r[2] is not None])
    assert got and sorted(map(tuple, got)) == slow_negatives(want, [i for i in want if i % 10 == 0], 5, negatives.PERCENT)


def test_negatives_of_small_tables(spark):
    none = negatives.labelled(table(spark, []))
    assert negatives.mine(none, none).collect() == []
    rows = [(0, [1.0, 0.0], 1), (1, [1.0, 0.0], None), (2, [0.9, 0.0], 2), (3, [-1.0, 0.0], 1), (4, [0.0, 1.0], 2), (100, [0.0, 0.0], 3), (101, [0.0, 0.0], 3)]
    own = negatives.labelled(table(spark, rows))
    got = sorted(map(tuple, negatives.mine(own, own).collect()))
    want = ints([r for r in rows if r[2] is not None])
    assert got == slow_negatives(want, want, 5, negatives.PERCENT) and any(r[0] == 100 for r in got)


UNIT = {"line": r"[^\n]*\n|[^\n]+", "char": r"(?s:.)", "word": r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"}


def slow_fim(doc_id, text, unit, rate, spm, seed=7):
    text = text or ""
    units = re.findall(UNIT[unit], text)
    n = len(units)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return n, out[0], len(p), len(m), out[1]


@pytest.mark.parametrize(("unit", "rate", "spm"), [("line", 100, 50), ("char", 60, 50), ("word", 100, 0), ("line", 0, 50)])
def test_fill_in_middle_equals_slices(spark, unit, rate, spm):
    rng = random.Random(4)
    pieces = ["a", "b c", "\n", "\n\n", "\r\n", "é", "ß", "漢字", "🙂🙂", " ", "\x00", "<", "S>", "<S", ">", " ", "\t", "é", "𐍈"]
    texts = [None, "", "\n", "\n\n", "no end", "é", "🙂", "x<P>y", "<M>", "<S>\n", "<<P", "long é\n" * 50_000]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(400)]
    rows = [(i * 3 - 20, t, "x", "y", len(t or ""), None) for i, t in enumerate(texts)] + [(None, "a\nb\n", None, None, 4, None)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, `form` string, OUTPUT string, n_chars int, `odd name` string")
    got = fim.transformed(docs, unit, rate, spm).withColumn("back", fim.restored(fim.F.col("output"), fim.F.col("form"))).collect()
    want = sorted(map(repr, [(i, *slow_fim(i, t, unit, rate, spm), t or "") for i, t, *_ in rows]))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in got) == want
    assert all(r["odd name"] is None and r.n_chars == len(r.text or "") for r in got)
    assert fim.transformed(docs.where("false")).collect() == []
    with pytest.raises(ValueError):
        fim.transformed(docs, "page")


def test_cuts_convert_both_ways():
    rng = random.Random(1)
    for _ in range(50):
        text = "".join(rng.choice("aé漢🙂\n ") for _ in range(rng.randrange(0, 80)))
        raw = np.frombuffer(text.encode(), np.uint8)
        index = fim.Exceptions.of(raw)
        assert index.n_chars == len(text) and len(index.at) == sum(ord(c) > 127 for c in text)
        chars = np.arange(len(text) + 1)
        cuts = np.array([len(text[:k].encode()) for k in chars])
        assert (index.bytes_of(chars) == cuts).all() and (index.chars_of(cuts) == chars).all()
