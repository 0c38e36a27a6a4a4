"""Reading frames, frame pairs, training profiles and linear gaps against plain loops and worked cases."""

from __future__ import annotations

import math
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from strandlake.functions.sequences import CODONS
from strandlake.operators import alignment as A
from strandlake.operators import frame_pairs as FP
from strandlake.operators import orf_choice as C
from strandlake.queries import frames, pairs

SF = "/root/testdata/sf0.001"
STOPS = ("TAA", "TAG", "TGA")
HIT = "seq_id long, frame int, hit_start int, hit_end int, n_stops int, good_hit boolean, great_hit boolean"


def found(spark, seq, hit=None):
    hits = spark.createDataFrame([(1, *hit, 0, True, False)], HIT) if hit else None
    rows = C.candidates(spark.createDataFrame([(1, seq)], "seq_id long, seq string"), hits).collect()
    return {(r.start, r.end, r.has_start, r.has_stop, r.after_stop) for r in rows if r.frame == (hit[0] if hit else 1)}


def test_candidates_between_stops(spark):
    fill = "GCA" * 12
    assert found(spark, "ATG" + fill + "TAA" + fill) == {(1, 42, True, True, False), (43, 78, False, False, True)}
    assert found(spark, "GCA" + "ATG" + fill + "TAA") == {(1, 45, False, True, False), (4, 45, True, True, False)}
    assert found(spark, "GCAATG" + fill) == {(4, 42, True, False, False)}  # an early ATG alone
    assert found(spark, fill + "ATG" + fill) == {(1, 75, False, False, False), (37, 75, True, False, False)}
    assert found(spark, fill + "TAA" + "ATG" + fill + "TAGCC") == {(1, 39, False, True, False), (40, 81, True, True, False)}
    rows = C.candidates(spark.createDataFrame([(1, None), (2, ""), (3, "AC"), (4, "ATGGCAGCATAA")], "seq_id long, seq string")).collect()
    assert {(r.seq_id, r.start, r.end) for r in rows if r.frame == 1} == {(4, 1, 12)}
    assert C.candidates(spark.createDataFrame([], "seq_id long, seq string")).count() == 0


def test_candidates_around_a_hit(spark):
    fill = "GCA" * 12
    assert found(spark, "CCC" * 4 + "ATG" + fill + "TAA" + fill, (1, 13, 51)) == {(13, 54, True, True, False)}  # exact
    assert found(spark, "CCC" * 4 + "ATG" + fill + fill + "TAA", (1, 13, 51)) == {(13, 90, True, True, False)}  # its start, a later stop
    up = "TAA" + "GCA" + "ATG" + "GCA" + "ATG" + "GCA" + fill + "TGA"
    assert found(spark, up, (1, 19, 42)) == {(7, 57, True, True, False), (13, 57, True, True, False), (4, 57, False, True, True)}
    down = fill + "GCAGCAATG" + fill + "TGA"
    assert found(spark, down, (1, 37, 60)) == {(43, 84, True, True, False), (1, 84, False, True, False)}
    far = fill + "GCA" * 10 + "ATG" + fill  # the ATG lies ten codons in: no start, no stop
    assert found(spark, far, (1, 37, 72)) == {(37, 72, False, False, False), (1, len(far), False, False, False)}


def walked(rows):
    """Candidates of a frame as the rules read, one after the other."""
    kept, last = [], None
    for x in sorted(rows, key=lambda r: (r.start, not r.has_start, r.end)):
        if last is not None:
            gap, drop = x.start - last.start, None
            if gap < 120 and last.has_start and x.after_stop:
                drop = x
            elif gap < 120 and last.after_stop and x.has_start:
                drop = last
            elif gap < 30:
                drop = (x if last.has_start else last) if last.has_start != x.has_start else x if x.start > last.start else last
            if drop is x:
                continue
            if drop is last:
                kept.remove(last)
        kept.append(x)
        last = x
    return kept


def rule(x, y):
    size = lambda r: r.end - r.start + 1
    log = lambda r: math.log(r.n_known) if r.n_known else 0.0
    mk = lambda r: (0.01 if abs(r.markov) < 1 else math.log(abs(r.markov))) * (-1 if r.markov < 0 else 1)
    side = lambda a, b: -1 if a and not b else 1 if b and not a else 0
    if min(size(x), size(y)) < 9:
        return side(size(x) >= 9, size(y) >= 9)
    if x.full and y.full and x.frame == 1:
        s = side(x.anno and x.has_start, y.anno and y.has_start)
        if s or not (x.anno or y.anno):
            s = s or side(x.has_start, y.has_start)
            if s:
                return s
    if x.good_hit and side(x.anno, y.anno):
        return side(x.anno, y.anno)
    by_len, by_mk, dl, dm = size(y) - size(x), int(y.markov - x.markov), abs(log(x) - log(y)), abs(mk(x) - mk(y))
    for on, gap, cut, value in ((max(size(x), size(y)) > 100, dl, 0.4, by_len), (max(x.markov, y.markov) > 10, dm, 0.3, by_mk), (True, dl, 0.4, by_len), (True, dm, 0.3, by_mk)):
        if on and gap > cut:
            return value
    ends = side(x.has_start and x.has_stop, y.has_start and y.has_stop)
    if ends:
        return ends
    if x.has_start and y.after_stop:
        return -1
    if x.after_stop and y.has_start:
        return 1
    return side(x.anno, y.anno) or (by_mk if dl < dm else by_len)


def test_walk_and_choice_equal_plain_loops(spark):
    seqs = frames.dna(spark, SF)
    rows = C.candidates(seqs, C.hit_choice(frames.hits(spark, SF), seqs)).withColumn("markov", (F.xxhash64("orf") % 4000) / 100).cache()
    by = {}
    for r in rows.collect():
        by.setdefault(r.seq_id, {}).setdefault(r.frame, []).append(r)
    kept = {i: {f: walked(c) for f, c in fs.items()} for i, fs in by.items()}
    got = C.without_close_starts(rows)
    key = lambda r: (r.seq_id, r.frame, r.start, r.end, r.has_start, r.has_stop)
    assert sorted(map(key, got.collect())) == sorted(key(r) for fs in kept.values() for c in fs.values() for r in c)

    def fold(c):
        best = c[0]
        for x in c[1:]:
            best = x if rule(best, x) > 0 else best
        return best

    want = [fold([fold(fs[f]) for f in sorted(fs)]) for fs in kept.values()]
    assert sorted(map(key, C.best_orfs(got).collect())) == sorted(map(key, want))


def slow_like(a, b):
    """Whether the profile of a text is like that of one before."""
    count = lambda t: Counter(w for i in range(len(t) - 5) if set(w := t[i : i + 5]) <= set("ACGT"))
    x, y = count(a), count(b)
    missing = sum(1 for w in x if w not in y)
    same = sum(1 for w, n in x.items() if w in y and abs(math.log(n) - math.log(y[w])) < 0.5)
    return missing < sum(x.values()) // 2 and same > 0 and 100 * same / (same + missing) >= 99


@pytest.mark.parametrize("round_rows", [7, 1000])
def test_training_set_equals_plain_loop(spark, round_rows):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(30, 90))) for _ in range(30)]
    for t in texts[:12]:
        texts += [t[:-1], t[3:] + "N", t[: len(t) // 2] + "A" + t[len(t) // 2 :], t]
    rows = [(i, t, i % 5 == 0) for i, t in enumerate(texts)]
    want, bases = [], 0
    for i, t, _ in sorted(rows, key=lambda r: (not r[2], -len(r[1]), r[0])):
        if not any(slow_like(t, texts[j]) for j in want):
            want.append(i)
            bases += len(t)
            if bases >= 1200 and len(want) >= 25:
                break
    assert 25 <= len(want) < 42
    df = spark.createDataFrame([*rows, (99, None, True)], "seq_id long, orf string, great_hit boolean")
    assert sorted(r.seq_id for r in C.training_set(df, 25, 1200, round_rows).collect()) == sorted(want)
    assert C.training_set(df.where("orf IS NULL")).count() == 0


def slow_linear(a, b, gap=A.GAP_OPEN):
    """The least cost of any path, by all cells; ends are free."""
    n, m = len(a), len(b)
    best = [[0.0] * (m + 1) for _ in range(n + 1)]
    for i in range(1, n + 1):
        for j in range(1, m + 1):
            match = A.NT_MATCH if a[i - 1] == b[j - 1] else A.NT_MISMATCH
            best[i][j] = max(best[i - 1][j] - gap * (j < m), best[i - 1][j - 1] + match, best[i][j - 1] - gap * (i < n))
    return best[n][m]


def test_linear_gaps(spark):
    rng = random.Random(6)
    for _ in range(60):
        a, b = ("".join(rng.choice("ACG") for _ in range(rng.randrange(0, 25))) for _ in range(2))
        score, x, y = A.align_linear(a, b, gap=1.3)
        assert x.replace("-", "") == a and y.replace("-", "") == b and len(x) == len(y)
        if a and b:
            assert score == pytest.approx(slow_linear(a, b, 1.3))
            cut = lambda s: (len(s) - len(s.lstrip("-")), len(s.rstrip("-")))
            low, high = max(cut(x)[0], cut(y)[0]), min(cut(x)[1], cut(y)[1])
            own = sum(-1.3 if "-" in (p, q) else A.NT_MATCH if p == q else A.NT_MISMATCH for p, q in zip(x[low:high], y[low:high], strict=True))
            assert own == pytest.approx(score)
    assert A.align_linear("ACGT", "ACGGT", gap=0.5)[1:] == ("AC-GT", "ACGGT")
    df = spark.createDataFrame([("ACGT", None), ("AC", "")], "text1 string, text2 string")
    assert {(r.score, r.aligned2) for r in A.align_pairs(df, affine=False).collect()} == {(None, None), (0.0, "--")}


def translated(seq, frame):
    if not frame or seq is None:
        return ""
    strand = seq if frame > 0 else seq.translate(str.maketrans("ACGT", "TGCA"))[::-1]
    return "".join(CODONS.get(strand[i : i + 3], "X") for i in range(abs(frame) - 1, len(strand) - 2, 3))


def likeness(a, b):
    _, x, y = A.align(a, b)
    ends = lambda s: (len(s) - len(s.lstrip("-")), len(s.rstrip("-")))
    low, high = max(ends(x)[0], ends(y)[0]), min(ends(x)[1], ends(y)[1])
    cols = list(zip(x[low:high], y[low:high], strict=True))
    return (100.0 * sum(p == q and p not in "*-" for p, q in cols) / len(cols) if cols else 0.0), sum("*" in c for c in cols)


def test_frame_choice_equals_all_pairs(spark):
    rng = random.Random(9)
    rows = []
    for n in range(24):
        code = "".join(rng.choice([c for c in CODONS if c not in STOPS]) for _ in range(30))
        other = "".join(c if rng.random() < (0.97, 0.8)[n % 2] else rng.choice("ACGT") for c in code)
        f, g = rng.choice((1, 2, 3)), rng.choice((1, 2, 3))
        t1, t2 = "A" * (f - 1) + code, "C" * (g - 1) + other
        if n % 3 == 0:
            t2, g = t2.translate(str.maketrans("ACGT", "TGCA"))[::-1], -g
        orf = (f, g) if n % 4 == 0 else (rng.choice((1, 2, 3, -1, -2)), rng.choice((1, 2, 3, -3)))
        hit = (f, g) if n % 4 == 1 else (rng.choice((1, -1, 2, 0)), rng.choice((1, -1, 3)))
        rows.append((n, n + 100, t1, t2, *orf, *hit, n % 4 == 1 or n % 5 == 0))
    rows.append((50, 150, None, "ATGATG", 1, 1, None, 1, False))
    df = spark.createDataFrame(rows, "seq1 int, seq2 int, text1 string, text2 string, orf1 int, orf2 int, hit1 int, hit2 int, is_aa boolean")
    good = lambda s, n: s > 90 or (s > 80 and n < 50) or (s > 60 and n < 10) or (s > 50 and n < 5)
    want = {}
    for a, b, t1, t2, o1, o2, h1, h2, aa in rows:
        h1 = h1 or 0
        score = lambda f, g, t1=t1, t2=t2: likeness(translated(t1, f), translated(t2, g))
        best, tried = ((o1, o2), score(o1, o2)), 1
        if not good(*best[1]) and aa and (o1, o2) != (h1, h2):
            tried += 1
            now = score(h1, h2)
            best = ((h1, h2), now) if good(*now) or now > best[1] else best
        elif not good(*best[1]) and not aa and not h1 * o1 > 0:
            way = lambda h: (3, 2, 1) if h > 0 else (-1, -2, -3) if h else ()
            for f in way(h1):
                for g in way(h2):
                    if (f, g) != (o1, o2):
                        tried += 1
                        best = max(best, ((f, g), score(f, g)), key=lambda x: x[1]) if score(f, g) > best[1] else best
        want[a] = (*best[0], *best[1], tried)
    got = {r.seq1: (r.frame1, r.frame2, r.sim, r.stops, r.tried) for r in FP.frame_choice(df).collect()}
    assert got.keys() == want.keys() and {w[-1] for w in want.values()} >= {1, 2, 10}
    for k in want:
        assert got[k] == pytest.approx(want[k]), k


def test_region_differences_equal_plain_counts(spark):
    rows = {(r.seq1, r.seq2): r for r in pairs.region_differences(spark, SF).collect()}
    for t in pairs.region_texts(spark, SF).collect():
        for region in FP.REGIONS:
            _, x, y = A.align(t[f"{region}_1"], t[f"{region}_2"])
            r = rows[t.seq1, t.seq2]
            assert (r[f"{region}_len"], r[f"{region}_diff"]) == (len(x), sum(p != q for p, q in zip(x, y, strict=True)))
    df = spark.createDataFrame([(1, 2, "ACG", None, "A", "ACGTA", None, "")], "seq1 int, seq2 int, utr5_1 string, cds_1 string, utr3_1 string, utr5_2 string, cds_2 string, utr3_2 string")
    r = FP.region_differences(df).first()
    assert (r.utr5_len, r.utr5_diff, r.utr5_len_inner) == (5, 2, None) and r.cds_len is None and (r.utr3_len, r.utr3_diff, r.utr3_len_inner) == (1, 0, None)


def test_regions(spark):
    df = spark.createDataFrame([(1, "AACCGGTT", 1, 3, 6), (2, "AACCGGTT", -1, 1, 3), (3, "AA", 0, 0, 0), (4, None, 1, 1, 1)], "i int, seq string, frame int, start int, end int")
    got = {r.i: (r.utr5, r.cds, r.utr3) for r in FP.regions(df).collect()}
    assert got[1] == ("AA", "CCGG", "TT") and got[2] == ("", "AAC", "CGGTT") and got[3] == (None, None, None) and got[4][1] is None


def test_markov_is_the_sum_over_kmers(spark):
    scores = spark.createDataFrame([("ACG", 2, 1.0), ("CGT", 0, 0.5), ("ACG", 1, 7.0)], "kmer string, phase int, score double")
    rows = spark.createDataFrame([("ACGT", 1), ("NACG", 2), ("", 3), ("ANACG", 4)], "orf string, i int")
    assert {r.i: r.markov for r in C.with_markov(rows, scores, 3).collect()} == {1: 1.5, 2: 0.0, 3: 0.0, 4: 7.0}
    assert np.isclose(C.profile("ACGTACGTNACGTA").sum(), 4)


@pytest.mark.parametrize("turned", [False, True])
def test_of_equal_starts_the_one_after_a_stop_goes(spark, turned):
    rows = [(1, 3, 24, 62, False, False, after, False, False, False, 39, "A" * 39) for after in (turned, not turned)]
    assert [r.after_stop for r in C.without_close_starts(spark.createDataFrame(rows, C.CANDIDATE).coalesce(1)).collect()] == [False]


def test_a_task_hands_over_few_candidates_at_once(spark):
    class Rows:
        def select(self, *_):
            return self

        def mapInPandas(self, scan, _):
            return scan

    dice = random.Random(2)
    texts = ["".join(dice.choice("ACGT") for _ in range(n)) for n in [300] * 600 + [0, 20_000, 4]]
    batch = pd.DataFrame({"seq_id": range(len(texts)), "seq": texts, **dict.fromkeys(["hit_frame", "hit_start", "hit_end", "n_stops", "good_hit"])})
    scan = C.candidates(Rows())
    held = list(scan(iter([batch[:50], batch[50:]])))
    assert max(map(len, held)) <= C.HELD and len(held) > 1
    assert all(d["orf"].str.len().sum() <= C.HELD_LETTERS + 20_000 for d in held)
    alone = [r for i in range(len(texts)) for d in scan(iter([batch[i : i + 1]])) for r in d.itertuples(index=False)]
    assert [r for d in held for r in d.itertuples(index=False)] == alone
