from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest

from strandlake.llm import ann, lm, near_dedup, queries

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, n_shingles string, component string"


def shingles(text, width=2):
    words = [w.lower() for w in (text or "").encode().split()]
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(texts: dict, width=2, percent=80):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(texts, key=lambda i: len(sets[i]))
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if len(sets[i]) * 100 < percent * len(sets[j]):
                break
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: find(i) for i in texts}, {i: len(s) for i, s in sets.items()}


def check(rows, texts, width=2):
    want, sizes = brute(texts, width)
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    check(queries.op8_minhash(spark, SF).collect(), texts)


@pytest.mark.parametrize("width", [2, 5])
def test_chains_copies_and_borders(spark, width):
    rng = random.Random(5)
    texts, n = {}, 0
    for size in (1, 2, 4, 6, 9, 14, 30, 60, 66, 75, 84, 120, 400):
        for _ in range(3):
            words = [f"w{rng.randrange(10**6)}" for _ in range(size)]
            for _ in range(12):  # a chain: each differs from the last by a few words
                texts[n] = " ".join(words) if rng.random() < 0.7 else "\n".join(words).upper()
                n += 7
                for _ in range(max(1, size // 30)):
                    words[rng.randrange(size)] = f"w{rng.randrange(10**6)}"
    base = [f"b{i}" for i in range(200)]
    for _ in range(150):  # near copies of one text, about the threshold from one another
        words = base[:]
        for _ in range(8 if width == 2 else 3):
            words[rng.randrange(200)] = f"x{rng.randrange(10**6)}"
        texts[n] = " ".join(words)
        n += 1
    texts |= {n + 1: None, n + 2: "", n + 3: " \t", n + 4: "One", n + 5: "oNE", n + 6: "one one"}
    docs = spark.createDataFrame([(i, t, "n", "c") for i, t in texts.items()], DOC)
    check(near_dedup.deduplicated(near_dedup.link(docs, width)).collect(), texts, width)


def test_families_of_altered_and_shortened_copies(spark):
    """Copies of copies, copies that lack an end, and alterations that several copies have in common, all near the
    threshold to one original, so that the links between components are found by rare shingles or not at all."""
    rng = random.Random(8)
    texts, n = {}, 0
    for size in (24, 60, 150):
        base = [f"b{size}-{i}" for i in range(size)]
        for family in range(12):
            words = base[:]
            for _ in range(max(2, size // 9)):
                words[rng.randrange(size)] = f"f{family % 4}-{rng.randrange(6)}"
            for _ in range(6):
                own = words[:]
                for _ in range(max(1, size // 40)):
                    own[rng.randrange(size)] = f"x{rng.randrange(40)}"
                texts[n] = " ".join(own[rng.randrange(1 + size // 8) :] if rng.random() < 0.5 else own)
                n += 1
        for cut in range(0, size // 2, max(1, size // 20)):
            texts[n], texts[n + 1] = " ".join(base[cut:]), " ".join(base[: size - cut])
            n += 2
    docs = spark.createDataFrame([(i, t, "n", "c") for i, t in texts.items()], DOC)
    check(near_dedup.deduplicated(near_dedup.link(docs, 2)).collect(), texts)


def test_small_sets_link(spark):
    """Sets of four inside sets of five, chains through them, and pairs of smaller sets below 80."""
    texts = {0: "a b c d e", 1: "a b c d e f", 2: "b c d e f", 3: "k l m n o", 4: "k l m n o p", 5: "o n m l k", 6: "q r s", 7: "q r s t", 8: "k l m n o p q", 9: "u", 10: "u v"}
    docs = spark.createDataFrame([(i, t, "n", "c") for i, t in texts.items()], DOC)
    check(near_dedup.deduplicated(near_dedup.link(docs, 2)).collect(), texts)
    pairs = {}
    for i in range(40):
        pairs |= {2 * i: f"a{i} b{i} c{i} d{i}", 2 * i + 1: f"a{i} b{i} c{i} d{i} e{i}"}
    docs = spark.createDataFrame([(i, t, "n", "c") for i, t in pairs.items()], DOC)
    want, _ = brute(pairs, 2, 75)
    assert {r.doc_id: r.component_id for r in near_dedup.deduplicated(near_dedup.link(docs, 2, percent=75)).collect()} == want
    assert want[1] == 0


def test_small_sets_that_one_word_extends(spark):
    texts = {}
    for size in range(1, 13):
        words = [f"s{size}w{i}" for i in range(size)]
        texts |= {3 * size: " ".join(words), 3 * size + 1: " ".join([*words, "more"]), 3 * size + 2: " ".join(["less", *words, "more"])}
    docs = spark.createDataFrame([(i, t, "n", "c") for i, t in texts.items()], DOC)
    for width in (1, 2, 5):
        check(near_dedup.deduplicated(near_dedup.link(docs, width)).collect(), texts, width)


def test_frequent_shingles_are_shared_out(spark, monkeypatch):
    """The same links where most shingles count as frequent and where rows are dealt two by two."""
    monkeypatch.setattr(near_dedup, "FREQUENT", 50)
    monkeypatch.setattr(near_dedup, "SHARE", 2)
    test_families_of_altered_and_shortened_copies(spark)


def test_ids_that_repeat_and_single(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    near = a + " more"
    data = [(3, a), (5, a), (5, b), (None, a), (None, c), (None, c), (7, c + " end"), (8, None), (8, None), (None, ""), (2, near), (2, b + " b"), (2, near)]
    docs = spark.createDataFrame([(i, t, "n", "c") for i, t in data], "doc_id long, text string, _gone string, _text string")
    links = near_dedup.link(docs, 2)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in near_dedup.deduplicated(links).collect())
    want = [("3", 59, "2", False), ("5", 59, "2", False), ("5", 59, "2", False), ("None", 59, "2", False), ("None", 59, "7", False), ("None", 59, "7", False), ("7", 60, "7", True)]
    want += [("8", 0, "8", True)] * 2 + [("None", 0, "None", True)] + [("2", 60, "2", True)] * 3
    assert got == sorted(want)
    left = near_dedup.single(docs, links)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == sorted([("2", near), ("2", b + " b"), ("7", c + " end"), ("8", "None"), ("8", "None"), ("None", "")])
    assert near_dedup.single(docs.limit(0), near_dedup.link(docs.limit(0), 2)).count() == 0


def test_dedup_edges(spark):
    long = " ".join(f"w{i}" for i in range(90))
    docs = spark.createDataFrame([(None, long, "", ""), (4, long, "", ""), (4, long, "", ""), (9, long, "", ""), (None, "alone here", "", ""), (None, None, "", "")], DOC)
    rows = near_dedup.deduplicated(near_dedup.link(docs, 2)).collect()
    got = sorted((str(r.doc_id), str(r.component_id), r.kept) for r in rows)
    assert got == sorted([("None", "4", False), ("4", "4", True), ("4", "4", True), ("9", "4", False), ("None", "None", True), ("None", "None", True)])
    assert near_dedup.deduplicated(near_dedup.link(docs.limit(0), 2)).count() == 0


def test_registers_and_estimate():
    rng = np.random.default_rng(1)
    x = np.array([0, 1, 2, 3, 1023, 1024, 1 << 59, (1 << 60) - 1, (1 << 53) + 1, (1 << 54) - 1], np.uint64)
    for v, r in zip(x.tolist(), near_dedup.compressed(x, 60).tolist(), strict=True):
        assert r >> near_dedup.MANTISSA == 60 - v.bit_length()
        tail = v - (1 << (v.bit_length() - 1)) if v else 0
        shift = v.bit_length() - 1 - near_dedup.MANTISSA
        assert r & 1023 == ((tail >> shift if shift >= 0 else tail << -shift) & 1023)
    for size, make in ((60, near_dedup.small_registers), (500, near_dedup.large_registers)):
        for j in (0.5, 0.8, 0.95):
            got = []
            for _ in range(40):
                common = round(2 * size * j / (1 + j))
                all_ = rng.integers(0, 1 << 63, 2 * size - common).astype(np.uint64)
                a, b = np.unique(all_[:size]), np.unique(all_[size - common :])
                got.append(near_dedup.estimated(make(a)[None], make(b)[None], np.array([size]), np.array([size]))[0])
            assert abs(np.mean(got) - j) < 0.03 and max(abs(g - j) for g in got) < near_dedup.SLACK


def nearest(vectors: dict, queries_: list, k=20):
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids])
    out = {}
    for q in queries_:
        s = (m * np.array(vectors[q])).sum(1)
        s[ids == q] = -np.inf
        order = np.lexsort((ids, -s))[:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order if np.isfinite(s[i])]
    return out


def test_ann_recall(spark):
    path = "/root/testdata/sf0.1"
    vectors = {r.vec_id: np.array(r.embedding, float) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()}
    want = nearest(vectors, [i for i in vectors if i % 20 == 0])
    got = defaultdict(list)
    for r in queries.op9_ann(spark, path).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score, r["rank"]))
    assert set(got) == set(want)
    hit = 0
    for q, rows in got.items():
        assert [x[2] for x in rows] == list(range(1, 21)) and q not in [x[0] for x in rows]
        assert rows == sorted(rows, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - vectors[q] @ vectors[v]) < 1e-12 for v, s, _ in rows)
        hit += len({v for v, _ in want[q]} & {x[0] for x in rows})
    print("recall", hit / (20 * len(want)))
    assert hit / (20 * len(want)) >= 0.95


def test_ann_edges(spark):
    schema = "vec_id long, embedding array<float>, list string, rank int"
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [2.0, 0.0]), (3, [0.0, 0.0]), (4, None), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (20, [-1.0, 0.5]), (2, [2.0, 0.0]), (40, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in rows], schema)
    own = ann.usable(df)
    got = sorted(tuple(r) for r in ann.search(own, own.where("vec_id % 20 = 0")).collect())
    assert got == [(0, 1, 1, 2.0), (0, 2, 2, 2.0), (0, 3, 20, -1.0), (20, 1, 0, -1.0), (20, 2, 1, -2.0), (20, 3, 2, -2.0)]
    none = ann.usable(df.limit(0))
    assert ann.search(none, none).count() == 0


def test_ann_hot_vector_is_split(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [1.0, 2.0, 3.0]) for i in range(900)] + [(i, rng.normal(size=3).tolist()) for i in range(900, 1500)]
    own = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    index = ann.fit(own, list_rows=50)
    assert len(index.centroids) > 5
    got = ann.search(own, own.where("vec_id % 500 = 0"), k=5, index=index, group_rows=200).orderBy("query_id", "rank").collect()
    assert [r.vec_id for r in got if r.query_id == 0][:5] == [1, 2, 3, 4, 5]
    groups, n = ann.packed({0: 5, 1: 7, 2: 25, 3: 4}, 10)
    assert groups == {0: [0], 1: [1], 2: [2, 3, 4], 3: [5]} and n == 6


def test_ann_small_tight_groups(spark):
    """Groups of 2 to 10 copies in lists of their own, far from all else: a query has k rows all the same, and the nearest."""
    rng = np.random.default_rng(2)
    unit = lambda v: v / np.linalg.norm(v)
    rows = [unit(rng.normal(size=8)) for _ in range(400)]
    for n in range(2, 11):
        for _ in range(3):
            rows += [unit(rng.normal(size=8))] * n
    vectors = dict(enumerate(rows))
    own = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>"))
    index = ann.fit(own, list_rows=4)
    assert len(index.centroids) > 100
    want = nearest(vectors, list(range(400, len(rows))))
    got = defaultdict(list)
    for r in ann.search(own, own.where("vec_id >= 400"), index=index).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert {len(got[q]) for q in want} == {20}
    hit = sum(len({v for v, _ in want[q]} & set(got[q])) for q in want)
    print("recall", hit / (20 * len(want)))
    assert hit / (20 * len(want)) >= 0.95


@pytest.mark.parametrize("lengths", ["unit", "mixed", "outliers"])
@pytest.mark.parametrize("groups", [280, 1200])
def test_ann_recall_of_groups_with_lengths(spark, lengths, groups):
    """Groups of 1 to 24 near copies in 16 dimensions, with default parameters: equal lengths, lengths from 0.5 to 2, and
    one row in seven scaled by 0.2 to 5."""
    rng = np.random.default_rng(groups)
    rows = []
    for _ in range(groups):
        centre = rng.normal(size=16)
        rows += [centre + 0.05 * rng.normal(size=16) for _ in range(rng.integers(1, 25))]
    rows = np.array(rows)
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    if lengths == "mixed":
        rows *= rng.uniform(0.5, 2, (len(rows), 1))
    elif lengths == "outliers":
        rows *= np.where(rng.random((len(rows), 1)) < 1 / 7, rng.uniform(0.2, 5, (len(rows), 1)), 1)
    vectors = dict(enumerate(rows))
    own = ann.usable(spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>"))
    want = nearest(vectors, range(0, len(rows), 20))
    got = defaultdict(set)
    for r in ann.search(own, own.where("vec_id % 20 = 0")).collect():
        got[r.query_id].add(r.vec_id)
    shares = [len({v for v, _ in want[q]} & got[q]) / 20 for q in want]
    print("recall", lengths, len(rows), np.mean(shares), min(shares), sum(s < 0.9 for s in shares), len(shares))
    assert np.mean(shares) >= 0.95 and np.mean(np.array(shares) < 0.9) <= 0.1


def test_ann_great_and_small_components(spark):
    rows = [(i, [x, 0.0]) for i, x in enumerate([1e200, 1.0, 2.0, 1e-300, -1.0])]
    own = ann.usable(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = [r.vec_id for r in ann.search(own, own.where("vec_id = 1")).orderBy("rank").collect()]
    assert got == [0, 2, 3, 4]


def test_ann_walk_is_no_cap(monkeypatch):
    rng = np.random.default_rng(4)
    centroids = np.concatenate([rng.normal(size=(60, 3)), np.zeros((60, 1))], 1)
    graph = np.stack([(np.arange(60) + j) % 60 for j in range(1, 6)], 1)
    index = ann.Index(centroids, graph, 1.0, 3)
    monkeypatch.setattr(ann, "WALK_QUERY", 4)
    (read,) = index.lists(np.zeros((1, 3)), 0.15, np.ones(60, int), 30)
    d = (centroids**2).sum(1)
    assert sorted(read) == np.flatnonzero(d <= 1.15**2 * np.sort(d)[29]).tolist()
    (read,) = index.lists(np.zeros((1, 3)), 0.15, np.ones(60, int), 100)
    assert sorted(read) == list(range(60))


def test_lm_windows():
    around, own, place = lm.windows([b"\x01\x02\x03", b"", b"\x04"])
    assert own.tolist() == [1, 2, 3, 4] and place.tolist() == [0, 0, 0, 2]
    pad = lm.SYMBOLS
    assert around.T.tolist() == [[pad, pad, 2, 3], [pad, 1, 3, pad], [1, 2, pad, pad], [pad] * 4]


def test_lm_gradient_and_normalisation():
    rng = np.random.default_rng(3)
    net = lm.Network.new(np.ones(lm.SYMBOLS))
    around, symbols = rng.integers(0, lm.SYMBOLS + 1, (4, 50)), rng.integers(0, lm.SYMBOLS, 50)
    total = sum(np.exp(net.log_probs(around, np.full(50, s))) for s in range(lm.SYMBOLS))
    assert np.allclose(total, 1, atol=1e-4)
    before = net.log_probs(around, symbols).mean()
    for _ in range(30):
        net.learn(around, symbols, 0.1)
    assert net.log_probs(around, symbols).mean() > before + 0.5


def test_lm_edges(spark):
    docs = spark.createDataFrame([(1, None, 1), (None, "a b", 2), (2, "", 3), (3, "a " * 20_000, 4), (3, "a " * 20_000, 4)], "doc_id long, text string, symbols int")
    rows = sorted(lm.pseudo_likelihood(docs).collect(), key=str)
    assert len(rows) == 5 and [r.n_tokens for r in rows if r.doc_id in (1, 2)] == [0, 0]
    assert all(r.mean_log_likelihood is None and r.log_likelihood == 0 for r in rows if r.n_tokens == 0)
    same = [r.log_likelihood for r in rows if r.doc_id == 3]
    assert same[0] == same[1] < 0
    assert lm.pseudo_likelihood(docs.limit(0)).count() == 0


def test_lm_scores_words_and_not_their_classes(spark):
    """Of two texts with the same symbols, that of a rarer word scores less by the logarithm of the counts' ratio, and
    given the symbols around it all words of a shared symbol and its unseen ones have the symbol's probability."""
    classes = defaultdict(list)
    for i in range(2000):
        classes[lm.shared(f"r{i}".encode())].append(f"r{i}")
    common, rare, third = classes[lm.OWN][:3]
    other = classes[lm.OWN + 1][0]
    rows = [(i, " ".join(f"o{j}" for j in range(lm.OWN))) for i in range(60)]
    rows += [(100, f"o1 {common} o2"), (101, f"o1 {rare} o2")] + [(200 + i, f"{common} {other}") for i in range(39)] + [(300 + i, third) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.log_likelihood for r in lm.pseudo_likelihood(docs).collect()}
    assert got[100] - got[101] == pytest.approx(np.log(40 / 1))
    counts = lm.word_counts(docs)
    own, totals = lm.symbol_counts(counts)
    assert totals[lm.OWN : lm.OWN + 2].tolist() == [46, 39] and totals.sum() == sum(len(t.split()) for _, t in rows)
    new = next(w for w in classes[lm.OWN][3:])
    symbols = lm.written(lm.with_symbols(spark.createDataFrame([(1, f"{common} {rare} {third} {new} o1")], "doc_id long, text string"), own), "t")
    shares = [r.share for r in lm.word_shares(symbols, counts, totals).orderBy("place").collect()]
    assert np.allclose(np.exp(shares), np.array([40, 1, 5, 1]) / 47)
    parted = lm.with_symbols(docs, own, chunk=3)
    assert {(r.doc_id, r.symbols) for r in parted.collect()} == {(r.doc_id, r.symbols) for r in lm.with_symbols(docs, own).collect()}


def test_lm_trains_on_every_word(spark, monkeypatch):
    """Texts of one word each: what the rounds predict together is all of them."""
    seen = []
    monkeypatch.setattr(lm.Network, "learn", lambda self, around, symbols, rate: seen.extend(symbols.tolist()))

    class One:
        def mapInArrow(self, run, schema):
            import pyarrow as pa

            batch = pa.RecordBatch.from_pydict({"symbols": pa.array([bytes([i]) for i in range(5)], pa.binary())})
            list(run(iter([batch])))
            return spark.createDataFrame([], schema)

    lm.train(One(), np.ones(lm.SYMBOLS))
    assert sorted(seen) == [0, 1, 2, 3, 4]


def test_lm_query_beats_frequencies_of_words(spark):
    """The sum over words is held against the words' own frequencies, not those of their symbols."""
    rows = queries.op10_pseudo_likelihood(spark, SF).collect()
    counts = defaultdict(int)
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        for w in lm.words_of(r.text):
            counts[w] += 1
    n = sum(counts.values())
    plain = sum(x * np.log(x / n) for x in counts.values())
    total = sum(r.log_likelihood for r in rows)
    print("per word", total / n, "frequencies of words", plain / n)
    assert plain < total < 0.7 * plain
