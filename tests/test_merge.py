"""Lasting keys, stored results, pruning, consensus and trims against plain loops and worked cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandlake.operators import clusters as C
from strandlake.operators import hits as H
from strandlake.operators import merge as M
from strandlake.operators import msa
from strandlake.operators import ontology as O
from strandlake.plans.results import Results
from strandlake.plans.tables import with_hits
from strandlake.sources.fasta import InputError


def test_keys_stay_when_more_is_added(spark):
    rows = lambda *names: spark.createDataFrame([(n,) for n in names], "name string")
    first = M.surrogate_keys(rows("c", "a", "b", "a", None), "name")
    assert {r.name: r.id for r in first.collect()} == {"a": 1, "b": 2, "c": 3}
    more = M.surrogate_keys(rows("bb", "a", "aa"), "name", first)
    assert {r.name: r.id for r in more.collect()} == {"a": 1, "b": 2, "c": 3, "aa": 4, "bb": 5}
    none = M.surrogate_keys(rows(), "name")
    assert none.count() == 0 and M.surrogate_keys(rows("x"), "name", none).first().id == 1


def test_merge_of_datasets(spark):
    def data(seqs, hits, counts):
        return {"sequences": spark.createDataFrame(seqs, "seq string, len int"), "hits": spark.createDataFrame(hits, "seq string, hit string, bits double"), "counts": spark.createDataFrame(counts, "seq string, lib string, n long")}

    one = data([("s2", 5), ("s1", 7)], [("s1", "h", 1.0), ("zz", "h", 2.0)], [("s1", "L", 3)])
    two = data([("s0", 9)], [("s0", "h", 4.0), ("s0", "g", 5.0)], [("s0", "L", 6), ("s0", "K", 7)])
    got = M.merged({"one": one, "two": two})
    assert {(r.seq, r.ds, r.seq_id) for r in got["sequences"].collect()} == {("s1", "one", 1), ("s2", "one", 2), ("s0", "two", 3)}
    assert {(r.seq_id, r.hit_id, r.bits) for r in got["hits"].collect()} == {(1, 1, 1.0), (3, 1, 4.0), (3, 2, 5.0)}
    assert {(r.seq_id, r.lib_id, r.n) for r in got["counts"].collect()} == {(1, 1, 3), (3, 1, 6), (3, 2, 7)}
    with pytest.raises(InputError, match="s1"):
        M.merged({"one": one, "two": data([("s1", 1)], [], [])})


def test_merged_graph_takes_the_first_dataset_of_a_child(spark):
    edge = lambda *rows: spark.createDataFrame(rows, "child int, parent int, rel int")
    got = M.merged_edges([edge((2, 1, 1), (3, 1, 1)), edge((3, 2, 1), (4, 3, 2), (4, 3, 2))])
    assert {tuple(r) for r in got.collect()} == {(2, 1, 1), (3, 1, 1), (4, 3, 2)}


def test_stored_results(spark, tmp_path):
    store = Results(spark, str(tmp_path / "results"))
    assert store.version() == 0 and store.columns().count() == 0 and store.sequence_values().count() == 0
    seqs = spark.createDataFrame([(1, 0.01), (2, -0.2), (3, None)], "seq_id long, p double")
    terms = spark.createDataFrame([(7, 0.5), (8, float("nan"))], "gonum int, p double")
    with pytest.raises(KeyError):
        store.save_terms("x", terms, 0.1, "m")
    assert store.save("x", seqs, "A : B", "exact") == 1 and store.save_terms("x", terms, 0.1, "w") == 2
    assert {(r.gonum, r.p) for r in store.term_values().collect()} == {(7, 0.5), (8, None)} and store.cutoffs(["x", "y"]) == {"x": 0.1, "y": 0.05}
    wide = store.with_term_values(spark.createDataFrame([(7,), (9,)], "gonum int"), ["x", "y"])
    assert {tuple(r) for r in wide.collect()} == {(7, 0.5, None), (9, None, None)}
    assert store.save("x", seqs.limit(1)) == 3
    assert store.term_values().count() == 0 and store.sequence_values(["x"]).count() == 1 and store.cutoffs(["x"]) == {"x": 0.05}
    assert store.term_values(version=2).count() == 2 and store.sequence_values(version=2).count() == 3  # an earlier version is whole
    late = Results(spark, str(tmp_path / "results"))
    late.version = lambda: 2
    with pytest.raises(RuntimeError, match="another writer"):
        late.save("y", seqs)


def test_recount(spark):
    terms = spark.createDataFrame([(1, 5), (1, 6), (2, 5), (3, 5), (1, 5)], "seq_id long, gonum int")
    values = spark.createDataFrame([("a", 1, 0.01), ("b", 1, -0.01), ("a", 2, -0.01), ("a", 3, None), ("b", 2, 0.5)], "column string, seq_id long, p double")
    count = lambda *a, **k: {r.gonum: r.n_seqs for r in O.recounted(terms, values, *a, **k).collect()}
    assert count({"a": 0.05, "b": 0.05}) == {5: 2, 6: 1} and count({"a": 0.05, "b": 0.05}, "all") == {5: 1, 6: 1}
    assert count({"a": 0.05}, direction="down") == {5: 1} and count({"a": 0.05}, least=2) == {5: 2} and count({"b": 0.01}) == {}


HIT = "seq_id long, hit_id long, db int, rank int, bits double, evalue double, sim double, seq_start int, seq_end int, description string, go array<int>"


def test_prune_equals_a_walk(spark):
    rng = random.Random(4)
    names = ["kinase A", "kinase A {x}", "hypothetical protein", "kinase B", None]
    rows = [(rng.randrange(4), i, rng.randrange(2), rng.randrange(1, 9), float(rng.randrange(5) * 100), rng.choice((0.0, 0.1)), 50.0, rng.randrange(2), 9, rng.choice(names), rng.choice((None, [], [1], [1, 2]))) for i in range(160)]
    df = spark.createDataFrame(rows, HIT)
    for by in ("description", "alignment"):
        groups = {}
        for r in df.collect():
            groups.setdefault((r.seq_id, r.db), []).append(r)
        want = set()
        for group in groups.values():
            text = lambda r: "" if r.description is None else r.description.replace(" {x}", "")
            group.sort(key=lambda r: (text(r), -r.bits, r.evalue, -r.sim, r.rank, r.hit_id))
            kept, last, before = [], None, None
            for r in group:
                same = before is not None and text(before) == text(r) and (before.description is None) == (r.description is None)
                if by == "alignment":
                    same = same and (before.bits, before.evalue, before.seq_start) == (r.bits, r.evalue, r.seq_start)
                before = r
                if same:
                    n, m = len(r.go or ()), len(last.go or ())
                    better = n > m and (r.bits >= 0.7 * last.bits if m == 0 else r.bits >= last.bits)
                    if not better:
                        continue
                    kept.remove(last)
                kept.append(r)
                last = r
            first = min(kept, key=lambda r: (r.rank, r.hit_id))
            want |= {(r.hit_id, 1 if r is first else r.rank) for r in kept}
        assert {(r.hit_id, r["rank"]) for r in H.prune(df, by).collect()} == want
    assert H.prune(df.where("false")).count() == 0 and H.prune(df).columns == df.columns


def slow_trim(text):
    """The published scan, character by character, from one side."""
    gaps = chars = skips = cut = 0
    inside = False
    for i, c in enumerate(text):
        if c == "-":
            gaps, inside = gaps + 1, True
            continue
        if inside:
            if gaps > 10:
                cut = i
            else:
                skips += 1
            if skips > 3:
                break
            chars = gaps = 0
        chars += 1
        if chars > 4:
            break
    return cut


def test_trim_equals_the_scan(spark):
    rng = random.Random(8)
    texts = ["", "-", "A", "A" + "-" * 12 + "B", "-" * 30, "A" + "-" * 11, "-" * 11 + "A", "AB" + "-" * 11 + "C" + "-" * 11 + "D", "A" + "-" * 12 + "BCDE" + "-" * 12 + "F"]
    texts += ["".join(rng.choice("AC") * rng.randrange(1, 7) if rng.random() < 0.5 else "-" * rng.randrange(1, 16) for _ in range(rng.randrange(1, 12))) for _ in range(300)]
    rows = msa.trimmed(spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, consensus string")).collect()
    for r in rows:
        if r.consensus is None:
            assert r.first is None and r.end is None
            continue
        size, back = len(r.consensus), slow_trim(r.consensus[:0:-1])  # the first character is not looked at
        assert (r.first, r.end) == (slow_trim(r.consensus), size - 1 - back if back else size), r.consensus


def test_consensus_worked_cases(spark):
    columns = {"AAC-": "A", "A---": "-", "AC--": "-", "AG-C": "A", "AGC-": "A", "---A": "-", "--AA": "A", "--AC": "-", "DEKR": "D", "KRDN": "D", "A": "-", "AA": "A", "-AAC": "A"}
    rows = [(name, i, letter) for name, text in [(k, k) for k in columns] for i, letter in enumerate(text)]
    members = spark.createDataFrame(rows, "cluster string, member int, aligned string")
    counts = members.select("cluster", F.lit(1).alias("pos"), F.col("aligned").alias("letter")).groupBy("cluster", "pos", "letter").count().withColumnRenamed("count", "n")
    plain = {r.cluster: r.consensus for r in msa.consensus(counts).collect()}
    assert plain == columns
    matrix = spark.createDataFrame([("D", "E", 2.0), ("D", "N", 1.0), ("A", "A", 4.0), ("A", "G", 0.0), ("C", "G", 3.0)], "a string, b string, score double")
    related = {r.cluster: r.consensus for r in msa.consensus(counts, matrix).collect()}
    assert related["KRDN"] == "D" and related["AG-C"] == "C" and related["DEKR"] == "D" and related["--AC"] == "-"
    assert msa.consensus(counts.limit(0)).count() == 0


def test_size_bins():
    assert C.size_bins(2) == [(2, 2), (3, 5), (6, 10), (11, 15), (16, 20), (21, 25), (26, 30), (31, None)]
    assert C.size_bins(7) == [*[(i, i) for i in range(2, 8)], (8, 10), (11, None)] and C.size_bins(9)[-1] == (51, None)


def test_tables_with_hits_keep_rows_without_one(spark):
    base = spark.createDataFrame([(1, 7), (2, None), (3, 8)], "seq_id long, hit_id long")
    details = spark.createDataFrame([(7, "kinase", "x")], "hit_id long, description string, other string")
    members = spark.createDataFrame([(1, "m", 5), (1, "n", 6)], "seq_id long, cluster string, hit_id long")
    view = with_hits(base, details, "sequence", more={"member": (members, ["seq_id"])})
    assert [f.name for f in view.fields] == ["seq_id", "hit_id", "cluster", "hit_description"]
    got = view.select(["seq_id", "hit_id", "hit_description", "cluster"]).collect()
    assert {tuple(r) for r in got} == {(1, 7, "kinase", "m"), (1, 7, "kinase", "n"), (2, None, None, None), (3, 8, None, None)}


def test_annotated_hits(spark):
    entries = spark.createDataFrame([(1, "K1", None), (1, "K0", "PF")], "hit_id long, kegg string, pfam string")
    rows = O.annotated(spark.createDataFrame([(1, "a"), (1, "a"), (2, "b"), (None, "c")], "hit_id long, name string"), entries)
    assert {(r.hit_id, r.kegg, r.pfam) for r in rows.collect()} == {(1, "K0", "PF"), (2, "", ""), (None, "", "")}
    assert {(r.kind, r.n_hits) for r in O.annotation_counts(rows).collect()} == {("kegg", 1), ("pfam", 1)}
    assert {(r.kind, r.n_hits) for r in O.annotation_counts(rows.limit(0)).collect()} == {("kegg", 0), ("pfam", 0)}
