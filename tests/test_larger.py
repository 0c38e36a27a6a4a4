"""Queries on tables whose keys and counts go beyond those of the test tables, and steps that grow with them."""

from __future__ import annotations

import math
import os
import random
import re

import duckdb
import pytest

from strandlake import queries as Q
from strandlake.operators import clusters as C
from strandlake.operators import hits as H
from strandlake.operators import msa as M
from strandlake.operators import ontology as O
from strandlake.operators import pairs as P

SF = "/root/testdata/sf0.001"


def same_as_sql(spark, folder, name):
    con = duckdb.connect()
    for t in os.listdir(folder):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{folder}/{t}'").fetchall()
    df = Q.QUERIES[name](spark, str(folder))
    columns = sorted(df.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({Q.ORACLE_SQL[name]})").fetchall()
    got = [tuple(r) for r in df.select(columns).collect()]
    assert got and sorted(map(repr, got)) == sorted(map(repr, want))


def written(folder, table, replaced):
    duckdb.connect().execute(f"COPY (SELECT * REPLACE ({replaced}) FROM '{SF}/{table}.parquet') TO '{folder}/{table}.parquet' (FORMAT parquet)").fetchall()


def test_pair_set_with_numbers_of_more_digits(spark, tmp_path):
    written(tmp_path, "lineitem", "l_partkey + 99900 AS l_partkey")
    same_as_sql(spark, tmp_path, "b14_pair_set")


def test_sample_filter_falls_back_to_the_last_condition(spark, tmp_path):
    written(tmp_path, "orders", "CASE WHEN o_orderkey % 9 = 0 THEN 5 ELSE 495000 END AS o_totalprice, 'O' AS o_orderstatus")
    same_as_sql(spark, tmp_path, "l04_sample_filter")


def test_snps_of_deep_columns(spark):
    def tail(n, depth, q):
        terms = [math.lgamma(depth + 1) - math.lgamma(k + 1) - math.lgamma(depth - k + 1) + k * math.log(q) + (depth - k) * math.log1p(-q) for k in range(n, depth + 1)]
        return math.fsum(map(math.exp, terms))

    cases = [(2, 1), (5, 3), (9, 8), (40, 2), (300, 15), (300, 150), (60_000, 1_900), (60_000, 2_000), (60_000, 2_100), (60_000, 29_000), (60_000, 2)]
    bases = spark.createDataFrame([(i, 1, b, n) for i, (depth, few) in enumerate(cases) for b, n in (("A", max(depth - few, few)), ("C", min(few, depth - few)))], "contig int, pos int, base string, n int")
    got = {r.contig: r for r in M.snps(bases, error=0.1, least=1, threshold=2.0).collect()}
    assert len(got) == len(cases)
    for r in got.values():
        assert r.p == pytest.approx(tail(r.n, r.depth, 0.1 / 3), rel=1e-7, abs=1e-300)


@pytest.mark.parametrize("common", [1, 3, 30])
def test_shared_hit_equals_brute_force(spark, common):
    dice = random.Random(5)
    bits = {(s, h): dice.randint(1, 4) for s in range(40) for h in range(60) if dice.random() < (0.4 if h < 5 else 0.06)}
    pairs = {(a, b) for a in range(40) for b in range(40) if dice.random() < 0.4}
    want = set()
    for a, b in pairs:
        both = [(bits[a, h] + bits[b, h], -h) for h in range(60) if (a, h) in bits and (b, h) in bits]
        want |= {(a, b, -max(both)[1])} if both else set()
    hits = spark.createDataFrame([(*k, v) for k, v in bits.items()], "seq_id long, hit_id long, bits int")
    got = H.shared_hit(spark.createDataFrame(sorted(pairs), "seq1 long, seq2 long"), hits, common).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_rounds_of_the_graph_do_not_broadcast(spark, monkeypatch):
    plans = []
    cut = O.cut

    def recorded(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(O, "cut", recorded)
    edges = spark.createDataFrame([(i, i // 2, 1) for i in range(2, 200)], "child int, parent int, rel int")
    start = spark.createDataFrame([(1,)], "gonum int")
    assert O.closure(edges).count() == sum(i.bit_length() - 1 for i in range(2, 200))
    assert O.levels(edges, start).count() == 199
    assert O.root_paths(edges, edges.selectExpr("child AS gonum")).count() == 198
    assert plans and not any("BroadcastExchange" in p for p in plans)


def shortest(edges):
    """Of each pair its least number of steps, and the smallest rel on such a way."""
    ways, found = {(c, p): r for c, p, r in sorted(edges, reverse=True)}, {}
    steps, n = dict(ways), 1
    while ways:
        found |= {k: (r, n) for k, r in ways.items()}
        longer, n = {}, n + 1
        for (c, a), r in ways.items():
            for (x, p), q in steps.items():
                if x == a and (c, p) not in found:
                    longer[c, p] = min(longer.get((c, p), 9), r, q)
        ways = longer
    return found


@pytest.mark.parametrize("shape", ["random", "cycle", "chain"])
def test_closure_equals_brute_force(spark, shape):
    dice = random.Random(3)
    edges = {
        "random": sorted({(c, dice.randrange(c), dice.randint(1, 2)) for c in range(1, 40) for _ in range(2)}),
        "cycle": [(i, (i + 1) % 11, 1 + i % 2) for i in range(11)] + [(20, 3, 2), (4, 21, 1)],
        "chain": [(i, i - 1, 1 + i % 2) for i in range(1, 20)] + [(i, i - 3, 2) for i in range(3, 20, 4)],
    }[shape]
    rows = O.closure(spark.createDataFrame(edges, "child int, parent int, rel int")).collect()
    assert {(r.child, r.ancestor): (r.rel, r.distance) for r in rows} == shortest(edges) and len(rows) == len(shortest(edges))


def test_closure_ends_where_ways_are_too_long(spark):
    edges = spark.createDataFrame([(i, i - 1, 1) for i in range(1, 7)], "child int, parent int, rel int")
    assert O.closure(edges, most=6).count() == 21
    with pytest.raises(ValueError):
        O.closure(edges, most=5)


def test_closure_writes_each_way_once(spark, monkeypatch):
    rows = []
    cut = O.cut

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    monkeypatch.setattr(O, "cut", counted)
    pairs = O.closure(spark.createDataFrame([(i, i // 2, 1) for i in range(2, 200)], "child int, parent int, rel int")).count()
    assert sum(rows) == pairs


def test_inherited_terms_equal_brute_force_and_broadcast_nothing(spark):
    dice = random.Random(9)
    direct = sorted({(h, dice.randint(1, 40), dice.choice(["IDA", "IEA", "TAS"])) for h in range(30) for _ in range(3)} | {(1, 99, "IBA"), (2, 99, None), (3, 40, None)}, key=repr)
    up = {g: {g >> i for i in range(1, g.bit_length())} for g in range(1, 41)}
    want = {}
    for h in {d[0] for d in direct}:
        own, above = {}, {}
        for _, g, ec in (d for d in direct if d[0] == h):
            own.setdefault(g, set()).add(ec)
            for a in up.get(g, ()):
                above.setdefault(a, set()).add(ec)
        least = lambda codes: min((c for c in codes if c), default=None)
        want |= {(h, g): (least(above[g]) and f"({least(above[g])})", False) for g in above if g not in own} | {(h, g): (least(own[g]), True) for g in own}
    paths = spark.createDataFrame([(g, a) for g in up for a in up[g]], "child int, ancestor int")
    df = O.inherited_terms(spark.createDataFrame(direct, "hit_id long, gonum int, ec string"), paths)
    rows = df.collect()
    assert {(r.hit_id, r.gonum): (r.ec, r.is_direct) for r in rows} == want and len(rows) == len(want)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan
    assert not re.search("Exchange", plan[: plan.index("posexplode")])


def test_evidence_broadcasts_nothing(spark):
    df = Q.QUERIES["a07_evidence"](spark, SF)
    assert df.collect()
    assert "BroadcastExchange" not in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("order", ["bits", "evalue"])
def test_sequence_terms_equal_brute_force(spark, order):
    dice = random.Random(7)
    hits = [(s, h, float(dice.randint(1, 3)), dice.randint(0, 2) / 10) for s in range(30) for h in dice.sample(range(25), 4)]
    direct = sorted({(h, dice.randint(1, 40)) for h in range(20) for _ in range(2)})
    up = {g: {g >> i for i in range(1, g.bit_length())} for g in range(1, 41)}
    want = {}
    for s, h, bits, evalue in hits:
        place = (-bits, evalue, h) if order == "bits" else (evalue, -bits, h)
        for g in (g for x, g in direct if x == h):
            for t in {g} | up[g]:
                old, is_direct = want.get((s, t), (None, False))
                want[s, t] = (min(old or (place, h, evalue), (place, h, evalue)), is_direct or t == g)
    frames = spark.createDataFrame(hits, "seq_id long, hit_id long, bits double, evalue double"), spark.createDataFrame([(*d, "IEA") for d in direct], "hit_id long, gonum int, ec string")
    paths = spark.createDataFrame([(g, a) for g in up for a in up[g]], "child int, ancestor int")
    for only in (None, range(1, 6)):
        kept = None if only is None else spark.createDataFrame([(g,) for g in only], "gonum int")
        got = {(r.seq_id, r.gonum): (r.hit_id, r.evalue, r.is_direct) for r in O.sequence_terms(*frames, paths, order, kept).collect()}
        assert got == {k: (b[1], b[2], d) for k, (b, d) in want.items() if only is None or k[1] in only}


def test_unfolded_terms_are_not_grouped(spark):
    hits = spark.createDataFrame([(1, 2, 3.0, 0.1), (1, 3, 3.0, 0.0), (2, 3, 1.0, 0.0)], "seq_id long, hit_id long, bits double, evalue double")
    direct = spark.createDataFrame([(2, 4, "IEA"), (3, 5, "IEA"), (3, 2, "IDA")], "hit_id long, gonum int, ec string")
    paths = spark.createDataFrame([(4, 2), (4, 1), (5, 2), (5, 1), (2, 1)], "child int, ancestor int")
    df = O.sequence_terms(hits, direct, paths)
    assert {tuple(r) for r in df.collect()} == {(1, 5, 3, 0.0, True), (1, 2, 3, 0.0, True), (1, 1, 3, 0.0, False), (1, 4, 2, 0.1, True), (2, 5, 3, 0.0, True), (2, 2, 3, 0.0, True), (2, 1, 3, 0.0, False)}
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("posexplode")]
    assert not re.search("Aggregate|Window|Join|Repartition", above)


def test_rounds_of_components_do_not_broadcast(spark, monkeypatch):
    plans = []
    cut = C.cut

    def recorded(df):
        out = cut(df)
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return out

    monkeypatch.setattr(C, "cut", recorded)
    best = spark.createDataFrame([(3 * i + a, 3 * i + b) for i in range(50) for a, b in ((0, 1), (0, 2), (1, 2))] + [(900, 901), (901, 902)], "seq1 int, seq2 int")
    assert C.mutual_sets(best, 3).count() == 150
    assert plans and not any("BroadcastExchange" in p for p in plans)


def test_longest_root_paths_equal_pairs_of_paths_and_are_not_compared(spark, monkeypatch):
    dice = random.Random(9)
    edges = {(c, p, dice.choice((1, 1, 2, 3))) for c in range(2, 40) for p in dice.sample(range(1, c), min(c - 1, 3 if c < 24 else 2))}
    rows = spark.createDataFrame(sorted(edges) + [(31, 5, 2), (31, 5, 1)], "child int, parent int, rel int")
    start = spark.createDataFrame([(i,) for i in (1, 2, 9, 17, 22, 31, 39, 39, 77)], "gonum int")
    want = sorted((r.start, r.path) for r in O.longest_paths(O.root_paths(rows, start)).collect())
    assert len(want) < O.root_paths(rows, start).count()
    monkeypatch.setattr(O, "_part_of", None)  # without a cycle, nothing is compared
    assert sorted((r.start, r.path) for r in O.longest_root_paths(rows, start).collect()) == want


def test_longest_root_paths_of_a_braid_with_detours(spark):
    # 4**7 ways from the start, each of whose links can be passed by, are not compared in pairs.
    edges = [(10 * i + 10, 10 * i + k, 1) for i in range(7) for k in range(1, 5)] + [(10 * i + k, 10 * i, 1) for i in range(7) for k in range(1, 5)] + [(10 * i + 10, 10 * i, 2) for i in range(7)]
    paths = O.longest_root_paths(spark.createDataFrame(edges, "child int, parent int, rel int"), spark.createDataFrame([(70,)], "gonum int"))
    assert [tuple(r) for r in paths.selectExpr("size(path) AS n").groupBy("n").count().collect()] == [(15, 4**7)]


def test_longest_root_paths_beside_a_cycle(spark):
    rows = spark.createDataFrame([(2, 1, 1), (3, 2, 1), (4, 3, 1), (3, 4, 1), (4, 1, 1), (6, 5, 1), (5, 6, 1)], "child int, parent int, rel int")
    got = O.longest_root_paths(rows, spark.createDataFrame([(4,), (3,), (6,)], "gonum int")).collect()
    assert sorted((r.start, r.path) for r in got) == [(3, [1, 2, 3]), (3, [1, 4, 3]), (4, [1, 2, 3, 4])]


@pytest.mark.parametrize("name", ["d08_f16_recounted_terms", "f16_recounted_all"])
def test_terms_are_recounted_without_best_hits_of_all_sequences(spark, monkeypatch, name):
    monkeypatch.setattr(O, "sequence_terms", None)
    same_as_sql(spark, SF, name)


def test_recounted_hits_equal_recounted_terms(spark):
    dice = random.Random(4)
    hits = spark.createDataFrame([(s, h, float(dice.randint(1, 9)), 0.1) for s in range(40) for h in dice.sample(range(30), 5)] + [(None, 1, 1.0, 0.1)], "seq_id int, hit_id int, bits double, evalue double")
    direct = spark.createDataFrame([(h, g) for h in range(25) for g in dice.sample(range(2, 40), 2)] + [(1, 7), (1, 7)], "hit_id int, gonum int")
    paths = O.closure(spark.createDataFrame([(c, c // 2, 1) for c in range(2, 40)] + [(c, c // 3, 2) for c in range(3, 40, 3)], "child int, parent int, rel int"))
    values = spark.createDataFrame([(c, s, dice.choice((0.01, -0.02, 0.3, None))) for s in range(60) for c in ("a", "b")] + [("a", None, 0.01)], "column string, seq_id int, p double")
    terms = O.sequence_terms(hits, direct, paths)
    for how, direction, least in (("any", "up", 3), ("all", "either", 1), ("any", "down", 1)):
        rest = (values, {"a": 0.05, "b": 0.05}, how, direction, least)
        want = {tuple(r) for r in O.recounted(terms, *rest).collect()}
        got = [tuple(r) for r in O.recounted_hits(hits, direct, paths, *rest).collect()]
        assert want and set(got) == want and len(got) == len(want)


def test_pairs_get_their_shared_hit_and_are_read_once(spark):
    dice = random.Random(6)
    pairs = spark.createDataFrame([(a, b, a * b) for a in range(30) for b in range(a, 30) if dice.random() < 0.6], "seq1 int, seq2 int, sim int").repartition("seq1", "seq2")
    hits = spark.createDataFrame(sorted({(dice.randrange(30), h): float(dice.randint(1, 5)) for h in range(40) for _ in range(3)}.items()), "k struct<s:int,h:int>, bits double").selectExpr("k.s AS seq_id", "k.h AS hit_id", "bits")
    for common in (30, 2, 1):
        want = pairs.join(H.shared_hit(pairs, hits), ["seq1", "seq2"], "left")
        got = H.with_shared_hit(pairs, hits, common)
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.where("hit_id IS NULL").head(1)
    plan = H.with_shared_hit(pairs, hits)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sim#") and len(re.findall(r"RepartitionByExpression", plan)) == 1


def test_inherited_terms_of_hits_go_to_sequences_in_order(spark):
    edges = [(c, p) for c in range(2, 120) for p in {c // 2, c // 3} if p]
    paths = O.closure(spark.createDataFrame([(c, p, 1) for c, p in edges], "child int, parent int, rel int"))
    rows = O._terms_of_hits(spark.createDataFrame([(g % 50, g) for g in range(40, 120)], "hit_id int, gonum int"), paths).collect()
    assert len(rows) == 50 and all(list(r._above) == sorted(set(r._above) - set(r._own)) for r in rows)


def test_mutual_sets_beside_a_long_chain_need_no_rounds(spark, monkeypatch):
    def rounds(edges, most=60):
        raise AssertionError("mutual sets were sought in rounds")

    monkeypatch.setattr(C, "components", rounds)
    chain = [(1000 + i * 7919 % 4999, 1000 + (i + 1) * 7919 % 4999) for i in range(4998)]
    sets = [(1, 2), (1, 3), (3, 2), (2, 3), (4, 5), (5, 6), (4, 6), (6, 7), (8, 9), (9, 10), (11, 12), (12, 13), (11, 13), (11, 11)]
    got = [tuple(r) for r in C.mutual_sets(spark.createDataFrame(chain + sets, "seq1 int, seq2 int"), 3).collect()]
    assert sorted(got) == [(1, 1), (1, 2), (1, 3), (11, 11), (11, 12), (11, 13)]


def test_correlation_shuffles_pairs_and_not_their_libraries(spark):
    dice = random.Random(3)
    levels = [(s, lib, float(dice.randint(0, 9))) for s in range(20) for lib in "ABCDEF" if dice.random() < 0.8] + [(0, "A", 4.0), (1, None, 2.0), (2, None, 2.0)]
    pairs = [(a, b) for a in range(20) for b in range(a + 1, 20)]
    want = {}
    for a, b in pairs:
        xy = [(x, y) for s, k, x in levels if s == a for t, m, y in levels if t == b and k == m and k]
        n, sx, sy = len(xy), sum(x for x, _ in xy), sum(y for _, y in xy)
        vx, vy = n * sum(x * x for x, _ in xy) - sx * sx, n * sum(y * y for _, y in xy) - sy * sy
        if n:
            want[a, b] = (n, (n * sum(x * y for x, y in xy) - sx * sy) / math.sqrt(vx * vy) if vx > 0 and vy > 0 else 0.0)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = P.correlation(spark.createDataFrame(pairs, "seq1 int, seq2 int"), spark.createDataFrame(levels, "seq_id int, lib string, value double"))
        got = {(r.seq1, r.seq2): (r.n_libs, pytest.approx(r.pcc)) for r in found.collect()}
        assert got == want
        assert not re.search(r"hashpartitioning\(seq1#\d+, seq2#\d+", found._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
