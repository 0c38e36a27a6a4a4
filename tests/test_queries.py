"""Every query against its SQL on the small tables, and queries without SQL against invariants."""

from __future__ import annotations

import math
from collections import defaultdict

import duckdb
import pytest

from strandlake import queries as Q

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, con, name):
    df = Q.QUERIES[name](spark, SF)
    rel = con.sql(Q.ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(rel.columns)
    want = rel.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in df.select(columns).collect()]
    assert sorted(tuple(map(plain, r)) for r in got) == sorted(tuple(map(plain, r)) for r in want)


def edges_of(spark):
    from strandlake.queries import clusters

    return {frozenset((r.seq1, r.seq2)) for r in clusters.edge_filter(spark, SF).collect()}


@pytest.mark.parametrize("name", ["c04_complete_linkage", "c05_cliques"])
def test_clusters_are_disjoint_cliques(spark, name):
    edges, groups = edges_of(spark), defaultdict(list)
    for r in Q.QUERIES[name](spark, SF).collect():
        groups[r.cluster].append(r.seq)
    members = [s for g in groups.values() for s in g]
    assert len(members) == len(set(members)) and groups
    for g in groups.values():
        assert len(g) > 1 and all(frozenset((a, b)) in edges for a in g for b in g if a < b)


def test_regions_equal_brute_force(spark):
    from strandlake.queries.roles import hits

    of = defaultdict(list)
    for r in hits(spark, SF).collect():
        of[r.seq_id].append(r)
    inside = lambda a, b: a.frame == b.frame and a.seq_start >= b.seq_start - 2 and a.seq_end <= b.seq_end + 2
    want = set()
    for seq, group in of.items():
        group.sort(key=lambda r: (-r.bits, r.evalue, r.hit_id))
        gone = set()
        for i, a in enumerate(group):
            for j in range(i + 1, len(group)):
                if i in gone:
                    break
                if j not in gone:
                    gone |= {j} if inside(group[j], a) else {i} if inside(a, group[j]) else set()
        want |= {(seq, r.hit_id) for i, r in enumerate(group) if i not in gone}
    got = [(r.seq_id, r.hit_id) for r in Q.QUERIES["j09_distinct_regions"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_hit_ids_are_unique(spark):
    from strandlake.queries.roles import hits

    assert hits(spark, SF).groupBy("seq_id", "hit_id").count().where("count > 1").count() == 0


@pytest.mark.parametrize("name", ["b01_b04_alignment"])
def test_query_has_rows(spark, name):
    assert Q.QUERIES[name](spark, SF).count() > 0
