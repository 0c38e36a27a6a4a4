"""Small cases with results worked out by hand."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from strandlake.functions import descriptions as D
from strandlake.functions import sequences as Q
from strandlake.functions.logic import in_range, like
from strandlake.functions.numbers import fold_change, frame_of, ratio, shared_ratio
from strandlake.operators import alignment, clusters, expression, hits, msa, ontology, pairs, stats


def one(spark, column, **values):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]).select(column.alias("x")).first().x


def test_tpm_and_rpkm(spark):
    counts = spark.createDataFrame([(1, "a", 0, 10), (2, "a", 0, 20)], "seq_id long, lib string, rep int, n long")
    lengths = spark.createDataFrame([(1, 1000), (2, 2000)], "seq_id long, len int")
    assert [r.tpm for r in expression.tpm(counts, lengths).orderBy("seq_id").collect()] == pytest.approx([500000, 500000])
    sizes = spark.createDataFrame([("a", 10**6)], "lib string, size long")
    assert [r.rpkm for r in expression.rpkm(counts, lengths, sizes).orderBy("seq_id").collect()] == pytest.approx([10, 10])


def test_r_statistic(spark):
    counts = spark.createDataFrame([(1, "a", 0, 10), (1, "b", 0, 0)], "seq_id long, lib string, rep int, n long")
    sizes = spark.createDataFrame([("a", 100), ("b", 100)], "lib string, size long")
    assert expression.r_statistic(counts, sizes).first().r_stat == 3.0


def test_fold(spark):
    assert one(spark, fold_change(F.lit(1.9), F.lit(0.9))) == pytest.approx(2)
    assert one(spark, fold_change(F.lit(1.9), F.lit(0.9), log=True)) == pytest.approx(1)
    assert one(spark, fold_change(F.lit(0.9), F.lit(1.9))) == pytest.approx(-2)


@pytest.mark.parametrize("values, want", [([1, 2, 3, 4, 5], (1.5, 3, 4.5)), ([1, 2, 3, 4], (1.5, 2.5, 3.5)), ([7], (7, 7, 7)), ([1, 1, 1, 9], (1, 1, 5)), ([1, 2, 3], (1, 2, 3))])
def test_quartiles(spark, values, want):
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None)], "g string, v double")
    assert tuple(stats.quartiles(df, "g", "v").first())[2:] == want


def test_correlation(spark):
    levels = spark.createDataFrame([(1, "a", 1.0), (1, "b", 2.0), (1, "c", 3.0), (1, "d", None), (2, "a", 2.0), (2, "b", 4.0), (2, "c", 6.0), (2, "d", 9.0), (3, "a", 5.0), (3, "b", 5.0), (3, "c", 5.0)], "seq_id long, lib string, value double")
    rows = pairs.correlation(spark.createDataFrame([(1, 2), (1, 3)], "seq1 long, seq2 long"), levels).orderBy("seq2").collect()
    assert [(r.n_libs, round(r.pcc, 9)) for r in rows] == [(3, 1.0), (3, 0.0)]


def test_sequences(spark):
    assert one(spark, Q.cpg_observed_expected(F.lit("ccgg"))) == 1.0 and one(spark, Q.cpg_percent(F.lit("ccgg"))) == 50
    assert one(spark, Q.reverse_complement(F.lit("aCGTn"))) == "nACGt"
    assert one(spark, Q.translate(F.lit("ATGGCATAANN"))) == "MA*" and one(spark, Q.translate(F.lit("TGCCAT"), -1)) == "MA"
    assert one(spark, Q.gap_text(Q.gap_map(F.lit("ac--gt-")))) == "2-2:6-1" and one(spark, Q.gap_text(Q.gap_map(F.lit("acgt")))) == "0"
    assert one(spark, Q.with_gaps(F.lit("acgt"), Q.parse_gap_text(F.lit("2-2:6-1")))) == "ac--gt-"
    assert one(spark, frame_of(F.lit(4), F.lit(90), F.lit(92))) == 1 and one(spark, frame_of(F.lit(90), F.lit(4), F.lit(92))) == -3


def test_ratios(spark):
    assert one(spark, shared_ratio(F.lit(0), F.lit(0))) == 1 and one(spark, shared_ratio(F.lit(1), F.lit(2))) == 0.5
    assert one(spark, ratio(F.lit(0.0), F.lit(3))) == 0 and one(spark, ratio(F.lit(1.0), F.lit(0))) == -2


def test_descriptions(spark):
    words = {"Os03g0850800": True, "emp24/gp25l": False, "abc1": False}
    assert all(one(spark, D.is_name(F.lit(w))) == v for w, v in words.items())
    good = {
        "Uncharacterized protein": False, "Kinase": True, "protein Os03g0850800": False, "Os03g0850800 kinase": True, "Hypothetical_protein": False,
        "kinase {hypothetical protein}": True, "expressed protein": False, "highly expressed protein": True, "low quality protein": False,
        "cDNA clone 5": False, "a cDNA clone 5": True, "genome assembly, chromosome 1": False, "ORF123": False, "orf like": True, "  ": False,
        "uncharacterized conserved thing": False, "Os03g0850800": False,
    }
    assert all(one(spark, D.is_good(F.lit(w))) == v for w, v in good.items())
    assert one(spark, D.brief(F.lit("Probable zinc finger protein {ECO:1}"))) == "zinc finger"
    assert one(spark, D.go_number(F.lit("GO:0016020"))) == 16020 and one(spark, D.go_id(F.lit(16020))) == "GO:0016020"
    assert one(spark, D.brief(F.lit("Putative Kinase A B"))) == "kinase a"
    forms = {
        "Kinase-like 12": "kinase-like", "Kinase-like": "kinase", "like-like B-like": "like b", "protein Os03g0850800": "protein os03g085080",
        "big protein Os03g0850800": "big protein", "Probable kinase 7 {ECO:1}": "kinase", "Uncharacterized protein": "protein", "kinase-12": "kinase",
        "kinase_a 123": "kinase_a 12", "P 1": "p 1", "kinase5": "kinase", "kinase-5 a": "kinase-5 a",
    }
    assert {w: one(spark, D.unique_form(F.lit(w))) for w in forms} == forms


def test_ranges_and_search(spark):
    df = spark.createDataFrame([(i, f"a_{i}") for i in range(5)], "v int, s string")
    assert [r.v for r in df.where(in_range(F.col("v"), 1, 3)).collect()] == [1, 2] and [r.v for r in df.where(in_range(F.col("v"), 2, 2)).collect()] == [2]
    assert df.where(like(F.col("s"), "A_3")).count() == 1 and df.where(like(F.col("s"), "a%4")).count() == 1 and df.where(like(F.col("s"), "aX3")).count() == 0


HIT = "seq_id long, hit_id long, db int, bits double, evalue double, sim double, dbtype string, taxonomy string, description string, species string, is_aa boolean, rank int"


def test_best_annotation(spark):
    rows = [(1, 1, 0, 200.0, 0.0, 90.0, "TR", "p", "Uncharacterized protein", "a b", True, 1), (1, 2, 1, 150.0, 0.0, 90.0, "TR", "p", "Kinase", "a b", True, 1), (1, 3, 2, 110.0, 0.0, 90.0, "SP", "p", "Ligase", "c d", True, 1)]
    df = spark.createDataFrame(rows, HIT)
    best = lambda out, c: [r.hit_id for r in out.where(c).collect()]
    assert best(hits.with_flags(df), "best_bits") == [1] and best(hits.with_flags(df), "best_anno") == [2]
    assert best(hits.with_flags(df, prefer="SP"), "best_anno") == [3]
    third = hits.with_flags(df.withColumn("rank", F.lit(4)))
    assert {r.hit_id: (r["rank"], r.best_rank) for r in third.collect()} == {1: (1, True), 2: (1, True), 3: (4, False)}


def test_regions(spark):
    rows = [(1, 1, 90.0, 0.0, 1, 100, 1), (1, 2, 80.0, 0.0, 10, 90, 1), (1, 3, 70.0, 0.0, 80, 200, 1)]
    df = spark.createDataFrame(rows, "seq_id long, hit_id long, bits double, evalue double, seq_start int, seq_end int, frame int")
    assert sorted(r.hit_id for r in hits.distinct_regions(df).collect()) == [1, 3]
    wide = spark.createDataFrame([(1, 4, 60.0, 0.0, 70, 220, 1), (1, 5, 50.0, 0.0, 70, 220, 1), (2, 6, 50.0, 0.0, 220, 70, 1), (2, 7, 40.0, 0.0, 70, 220, 1)], df.schema)
    assert sorted(r.hit_id for r in hits.distinct_regions(df.union(wide)).collect()) == [1, 4, 6, 7]
    assert hits.distinct_regions(df.limit(0)).count() == 0


EDGES = [(2, 1, 1), (3, 1, 1), (4, 2, 1), (4, 3, 1), (5, 4, 1), (5, 1, 1)]


def test_levels_closure_and_inheritance(spark):
    edges = spark.createDataFrame(EDGES, "child int, parent int, rel int")
    assert {r.gonum: r.level for r in ontology.levels(edges, spark.createDataFrame([(1,)], "gonum int")).collect()} == {1: 1, 2: 2, 3: 2, 4: 3, 5: 4}
    paths = ontology.closure(edges)
    assert {r.ancestor for r in paths.where("child = 5").collect()} == {4, 2, 3, 1}
    direct = spark.createDataFrame([("h", 5, "IEA")], "hit_id string, gonum int, ec string")
    rows = ontology.inherited_terms(direct, paths).collect()
    assert {(r.gonum, r.ec) for r in rows} == {(5, "IEA"), (4, "(IEA)"), (3, "(IEA)"), (2, "(IEA)"), (1, "(IEA)")}
    cycle = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (3, 1, 1), (1, 0, 1)], "child int, parent int, rel int")
    with pytest.raises(ValueError):
        ontology.levels(cycle.union(spark.createDataFrame([(2, 0, 1)], cycle.schema)), spark.createDataFrame([(0,)], "gonum int"), most=6)


PAIR = "seq1 string, seq2 string, ds1 int, ds2 int, evalue double, sim double"


def test_best_pairs_and_sets(spark):
    df = spark.createDataFrame([("a1", "b1", 1, 2, 1e-50, 90.0), ("a1", "b2", 1, 2, 1e-20, 90.0), ("a2", "b1", 1, 2, 1e-30, 90.0)], PAIR)
    assert [tuple(r) for r in clusters.reciprocal_best(df).collect()] == [("a1", "b1")]
    best = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "c"), ("d", "e"), ("e", "f")], "seq1 string, seq2 string")
    assert sorted(r.seq for r in clusters.mutual_sets(best, 3).collect()) == ["a", "b", "c"]


def test_closure_and_cliques(spark):
    df = spark.createDataFrame([("a", "b", 2, 1e-9, 90.0), ("b", "c", 2, 1e-8, 80.0), ("a", "c", 2, 1e-7, 70.0), ("c", "d", 2, 1e-6, 60.0)], "seq1 string, seq2 string, best int, evalue double, bits double")
    for made in (clusters.complete_linkage(df), clusters.cliques(df)):
        assert sorted(r.seq for r in made.collect()) == ["a", "b", "c"]


def test_taxa(spark):
    rows = [("x", 1), ("x", 2), ("y", 1), ("y", 1), ("y", 2), ("z", 1), ("z", 1), ("z", 1)]
    assert {r.cluster: r.taxa for r in clusters.taxa(spark.createDataFrame(rows, "cluster string, ds int")).collect()} == {"x": "2x1", "y": "2xN", "z": "1xN"}


def test_msa(spark):
    same = spark.createDataFrame([("k", 1, "ACGT"), ("k", 2, "ACGT")], "cluster string, member int, aligned string")
    assert msa.entropy(msa.letter_counts(same), same).first().conservation == pytest.approx(1)
    rows = spark.createDataFrame([("k", i, "A" * n) for i, n in enumerate([2, 4, 4, 4, 5, 5, 7, 9])], "cluster string, member int, aligned string")
    assert round(msa.length_sd(rows).first().sd_len, 3) == 2.138


def test_kaks_class_and_de_order(spark):
    df = spark.createDataFrame([(None, True), (0.5, False), (0.999, False), (1.2, False)], "k double, na boolean")
    assert [r[0] for r in df.select(pairs.kaks_class(F.col("k"), F.col("na"))).collect()] == ["NA", "<1", "~1", ">1"]
    p = spark.createDataFrame([(0.2,), (None,), (-0.01,), (0.01,)], "p double")
    assert [r.p for r in p.orderBy(*stats.table_order("p", "de")).collect()] == [0.01, -0.01, 0.2, None]
    assert [r.p for r in p.orderBy(*stats.table_order("p", "de", ascending=False)).collect()] == [0.2, 0.01, -0.01, None]


def test_terms_per_cluster(spark):
    members = spark.createDataFrame([("c1", 1), ("c1", 2), ("c2", 3)], "group string, seq_id long")
    seq_terms = spark.createDataFrame([(1, 7, 0.0), (2, 7, 0.0), (3, 7, 0.0)], "seq_id long, gonum int, evalue double")
    terms = spark.createDataFrame([(7, "t", "BP", 2)], "gonum int, name string, domain string, level int")
    assert ontology.terms_per_group(members, seq_terms, terms).first().n_groups == 2


def test_alignment(spark):
    score, a, b = alignment.align("ACGTACGT", "CGTAC")
    assert (round(score, 6), a, b) == (9.0, "ACGTACGT", "-CGTAC--")
    _, a, b = alignment.align("ACGTTTTTTTTACGT" * 2, "ACGTTTTTTACGT" * 2)
    assert len(a) == len(b) and a.replace("-", "") == "ACGTTTTTTTTACGT" * 2 and b.replace("-", "") == "ACGTTTTTTACGT" * 2
    matrix = alignment.parse_matrix(["# m", "   A R *", "A 4 -1 -4", "R -1 5 -4", "* -4 -4 1"])
    assert alignment.align("AR", "AR", matrix)[0] == 9
    df = spark.createDataFrame([("ACGTAC", "ACGGAC"), (None, "A"), ("", "AC")], "text1 string, text2 string")
    rows = {r.text1: r for r in alignment.overlap_scores(alignment.align_pairs(df)).collect()}
    assert (rows["ACGTAC"].matches, rows["ACGTAC"].mismatches, rows["ACGTAC"].gaps) == (5, 1, 0) and rows[None].score is None


def test_overlap_sums(spark):
    texts = [("--ACGT--CA*T-", "TTACCTAA-A*TG"), ("A--", "-CC"), ("", ""), (None, "A"), ("-A-C", "C-GC"), ("ac", "AG")]
    df = spark.createDataFrame([(i, *t, "kept") for i, t in enumerate(texts)], "k int, aligned1 string, aligned2 string, start string")
    got = lambda d: {r.k: (r.overlap_len, r.positives, r.overlap_gaps, r.stops, r.overlap_score, r.start) for r in d.collect()}
    want = {0: (10, 5, 3, 1, 5 - 1 - 7 - 4, "kept"), 1: (0, 0, 0, 0, 0, "kept"), 2: (0, 0, 0, 0, 0, "kept"), 3: (*[None] * 5, "kept"), 4: (1, 1, 0, 0, 1, "kept"), 5: (2, 1, 0, 0, 0, "kept")}
    assert got(alignment.overlap_sums(df)) == want
    assert got(alignment.overlap_sums(df, affine=False))[0][4] == 5 - 1 - 21 - 4
    matrix = alignment.parse_matrix(["   A C X", "A 4 -1 0", "C -1 9 0", "X 0 0 -2"])
    rows = spark.createDataFrame([(0, "ACG-", "AAT-"), (1, "A*", "AC")], "k int, aligned1 string, aligned2 string").withColumn("start", F.lit(""))
    assert got(alignment.overlap_sums(rows, matrix)) == {0: (3, 1, 0, 0, 4 - 1 - 2, ""), 1: (2, 1, 0, 1, 0, "")}


def test_cds_scores(spark):
    r = alignment.cds_scores(spark.createDataFrame([("atggca", "atggcg")], "cds1 string, cds2 string")).first()
    assert (r.codons, r.exact, r.synonymous, r.fourfold, r.ts3, r.tstv) == (2, 1, 1, 1, 1, 0)
    r = one(spark, alignment.fitted_cds(F.lit("M-K"), F.lit("ATGAAA")))
    assert r == "ATG---AAA"


def test_benjamini_hochberg(spark):
    df = spark.createDataFrame([(i, "c", p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, None])], "seq_id long, contrast string, p double")
    got = {r.seq_id: r.adjusted for r in expression.benjamini_hochberg(df).collect()}
    assert got[0] == pytest.approx(0.04) and got[1] == got[2] == pytest.approx(0.16 / 3) and got[3] == 0.5 and got[4] is None


def test_numbered_rows(spark):
    rows = stats.numbered_rows(spark.range(0, 1000, 1, 7).withColumn("k", (F.col("id") * 7) % 1000), F.col("k")).collect()
    assert all(r.row == r.k + 1 for r in rows) and len(rows) == 1000


def test_alignment_in_blocks_is_the_same(monkeypatch):
    rng = random.Random(3)
    for _ in range(40):
        a = "".join(rng.choice("ACGT") for _ in range(rng.randrange(1, 60)))
        b = "".join(c for c in a[rng.randrange(9) :] if rng.random() < 0.9) + "".join(rng.choice("ACGT") for _ in range(rng.randrange(9)))
        whole = alignment.align(a, b)
        monkeypatch.setattr(alignment, "BLOCK_CELLS", 1)
        assert alignment.align(a, b) == whole
        monkeypatch.undo()


def test_large_pairs_are_aligned(spark):
    text = "".join(random.Random(1).choices("ACGT", k=3400))
    row = alignment.align_pairs(spark.createDataFrame([(text, text[100:])], "text1 string, text2 string")).first()
    assert round(row.score, 4) == round(3300 * alignment.NT_MATCH, 4) and row.aligned2 == "-" * 100 + text[100:]


def test_gap_costs():
    from strandlake.operators.alignment import align

    a, b = "ACGTACGTACGTACGTACGT", "ACGTACGTACTACGTACGT"
    score, one, other = align(a, b)
    assert abs(score - (19 * 1.8 - 7.7)) < 1e-9 and one == a and other.replace("-", "") == b and other.count("-") == 1
    left, right = "ACGTTGCAAC" * 3, "GGATCCATTC" * 3
    score, _, other = align(left + "TTT" + right, left + right)
    assert abs(score - (60 * 1.8 - 7 - 3 * 0.7)) < 1e-9 and other.count("-") == 3


def test_complete_linkage_follows_the_order_of_edges(spark):
    """Rounds against one edge after the other, on random graphs with a hub and ties."""
    for seed in (1, 2):
        rng = random.Random(seed)
        rows = {tuple(sorted(rng.sample(range(24), 2))): None for _ in range(130)} | {(0, i): None for i in range(1, 20)}
        edges = [(a, b, 2, rng.choice([0.0, 0.1]), float(rng.randint(1, 4))) for a, b in rows]
        home = {}
        for a, b, *_ in sorted(edges, key=lambda r: (-r[2], r[3], -r[4], r[0], r[1])):
            one, two = home.setdefault(a, {a}), home.setdefault(b, {b})
            if one is not two and all(tuple(sorted((x, y))) in rows for x in one for y in two):
                one |= two
                home.update(dict.fromkeys(two, one))
        want = {(str(min(c)), x) for c in home.values() if len(c) > 1 for x in c}
        df = spark.createDataFrame(edges, "seq1 long, seq2 long, best int, evalue double, bits double")
        assert {tuple(r) for r in clusters.complete_linkage(df).collect()} == want
    assert clusters.complete_linkage(df.limit(0)).count() == 0
