"""Files in, rows out, and back."""

from __future__ import annotations

import pytest

from strandlake.operators import ontology
from strandlake.sources import exports, fasta, tables, uniprot
from strandlake.streaming.incremental import follow


def put(tmp_path, name, text):
    p = tmp_path / name
    p.write_text(text)
    return str(p)


def test_fasta(spark, tmp_path):
    path = put(tmp_path, "a.fa", "# made by hand\n>s1|x first\nacgtacgtac\nACGJ\n\n/skipped\n>s2\r\nACGTACGTA\r\n>short\nACG\n")
    rows = {r.name: r for r in fasta.read_fasta(spark, path).collect()}
    assert {k: r.seq for k, r in rows.items()} == {"s1_x": "ACGTACGTACACGN", "s2": "ACGTACGTA"} and rows["s1_x"].header == "s1|x first"
    with pytest.raises(fasta.InputError):
        fasta.read_fasta(spark, put(tmp_path, "b.fa", ">A\nACGTACGTA\n>a\nACGTACGTA\n"))
    assert not fasta.is_protein(spark, path) and fasta.is_protein(spark, put(tmp_path, "c.fa", ">p\nMKLVWERTY\nMKLPQRSW\nMKLVWERTY\nMKLPQRSW\n"))
    out = str(tmp_path / "out")
    fasta.write_fasta(fasta.read_fasta(spark, path), out)
    assert {r.name: r.seq for r in fasta.read_fasta(spark, out).collect()} == {k: r.seq for k, r in rows.items()}
    assert sorted(r.seq_name for r in fasta.numbered_names(fasta.read_fasta(spark, path), "X").collect()) == ["X_000001", "X_000002"]


def test_quality(spark, tmp_path):
    seqs = fasta.read_fasta(spark, put(tmp_path, "a.fa", ">a\nACGTACGTA\n>b\nACGTACGTA\n"))
    q = fasta.read_quality(spark, put(tmp_path, "a.qual", ">a\n1 2 3 4 5\n6 7 8 9\n>c\n1\n"), seqs)
    assert {r.name: r.quality for r in q.collect()}["a"] == list(range(1, 10))
    assert {(r.name, r.problem) for r in fasta.quality_warnings(q, seqs).collect()} == {("b", "no quality"), ("c", "no sequence")}
    with pytest.raises(fasta.InputError):
        fasta.read_quality(spark, put(tmp_path, "b.qual", ">a\n1 2\n"), seqs)


def test_counts(spark, tmp_path):
    path = put(tmp_path, "c.tsv", "x a1 a2 b1\ns1 1.5 2 3\ns2 0 1 7\n")
    rows = {(r.seq, r.lib, r.rep): r.n for r in tables.read_counts(spark, path, {"a": ["a1", "a2"], "b": ["b1"]}).collect()}
    assert rows[("s1", "a", 1)] == 2 and rows[("s1", "a", 0)] == 4 and rows[("s2", "b", 0)] == 7 and len(rows) == 10
    with pytest.raises(fasta.InputError):
        tables.read_counts(spark, path, {"a": ["a9"]})
    names = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "name string")
    made = tables.build_counts(spark, {"r1": put(tmp_path, "r1", "s1 3\n# c\n\ns1 4\n"), "r2": put(tmp_path, "r2", "s2 5\n")}, names)
    assert {r.name: (r.r1, r.r2) for r in made.collect()} == {"s1": (4, 0), "s2": (0, 5), "s3": (0, 0)}
    with pytest.raises(fasta.InputError):
        tables.build_counts(spark, {"r": put(tmp_path, "r3", "zz 1\n")}, names)


def test_hits(spark, tmp_path):
    path = put(tmp_path, "h.tab", "# c\nq1\tsp|P1|KIN_X\t90.5\t100\t1\t0\t1\t300\t1\t100\t1e-20\t200.5\nq1\tz\t90\t1\t1\t0\t1\t40000\t1\t2\t0\t9\n")
    rows = tables.read_hits(spark, path)
    assert rows.count() == 2 and tables.good_hits(rows).count() == 1
    parts = rows.select(*[c.alias(n) for c, n in zip(tables.subject_parts(rows.subject), ("t", "o", "i"), strict=True)]).collect()
    assert [tuple(r) for r in parts] == [("sp", "P1", "KIN_X"), (None, None, "z")]
    heads = spark.createDataFrame([("sp|P1|KIN_X Kinase A OS=Mus musculus GN=K",), ("id2 some text [Homo sapiens]",), ("id3",)], "h string")
    got = [tuple(r) for r in heads.select(*[c.alias(n) for c, n in zip(tables.header_parts(heads.h), "ids", strict=True)]).collect()]
    assert got == [("KIN_X", "Kinase A", "Mus musculus"), ("id2", "some text", "Homo sapiens"), ("id3", "unk", "unk")]
    assert [r.problem for r in tables.verify(spark, put(tmp_path, "bad.tab", "a\tb\n"), "hits").collect()] == ["fewer than eleven columns"]


def test_line_formats(spark, tmp_path):
    known = spark.createDataFrame([("d", "s1"), ("d", "s2"), ("e", "s3")], "ds string, seq string")
    c = tables.read_clusters(spark, put(tmp_path, "c", "# c\nk1 d|s1 e|s3 d|zz\nk2 d|s2\n"), known)
    assert sorted(tuple(r) for r in c.collect()) == [("k1", "d", "s1"), ("k1", "e", "s3")]
    k = tables.read_kaks(spark, put(tmp_path, "k", "Sequence Method Ka Ks Ka/Ks P x y z\na:b YN 0.1 0.2 0.5 0.01 1 1 1\na:c YN 0.1 0 NA NA 1 1 1\n")).orderBy("seq2").collect()
    assert [(r.kaks, r.kaks_na) for r in k] == [(0.5, False), (None, True)]
    p, meta = tables.read_pvalues(spark, put(tmp_path, "p", "a:b c Col\ns1 0.5\ns2 NA\n"))
    assert meta == {"group1": ["a", "b"], "group2": ["c"], "column": "Col"} and {r.seq: r.p for r in p.collect()} == {"s1": 0.5, "s2": None}
    loc = tables.read_locations(spark, put(tmp_path, "l", "s1 chr2:5-9(+)\ns2 chrX:1-2(-)\ns3 chr10:1-2(-)\n")).orderBy("group_order").collect()
    assert [r.seq for r in loc] == ["s1", "s3", "s2"] and loc[0].end == 9
    seqs = spark.createDataFrame([("s1", "old"), ("s2", None)], "name string, remark string")
    got = {r.name: r.remark for r in tables.add_remarks(seqs, spark, put(tmp_path, "r", "s1 new text\n")).collect()}
    assert got == {"s1": "new text; old", "s2": ""}
    m = {(r.a, r.b): r.score for r in tables.read_matrix(spark, put(tmp_path, "m", "# m\n   A R\nA 4 -1\nR -1 5\n")).collect()}
    assert m == {("A", "A"): 4, ("A", "R"): -1, ("R", "A"): -1, ("R", "R"): 5}


DAT = """ID   KIN_MOUSE               Reviewed;         9 AA.
AC   P00001; Q99999;
DE   RecName: Full=Kinase one;
DE            EC=2.7.1.1;
DE   AltName: Full=Other; EC=9.9.9.9;
GN   Name=Kin1; Synonyms=K;
OS   Mus musculus (Mouse).
DR   GO; GO:0016020; C:membrane; IEA:UniProtKB-KW.
DR   GO; GO:0000007; F:thing; ZZZ:x.
DR   KEGG; mmu:1; -.
DR   Pfam; PF00001; x; 1.
DR   InterPro; IPR000001; y.
SQ   SEQUENCE   9 AA;  1000 MW;  0 CRC64;
     MKLVAAAA A
//
ID   EMPTY_MOUSE             Reviewed;         3 AA.
AC   P00002;
DE   SubName: Full=Thing {ECO:1};
OS   Mus musculus (Mouse).
SQ   SEQUENCE   3 AA;  1000 MW;  0 CRC64;
     MKL
//
"""


def test_uniprot(spark, tmp_path):
    path = put(tmp_path, "u.dat", DAT)
    rows = {r.hit_id: r for r in uniprot.read_uniprot(spark, path).collect()}
    k = rows["KIN_MOUSE"]
    assert [(g.gonum, g.ec) for g in k.go] == [(16020, "IEA"), (7, "UNK")] and (k.kegg, k.pfam, k.ec, k.interpro) == ("mmu:1", "PF00001", "2.7.1.1", "IPR000001")
    assert rows["EMPTY_MOUSE"].go == [] and rows["EMPTY_MOUSE"].ec == ""
    got = {r.name: (r.header, r.seq) for r in uniprot.uniprot_fasta(spark, path).collect()}
    assert got["sp|P00001|KIN_MOUSE"] == ("Kinase one OS=Mus musculus (Mouse) GN=Kin1", "MKLVAAAAA")
    skip = spark.createDataFrame([("KIN_MOUSE",)], "hit_id string")
    assert [r.seq for r in uniprot.uniprot_fasta(spark, path, skip=skip).collect()] == ["MKL"]


OBO = """format-version: 1.2

[Term]
id: GO:0000001
name: root
namespace: biological_process

[Term]
id: GO:0000002
name: child
namespace: biological_process
alt_id: GO:0000009
subset: goslim_x
is_a: GO:0000001 ! root

[Term]
id: GO:0000003
name: part
namespace: molecular_function
relationship: part_of GO:0000002 ! child
relationship: regulates GO:0000001

[Term]
id: GO:0000004
name: old
namespace: cellular_component
is_a: GO:0000001
is_obsolete: true

[Typedef]
id: part_of
is_a: GO:0000001
"""


def test_obo(spark, tmp_path):
    path = put(tmp_path, "go.obo", OBO)
    terms = {r.gonum: r for r in uniprot.read_terms(spark, path).collect()}
    assert {k: (r.name, r.domain, r.obsolete) for k, r in terms.items()} == {1: ("root", "BP", False), 2: ("child", "BP", False), 3: ("part", "MF", False), 4: ("old", "CC", True)}
    assert terms[2].subsets == ["goslim_x"] and uniprot.read_slim(spark, path).count() == 3
    edges = uniprot.read_edges(spark, path)
    assert sorted(tuple(r) for r in edges.collect()) == [(2, 1, 1), (3, 2, 2), (9, 2, 3)]
    assert {(r.child, r.ancestor, r.rel, r.distance) for r in ontology.closure(edges).collect()} == {(2, 1, 1, 1), (3, 2, 2, 1), (3, 1, 1, 2)}
    assert tables.verify(spark, path, "obo").count() == 0


def test_exports(spark, tmp_path):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "`a b` int, c string")
    exports.write_tsv(rows, str(tmp_path / "t"))
    assert spark.read.csv(str(tmp_path / "t"), sep="\t", header=True).columns == ["a-b", "c"] and exports.to_text(rows).startswith("a b\tc\n")
    term = "domain string, name string, n_seqs long"
    m = exports.merged_counts({"one": spark.createDataFrame([("BP", "x", 4), ("BP", "y", 1)], term), "two": spark.createDataFrame([("BP", "x", 3)], term)}, 1)
    assert {r.name: (r.one, r.two) for r in m.collect()} == {"x": (4, 3), "y": (1, 0)}
    pairs = spark.createDataFrame([("a", "b", "ATG---AAA", "ATGCCCAA-")], "seq1 string, seq2 string, cds1 string, cds2 string")
    exports.kaks_input(pairs, str(tmp_path / "k"), 1)
    assert [r.value for r in spark.read.text(str(tmp_path / "k")).collect() if r.value] == ["a:b", "ATG", "ATG"]
    members = spark.createDataFrame([("k", "a"), ("k", "b")], "cluster string, seq string")
    levels = spark.createDataFrame([("a", "L", 2), ("b", "L", 3), ("b", "M", 1)], "seq_id string, lib string, n long")
    assert tuple(exports.cluster_levels(members, levels, ["L", "M"]).first()) == ("k", 5, 1)
    raw = spark.createDataFrame([(-2.0,), (0.5,)], "pcc double")
    nulls = exports.flagged_missing(raw, {"pcc": -2.0})
    assert [r.pcc for r in nulls.collect()] == [None, 0.5] and [r.pcc for r in exports.with_sentinels(nulls, {"pcc": -2.0}).collect()] == [-2.0, 0.5]


def test_follow(spark, tmp_path):
    source, table = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string").write.parquet(source)
    follow(spark, source, "id long, v string", table, str(tmp_path / "cp"), ["id"]).awaitTermination()
    spark.createDataFrame([(2, "b"), (3, "c")], "id long, v string").write.mode("append").parquet(source)
    follow(spark, source, "id long, v string", table, str(tmp_path / "cp"), ["id"]).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(table).collect()) == [1, 2, 3]
