from __future__ import annotations

import hashlib
import re
import struct
import tracemalloc
from collections import Counter, defaultdict

import pyarrow as pa

from strandlake.llm import bpe, mixing, quality, queries, warc

SF = "/root/testdata/sf0.01"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def fill(sizes: dict, weights: dict, share: float, most: float) -> dict:
    left, open_, out = share * sum(sizes.values()), set(sizes), {}
    while open_:
        total = sum(weights[s] for s in open_)
        full = {s for s in open_ if left * weights[s] / total >= most * sizes[s]} if total else set()
        if not full:
            return out | {s: left * weights[s] / total if total else 0.0 for s in open_}
        for s in full:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= full
    return out


def test_mixing_meets_targets(spark):
    rows = queries.op1_mixing(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source", "text").collect()
    size = {d.doc_id: len(WORDS.findall(d.text or "")) for d in docs}
    source = {d.doc_id: d.source for d in docs}
    sizes = defaultdict(int)
    for d in docs:
        sizes[d.source] += size[d.doc_id]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sorted(sizes))}
    want = fill(sizes, weights, 1.5, 2)
    taken = Counter()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[source[r.doc_id]]
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 * max(1, r.target)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[source[r.doc_id]] += r.taken
    for s in sizes:
        assert 0 <= want[s] - taken[s] <= 0.02 * want[s] + 20
    assert sorted(rows) == sorted(queries.op1_mixing(spark, SF).collect())


def test_mixing_edges(spark):
    docs = spark.createDataFrame([(1, "a b c", "en", None, 0), (2, None, None, "x", 0), (2, "", None, "x", 0), (None, "d e", None, "x", 0), (3, "q " * 5000, "en", "y", 0), (3, "q " * 5000, "en", "y", 0)], DOC)
    docs = docs.withColumnRenamed("n_chars", "size")
    made = mixing.mix(docs, mixing.cycled_weights(docs.select("source").distinct()))
    rows = mixing.with_copies(docs, made).collect()
    assert len(rows) == 6 and all(0 <= r.copies <= 2 for r in rows)
    out = mixing.mixed(docs, made)
    assert out.columns == docs.columns and out.count() == sum(r.copies for r in rows)
    none = docs.limit(0)
    assert mixing.with_copies(none, mixing.mix(none, mixing.cycled_weights(none.select("source").distinct()))).count() == 0


def test_warc_round_trip(spark):
    page = "<p>" + "word " * 40
    data = [(5, "http://a/\r\nx", page), (3, "http://b", page), (9, None, page), (4, "u", "short"), (2, "u", "short"), (7, "u", None), (8, "", ""), (11, "é", "é" * 200_000), (None, "n", page), (3, "http://b", page)]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    archives = warc.write_archives(warc.with_roles(pages), archive_bytes=500)
    records = warc.read_archives(archives)
    got = sorted(warc.resolved(records).collect(), key=lambda r: (r.page_id is None, r.page_id or 0))
    assert len(got) == len(data) and all(r.problem is None for r in got)
    for r in got:
        html = next(h for i, _, h in data if i == r.page_id) or ""
        assert (r.payload_bytes, r.payload_digest) == (len(html.encode()), hashlib.sha256(html.encode()).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 3) if r.page_id in (5, 9) else ("response", None))
    assert {r.payload.decode() for r in records.where("payload is not null").collect()} == {h or "" for *_, h in data}


def test_warc_members_and_damage(spark):
    made = [warc.record_bytes(i, "u", b"x" * i, hashlib.sha256(b"x" * i).hexdigest(), None) for i in range(3)]
    members = [m for m, problem in warc.inflated(b"".join(made)) if problem is None]
    assert len(members) == 3 and [warc.read_record(m)["payload_bytes"] for m in members] == [0, 1, 2]
    assert warc.read_record(members[2].replace(b"xx", b"xy"))["problem"] == "block digest"
    bad = spark.createDataFrame([("a", made[0] + made[1][:-12]), ("b", None)], "path string, content binary")
    rows = warc.read_archives(bad).collect()
    assert [r.problem is None for r in rows] == [True, False]
    assert warc.read_archives(bad.limit(0)).count() == 0


def test_warc_records_after_damage_are_read(spark):
    made = [warc.record_bytes(i, "u", b"\x1f\x8b\x08 page " * 9 + bytes([i]), hashlib.sha256(b"\x1f\x8b\x08 page " * 9 + bytes([i])).hexdigest(), None) for i in range(6)]
    hit = bytearray(made[1])
    hit[40] ^= 0xFF
    parts = [made[0], bytes(hit), made[2], made[3][:30], b"\x1f\x8b\x08 no member", made[4], made[5][:-3]]
    rows = warc.read_archives(spark.createDataFrame([("a", b"".join(parts))], "path string, content binary")).collect()
    assert [r.page_id for r in rows if r.problem is None] == [0, 2, 4]
    assert all(r.page_id is None or r.problem is None or r.page_id == 1 for r in rows) and 2 <= len(rows) - 3 <= 4


def test_warc_of_no_pages(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.resolved(warc.read_archives(warc.write_archives(warc.with_roles(none)))).count() == 0


def slow_counts(text):
    words = WORDS.findall(text or "")
    windows = Counter(zip(words, words[1:], words[2:]))
    covered = set()
    for i in range(len(words) - 2):
        if windows[tuple(words[i : i + 3])] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered)


def test_quality_counts(spark):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = queries.op3_quality_rules(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert tuple(r[c] for c in quality.COUNTS) == slow_counts(docs[r.doc_id].text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept <= (not r.base_failed)
    for text in (None, "", " \n ", "a b\x1cc a b\x1cc", "a a a a", "l\nl\n\nl", "x " * 3000, "Zoë # *\r\nZoë # *"):
        assert quality.counts(text) == slow_counts(text)


def test_quality_hosts(spark):
    good, bad = " ".join(f"w{i}" for i in range(60)), "too short"
    data = [(i, bad if i % 10 else good, None, "bad", 0) for i in range(200)] + [(1000 + i, good, None, f"h{i % 8}", 0) for i in range(400)] + [(5000, good, None, None, 0), (5001, None, None, "h1", 0)]
    docs = spark.createDataFrame(data, DOC).withColumnRenamed("n_chars", "n_words")
    rows = {r.doc_id: r for r in quality.judged(docs).collect()}
    assert len(rows) == len(data)
    assert not any(rows[i].kept for i in range(200)) and all(rows[1000 + i].kept for i in range(400)) and rows[5000].kept and not rows[5001].kept
    assert quality.judged(docs.limit(0)).count() == 0


def test_bpe_matches_library(spark):
    path = bpe.tokenizer_file()
    own = bpe.tokenizer(path)
    odd = [None, "", " \t\n", "   x y", "It's we'll 'S don'T <|endoftext|>a <|startoftext|>", "é É ΣΑΣ İ ﬁ \U0001f600‍", "a\x1cb\x85c", "12,345.67 -- !!!", "x" * 3000, "ß" * 500]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(odd)] + [(None, "a b"), (3, odd[3])], "doc_id long, text string")
    docs = docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 300").selectExpr("doc_id + 100 as doc_id", "text"))
    rows = bpe.encoded(docs, path, buckets=5).collect()
    texts = Counter((r.doc_id, r.text) for r in docs.collect())
    assert len(rows) == sum(texts.values())
    want = Counter()
    for (i, t), n in texts.items():
        ids = own.encode(t or "", add_special_tokens=False).ids
        want[(i, struct.pack(f"<{len(ids)}I", *ids), own.decode(ids, skip_special_tokens=False))] += n
    assert Counter((r.doc_id, bytes(r.ids), r.decoded) for r in rows) == want
    back = bpe.decoded(spark.createDataFrame([(1, bytearray(struct.pack("<2I", 5, 6))), (2, None)], "doc_id long, ids binary"), path).collect()
    assert [r.text for r in back] == [own.decode([5, 6], skip_special_tokens=False), ""]
    assert bpe.encoded(docs.limit(0), path).count() == 0


def test_bpe_blocks_are_bounded_and_whole(monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK_BYTES", 200)
    monkeypatch.setattr(bpe, "RESULT_BYTES", 60)
    texts = ["x " * n for n in (3, 500, 1, 0, 40, 99, 7)] + [None] * 30
    rows = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    made = list(bpe._blocks(iter([rows, rows.slice(0, 0), rows])))
    got = [list(bpe._texts(b.column(1)[0].as_py())) for b in made]
    assert [i for b in got for own, _ in b for i in own.to_pylist()] == [*range(len(texts))] * 2
    assert [t for b in got for _, own in b for t in own] == texts * 2
    sizes = [[len(t or "") + 16 for _, own in b for t in own] for b in got]
    assert all(len(x) == 1 or sum(x) <= 200 for x in sizes)


def test_bpe_look_up_holds_a_run_at_once(spark, monkeypatch):
    """No object for each word of a block, and results handed on run by run."""
    path = bpe.tokenizer_file()
    texts = [" ".join(f"w{i * 1500 + k}x" for k in range(1500)) for i in range(40)] + [None, ""]
    docs = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(42), pa.int64()), "text": texts})
    blocks = list(bpe._blocks(iter([docs, docs.slice(40)])))
    words = pa.Table.from_batches(list(bpe._block_words(path, 30)(iter(blocks))))
    table = pa.concat_tables([bpe._encode_bucket(path)(words.slice(i, 1)) for i in range(words.num_rows)])
    row = pa.RecordBatch.from_pydict({"packet": blocks[0].column(1), "_table": pa.array([table.select(["words", "ids", "sizes"]).to_pylist()])})
    monkeypatch.setattr(bpe, "RESULT_BYTES", 20_000)
    list(bpe._look_up(path)(iter([row])))
    tracemalloc.start()
    try:
        sizes = [x.num_rows for x in bpe._look_up(path)(iter([row]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(blocks) == 1 and sum(sizes) == 44 and max(sizes) < 10 and peak < 6e6, (sizes, peak)
    plan = bpe.encoded(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), path)._jdf.queryExecution().executedPlan().toString()
    assert "CoGroups" not in plan and "Broadcast" not in plan


def test_bpe_special_tokens_in_other_cases(spark):
    path = bpe.tokenizer_file()
    own = bpe.tokenizer(path)
    texts = ["<|EndOfText|>", "A <|STARTOFTEXT|> B", "Ab<|endoftext|>Cd<|EndOfText|>Ef", "<|endoftext|> THE <|ENDOFTEXT|>", "É<|StartOfText|>é", "J\u030c T\u0308 H\u0331 W\u030a", "Ⅷ İI ẞS ÀB a\u0300B", "J\u030c<|ENDOFTEXT|>"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (bytes(r.ids), r.decoded) for r in bpe.encoded(docs, path, buckets=2).collect()}
    for i, text in enumerate(texts):
        ids = own.encode(text, add_special_tokens=False).ids
        assert got[i] == (struct.pack(f"<{len(ids)}I", *ids), own.decode(ids, skip_special_tokens=False))
