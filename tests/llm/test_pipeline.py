from __future__ import annotations

import struct
from collections import Counter

import corpus_pipeline as P
from strandlake.llm import bpe, quality
from strandlake.llm.common import written

from .test_mixing_warc_quality_bpe import slow_counts
from .test_near_dedup_ann_lm import brute

SF = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for name, stage in P.STAGES:
        seen.append(written(stage(spark, seen[-1], SF), name.split()[0]))
        if name != P.STAGES[-1][0]:
            assert seen[-1].columns == columns
    raw, clean, good, single, mixed, encoded = [s.collect() for s in seen]
    label = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in raw} - {r.doc_id for r in clean}
    assert gone and sum(label.get(i) == 0 for i in gone) <= 2 and len(clean) + len(gone) == len(raw)
    want = []
    for r in clean:
        n, *_, repeated = slow_counts(r.text)
        if n >= quality.LEAST_WORDS and 100 * repeated <= quality.MOST_REPEATED * n:
            want.append(r.doc_id)
    assert sorted(want) == sorted(r.doc_id for r in good)
    links, _ = brute({r.doc_id: r.text for r in good}, width=5)
    assert sorted(set(links.values())) == sorted(r.doc_id for r in single)
    copies = Counter(r.doc_id for r in mixed)
    assert set(copies) <= {r.doc_id for r in single} and max(copies.values()) <= 2
    words = {r.doc_id: len(r.text.split()) for r in single}
    assert abs(sum(words[i] * n for i, n in copies.items()) - 1.5 * sum(words.values())) < 0.02 * sum(words.values())
    own, text = bpe.tokenizer(bpe.tokenizer_file()), {r.doc_id: r.text for r in single}
    assert Counter(r.doc_id for r in encoded) == copies
    for r in encoded[:200]:
        ids = own.encode(text[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and bytes(r.ids) == struct.pack(f"<{len(ids)}I", *ids)


def test_run_keeps_the_last_stages_columns(spark):
    assert P.run(spark, "/root/testdata/sf0.001").columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"]


ODD = "doc_id long, text string, lang string, source string, n_chars long, N_WORDS string, kept string, host_kept string, _host string, _host_kept string, _kept string, base_failed string, _score string, size string, copies string, h string, component string, `a b` string"


def test_stages_keep_callers_columns(spark):
    """Nulls in every column, empty and long texts, rows that repeat, and columns named as the operators' own."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    rows = [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in docs]
    rows += rows[:3] + [(None, rows[5][1], None, None, None), (None, None, None, None, None), (9001, None, "x", "s", 0), (9002, "", None, "s", 0), (9003, " \t\n", "x", None, 3), (9004, " ".join(f"w{i}" for i in range(40_000)), "x", "s", None), (None, "one two", "x", "s", 7)]
    own = lambda i: tuple(f"{c}{i}" if i % 5 else None for c in range(13))
    frame = spark.createDataFrame([(*r, *own(i)) for i, r in enumerate(rows)], ODD)
    seen = Counter(map(tuple, frame.collect()))
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, frame, SF)
        assert out.columns == frame.columns, name
        got = Counter(map(tuple, out.collect()))
        assert got and set(got) <= set(seen), name
        assert stage(spark, frame.where("false"), SF).count() == 0, name
    name, last = P.STAGES[-1]
    got = last(spark, frame, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids", "decoded_sha256"] and got.count() == len(rows)
    assert last(spark, frame.where("false"), SF).count() == 0


def test_quality_stage_keeps_what_the_operator_keeps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = sorted(r.doc_id for r in quality.judged(docs).where("kept").collect())
    renamed = docs.withColumnRenamed("lang", "n_words").withColumn("kept", docs.n_chars)
    got = P.drop_low_quality(spark, renamed, SF)
    assert got.columns == renamed.columns and sorted(r.doc_id for r in got.collect()) == want
