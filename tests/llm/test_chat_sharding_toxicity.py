from __future__ import annotations

import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from strandlake.llm import chat, queries, sharding, toxicity
from strandlake.llm.common import scratch_path

SF = "/root/testdata/sf0.01"


def runs(mask: str) -> int:
    return sum(int(x.split(":")[0]) for x in mask.split(",") if x)


def test_chat_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{SF}/conversations.parquet'")
    rel = con.sql(chat.ORACLE)
    want = sorted(rel.project("conv_id, n_common, prompt, chosen, rejected, chosen_mask, rejected_mask").fetchall())
    got = sorted(tuple(r) for r in queries.op5_preference_chat(spark, SF).select("conv_id", "n_common", "prompt", "chosen", "rejected", "chosen_mask", "rejected_mask").collect())
    assert got == want and len(got) > 90
    assert all(runs(r[5]) == len(r[3]) and runs(r[6]) == len(r[4]) for r in got)


def test_chat_prefix_and_edges(spark):
    schema = "conv_id long, turn long, role string, text string, n string"
    a = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "é", ""), (2, 0, None, None, ""), (2, 0, None, None, ""), (3, 0, "user", "q", ""), (4, 0, "user", "x" * 100_000, ""), (None, 0, "user", "lost", "")]
    b = [(1, 0, "user", "hi", ""), (1, 1, "assistant", "no", ""), (1, 2, "user", "why", ""), (2, 0, None, None, ""), (2, 0, None, None, ""), (4, 5, "user", "x" * 100_000, "")]
    made = {r.conv_id: r for r in chat.format_preferences(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).collect()}
    assert set(made) == {1, 2, 3, 4}
    assert made[1].n_common == 1 and made[1].prompt == "<|user|>\nhi<|end|>\n" and made[1].chosen == "<|assistant|>\né<|end|>\n"
    assert made[1].chosen_mask == "14:0,9:1" and made[1].rejected_mask == "14:0,10:1,9:0,11:0"
    assert (made[2].n_common, made[2].chosen, made[2].rejected) == (2, "", "")
    assert (made[3].n_common, made[3].rejected, made[3].rejected_mask) == (0, "", "")
    assert made[4].n_common == 1 and made[4].chosen == ""
    none = spark.createDataFrame([], schema)
    assert chat.format_preferences(none, none).count() == 0


def test_store_versions(spark):
    rows = spark.createDataFrame([(i, "text " * (i % 50), None if i % 7 else "s") for i in range(2000)], "doc_id long, text string, shard string")
    rows = rows.unionByName(rows.limit(3)).unionByName(spark.createDataFrame([(None, None, None)], rows.schema))
    store = sharding.ShardStore(spark, scratch_path(spark, "store"), target_bytes=40_000, fan_in=3, base_bytes=1000)
    assert store.version() == 0 and store.manifest().count() == 0
    with pytest.raises(ValueError):
        store.read()
    for part in rows.randomSplit([1.0, 1.0, 1.0, 1.0], 3):
        store.append(part.repartition(3))
    assert store.version() == 4 and store.manifest().count() >= 12
    last = store.compact()
    assert last > 4 and store.manifest().count() < store.manifest(4).count()
    key = lambda df: sorted(map(str, df.select("doc_id", "text").collect()))
    assert key(store.read()) == key(store.read(4)) == key(rows)
    assert store.manifest().agg({"rows": "sum"}).first()[0] == rows.count()
    with pytest.raises(sharding.ConflictError):
        store.commit(store.manifest(4), 4)
    assert store.version() == last
    assert store.compact() == last
    shards = {r.shard: r["rows"] for r in store.manifest().collect()}
    seen = store.read(with_shard=True).groupBy("shard", "shard_rows").count().collect()
    assert {r.shard: r["count"] for r in seen} == {r.shard: r.shard_rows for r in seen} == {k: v for k, v in shards.items() if v}
    store.append(rows.limit(0))
    pending = store._new_folder(rows)
    rows.write.parquet(pending)  # what another writer has not committed yet
    assert store.vacuum() == 0 and spark.read.parquet(pending).count() == rows.count()
    assert store.vacuum(older_than=0) >= 4 and key(store.read()) == key(rows)
    assert store.vacuum(older_than=0) == 0


def test_arrivals_and_empty_tables(spark):
    rows = spark.createDataFrame([(i, f"t{i}", "own", i % 3 if i % 10 else None) for i in range(90)], "doc_id long, text string, arrival string, _ARRIVAL int")
    rows = rows.unionByName(rows.limit(2))
    store = sharding.ShardStore(spark, scratch_path(spark, "store"), target_bytes=1 << 20, fan_in=4, base_bytes=100)
    assert store.append_each(rows.limit(0), F.col("_ARRIVAL")) == 0 and store.read(with_shard=True).count() == 0
    assert store.append_each(rows, F.col("_ARRIVAL")) == 4
    key = lambda df: sorted(map(str, df.select("doc_id", "text", "arrival", "_ARRIVAL").collect()))
    for version, values in enumerate([{None}, {None, 0}, {None, 0, 1}, {None, 0, 1, 2}], 1):
        assert {r._ARRIVAL for r in store.read(version).collect()} == values
    assert key(store.read(4)) == key(rows)
    plan = store.plan(store.manifest()).collect()
    assert len(plan) >= 4 and {r.bin for r in plan} == {0}
    last = store.compact()
    assert last == 5 and store.manifest().count() == 1 and key(store.read()) == key(rows)
    none = sharding.ShardStore(spark, scratch_path(spark, "store"))
    assert none.append(rows.limit(0)) == 1 and none.compact() == 1
    assert none.read().columns == rows.columns and none.read().count() == 0


def test_compaction_query(spark):
    rows = queries.op6_compaction(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    assert sorted((r.doc_id, r.text_crc) for r in rows) == sorted((d.doc_id, zlib.crc32(d.text.encode())) for d in docs)


def test_grammar():
    model = toxicity.Model({"idiot": 1.0, "moron": 1.0}, {"loweq": 1.0}, toxicity.PRIOR)
    own = model.scorer()
    kind = lambda text: [toxicity.KINDS[i] for i, x in enumerate(own.features(text)[:5]) if x]
    assert kind("what an IDIOT.") == ["insult"]
    assert kind("you are an idiot") == ["targeted"] == kind("idiot, all of you")
    assert kind("I will kill you") == ["threat"] and kind("they kill time") == ["threat"]
    assert kind("not an idiot") == ["negated"] and kind("he said you are an idiot") == ["reported"] == kind("you idiot, she said")
    assert kind("clean text. loweqxyz here") == ["insult"]
    assert kind("flower idiots skilled moronic bloweq") == [] == kind("") == kind(None)
    assert own.score("you idiot. you moron") > own.score("you idiot") > own.score("not an idiot") > own.score("") == own.score(None)
    assert own.score("idiot " * 50_000) <= 1


def judged_plainly(symbols, weights):
    """Place, kind and weight of the terms of a clause, by looking around each of them."""
    near = lambda i, c, places: any(0 <= j < len(symbols) and symbols[j] == c for j in places)
    found = []
    for i, x in enumerate(symbols):
        if x not in weights and x != "T":
            continue
        before, after = range(i - toxicity.SPAN, i), range(i + 1, i + toxicity.SPAN + 1)
        intent, target = near(i, "B", before), near(i, "Y", [*before, *after])
        w = 0.0 if x == "T" else weights[x] + (toxicity.STRESS if i and symbols[i - 1] == "S" else 0.0)
        if near(i, "N", before):
            found.append((i, "n", toxicity.BARE if x == "T" else w + toxicity.NEGATED))
            continue
        kind = ("U" if target else None) if x == "T" else ("J" if target else "I")
        w += {"U": toxicity.THREAT + (toxicity.INTENT if intent else 0.0), "J": toxicity.TARGETED}.get(kind, 0.0)
        if "R" in symbols:
            w, kind = w + (toxicity.REPORTED if kind else toxicity.BARE), "q"
        if kind:
            found.append((i, kind, w))
    return found


def test_grammar_equals_plain_rules():
    import itertools
    import random

    weights = {"idiot": 1.0, "loweq*": 1.75}
    machine = toxicity.Composed(toxicity.insults(weights), toxicity.GRAMMAR, keep=False)
    rng = random.Random(5)
    short = itertools.product(["idiot", "T", "N", "Y", "R", "S", "B", "W"], repeat=4)
    long = ([rng.choice(["idiot", "loweq*", "T", "N", "Y", "R", "S", "B", *"WWWWWW"]) for _ in range(rng.randint(5, 24))] for _ in range(8000))
    kinds = set()
    for symbols in itertools.chain([()], short, long):
        total, found = toxicity.heaviest(machine, symbols, toxicity.OUTCOME)
        want = judged_plainly(list(symbols), weights)
        assert [(i, k) for i, k, _ in found] == [(i, k) for i, k, _ in want], symbols
        assert [w for *_, w in found] == pytest.approx([w for *_, w in want]) and total == pytest.approx(sum(w for *_, w in want))
        kinds |= {k for _, k, _ in found}
    assert kinds == set("IJUnq")


def all_paths(machine, symbols):
    """Output and weight of every path, none of them left out."""
    ways = [(s, (), 0.0) for s in machine.starts]
    for x in symbols:
        ways = [(to, (*out, y or x), w + v) for s, out, w in ways for to, y, v in machine.step(s, x)]
    return [(out, w) for s, out, w in ways if machine.accepts(s)]


def test_composition_equals_cascade():
    import itertools

    row = [toxicity.insults({"idiot": 1.0}), toxicity.threats(2), toxicity.negation(2), toxicity.targets(2), toxicity.reports()]
    whole = row[-1]
    for m in row[-2::-1]:
        whole = toxicity.Composed(m, whole)
    for symbols in itertools.product(["idiot", "T", "N", "Y", "R", "S", "B"], repeat=4):
        ways = [(symbols, 0.0)]
        for m in row:
            ways = [(out, w + v) for x, w in ways for out, v in all_paths(m, x)]
        assert sorted(ways) == sorted(all_paths(whole, symbols))
        assert toxicity.heaviest(whole, symbols, toxicity.OUTCOME)[0] == pytest.approx(max(w for _, w in ways))


def test_toxicity_scores_equal_plain_reading(spark):
    """Every clause of every text cut and judged without the search, the machine or Spark."""
    import math
    import re

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    model = toxicity.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    weights = model.words | {f"{x}*": w for x, w in model.stems.items()}
    classes = {w: c for c in "BSRNYT" for w in toxicity.SEEDS[c].split()}

    def symbol(word):
        own = [(w, word) for t, w in model.words.items() if t == word] + [(w, f"{t}*") for t, w in model.stems.items() if word.startswith(t)]
        return max(own, key=lambda x: x[0])[1] if own else classes.get(word, "W")

    known = {}
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in toxicity.scored(docs, model).collect():
        sums, sure, low = dict.fromkeys("IJUnq", 0.0), 0.0, (texts[r.doc_id] or "").lower()
        for clause in re.split(r"[.!?;:\n]", low):
            words = re.findall(r"[^\W\d_]+(?:'[^\W\d_]+)?", clause)
            for w in words:
                if w not in known:
                    known[w] = symbol(w)
            for _, kind, w in judged_plainly([known[w] for w in words], weights):
                sums[kind] += max(w, 0.0)
                sure = max(sure, float(w >= toxicity.SURE and kind in "IJ"))
        total = sum(sums.values())
        x = [1.0, *(math.log1p(sums[k]) for k in "IJUnq"), math.log1p(100 * total / len(low.split())) if total else 0.0, sure]
        z = sum(a * b for a, b in zip(model.kinds, x, strict=True))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(-40.0, min(40.0, z)))), abs=1e-9), r.doc_id


def test_toxicity_held_out(spark):
    rows = {r.doc_id: r for r in queries.op7_toxicity(spark, "/root/testdata/sf0.1").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").collect()
    assert len(rows) == spark.read.parquet("/root/testdata/sf0.1/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in rows.items())
    assert all(r.predicted == (r.score >= 0.7) and 0 <= r.score <= 1 for r in rows.values())
    test = [(rows[x.doc_id].predicted, x.toxic) for x in labels if rows[x.doc_id].held_out]
    hit = sum(p and t for p, t in test)
    print("precision", hit / sum(p for p, _ in test), "recall", hit / sum(t for _, t in test))
    assert hit / sum(p for p, _ in test) > 0.95 and hit / sum(t for _, t in test) > 0.85


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(1, None, 0.5), (None, "", 0.5), (2, "you idiot " * 9, 0.5), (2, "you idiot " * 9, 0.5)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.learn(docs, none)
    rows = toxicity.scored(docs, model).collect()
    assert len(rows) == 4 and rows[0].score == rows[1].score < 0.1 and rows[2].score == rows[3].score > 0.7
    assert docs.select(toxicity.held_out(docs.doc_id).alias("h")).collect()[1].h is False
    labels = spark.createDataFrame([(2, 1, 1), (None, 0, 1), (1, None, None), (2, 0, 0)], none.schema)
    assert toxicity.scored(docs.limit(0), toxicity.learn(docs, labels)).count() == 0
