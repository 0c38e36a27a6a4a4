"""The operators' queries, each with production parameters over whole tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import ann, bpe, chat, fim, integer_vectors, lm, mixing, near_dedup, negatives, quality, sharding, topk, toxicity, warc
from strandlake.llm.common import scratch_path, table, written


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = mixing.cycled_weights(docs.select("source").distinct())
    rows = mixing.with_copies(docs, mixing.mix(docs, weights))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_archives(warc.write_archives(warc.with_roles(table(spark, sf_dir, "pages"))))
    return warc.resolved(records).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return rows.select("doc_id", *quality.COUNTS, "base_failed", "kept")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = bpe.encoded(table(spark, sf_dir, "documents"), bpe.tokenizer_file())
    return rows.select(
        "doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_preferences(*chat.swapped_replies(table(spark, sf_dir, "conversations")))


#: Arrivals that the documents are appended in, and the bytes of a full shard.
ARRIVALS, SHARD_BYTES = 8, 64 << 20


def op6_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Append all documents as arrivals, each with a version of its own, merge, and read the last committed version with
    each row's shard."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, scratch_path(spark, "shards"), SHARD_BYTES)
    store.append_each(docs, F.pmod(F.xxhash64("doc_id"), F.lit(ARRIVALS)))
    version = store.compact()
    rows = store.read(version, with_shard=True)
    return rows.select("doc_id", "source", "n_chars", F.crc32(F.col("text").cast("binary")).alias("text_crc"), "shard", "shard_rows", F.lit(version).alias("version"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.scored(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))
    return rows.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"))


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.deduplicated(near_dedup.link(table(spark, sf_dir, "documents"), shingle=2))


#: One row in so many is a query.
QUERY_STEP = 20


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ann.usable(table(spark, sf_dir, "embeddings"))
    return ann.search(rows, rows.where(F.col("vec_id") % QUERY_STEP == 0))


def op10_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.pseudo_likelihood(table(spark, sf_dir, "documents"))


#: One row in so many is a query of the exact search, and one an anchor of the negatives.
EXACT_STEP, ANCHOR_STEP = 50, 100
#: The negatives' query moves the label of one row in so many to the next of so many labels.
MOVED, LABELS = 7, 10


def op11_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = written(integer_vectors.whole(table(spark, sf_dir, "embeddings")), "vectors")
    return topk.search(rows, rows.where(F.col("vec_id") % EXACT_STEP == 0))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % MOVED == 0, (F.col("label") + 1) % LABELS).otherwise(F.col("label"))
    rows = negatives.labelled(table(spark, sf_dir, "embeddings").withColumn("label", label))
    return negatives.mine(rows, rows.where(F.col("vec_id") % ANCHOR_STEP == 0))


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fim.transformed(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    back = fim.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(back).alias("restored_sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_warc": op2_warc,
    "op3_quality_rules": op3_quality_rules,
    "op4_bpe": op4_bpe,
    "op5_preference_chat": op5_preference_chat,
    "op6_compaction": op6_compaction,
    "op7_toxicity": op7_toxicity,
    "op8_minhash": op8_minhash,
    "op9_ann": op9_ann,
    "op10_pseudo_likelihood": op10_pseudo_likelihood,
    "op11_exact_topk": op11_exact_topk,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_fill_in_middle": op13_fill_in_middle,
}

WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT payload_digest, min(page_id) AS first FROM d WHERE payload_bytes >= {warc.LEAST_REVISIT} GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem
FROM d LEFT JOIN f USING (payload_digest)
"""

QUALITY_SQL = rf"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents), w AS (SELECT doc_id, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM t),
tri AS (SELECT doc_id, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
dup AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM tri),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM dup WHERE n > 1) GROUP BY 1),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM t) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
c AS (SELECT t.doc_id, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(len(t) - len(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(v.n, 0) AS n_repeat_words
  FROM t JOIN w USING (doc_id) LEFT JOIN lines l USING (doc_id) LEFT JOIN cov v USING (doc_id)),
b AS (SELECT *, n_words < {quality.LEAST_WORDS} OR 100 * n_repeat_words > {quality.MOST_REPEATED} * n_words AS base_failed FROM c),
h AS (SELECT source, count(*) AS d, sum(CAST(base_failed AS INT)) AS f FROM b GROUP BY 1), m AS (SELECT avg(f / d) AS m, var_pop(f / d) AS v FROM h),
k AS (SELECT m, CASE WHEN v > 1e-12 THEN greatest(m * (1 - m) / v - 1, 1) ELSE 1e6 END AS k FROM m), g AS (SELECT source, (f + k * m) / (d + k) <= {quality.HOST_RATE} AS host_kept FROM h, k)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND host_kept AS kept FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source
"""

NEAR_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(ws) = 1 THEN ws[1] ELSE ws[i] || ' ' || ws[i + 1] END AS x FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN n na ON na.doc_id = a.doc_id JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  WHERE least(na.n, nb.n) * 100 >= greatest(na.n, nb.n) * 80 GROUP BY ALL),
l AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l), r AS (SELECT a AS node, a AS far FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.far),
c AS (SELECT node, least(min(far), node) AS component FROM r GROUP BY node)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(component, doc_id) AS component_id, coalesce(component, doc_id) = doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c ON node = doc_id
"""

WHOLE = "list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE)))"
FINITE = "embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0"

TOPK_SQL = f"""
WITH v AS (SELECT vec_id, {WHOLE} AS v FROM embeddings WHERE {FINITE}),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % {EXACT_STEP} = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s QUALIFY rank <= 5
"""

NEGATIVES_SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % {MOVED} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label, {WHOLE} AS v FROM embeddings WHERE label IS NOT NULL AND {FINITE}),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS score FROM v a JOIN v c ON a.vec_id % {ANCHOR_STEP} = 0 AND a.vec_id <> c.vec_id),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND {negatives.PERCENT} * positive_score <= 100 * score AND score <= positive_score QUALIFY rank <= 5
"""

FIM_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, CAST(len(ls) AS BIGINT) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS a, greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS b FROM u),
p AS (SELECT *, coalesce(array_to_string(ls[1:a], ''), '') AS pre, coalesce(array_to_string(ls[a + 1:b], ''), '') AS mid, coalesce(array_to_string(ls[b + 1:], ''), '') AS suf,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM p
"""

ORACLE_SQL: dict[str, str] = {"op2_warc": WARC_SQL, "op3_quality_rules": QUALITY_SQL, "op5_preference_chat": chat.ORACLE, "op8_minhash": NEAR_SQL, "op11_exact_topk": TOPK_SQL, "op12_hard_negatives": NEGATIVES_SQL, "op13_fill_in_middle": FIM_SQL}
