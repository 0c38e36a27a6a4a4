"""From raw documents to token ids: toxicity, quality rules, near duplicates, mixing and encoding.

Each stage works on all that the one before it kept. All but the last return the columns of ``documents``, and further ones
that a caller's table has, under whatever names, with the values they came with. Every stage gives no rows for an empty
table, and takes rows that repeat as documents of their own unless it says otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandlake.llm import bpe, mixing, near_dedup, quality, toxicity
from strandlake.llm.common import fresh, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; the model is fitted to labelled rows of the same documents. A null text
    scores as an empty one and stays; a null id only means that the row has no label."""
    model = toxicity.learn(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    score = fresh(docs, "_score")
    return toxicity.scored(docs, model, score=score).where(F.col(score) < toxicity.REJECT).drop(score)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a failure of their own whose source is kept. Null and empty texts have too few words and go; a
    null source is a source of its own."""
    return quality.kept_only(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose sets of five words are linked at 0.8: the one with the smallest id. Documents
    without words are in no group and stay. Rows without an id, and rows that repeat an id, are documents of their own."""
    return near_dedup.single(docs, near_dedup.link(docs, shingle=5))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, at most twice. A null source is one that comes last; null and empty texts
    have no words and no say in the budget."""
    weights = mixing.cycled_weights(docs.select("source").distinct())
    return mixing.mixed(docs, mixing.mix(docs, weights))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids of each row of the mix, with the digest of what they decode to. A null text has no tokens; a
    null id stays null."""
    rows = bpe.encoded(docs, bpe.tokenizer_file())
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("mixing sources to target weights", mix_sources),
    ("BPE encoding and decoding", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.split()[0])
    return docs


#: Hash thresholds, registers and encoding are not SQL's: tests hold the stages against brute force.
ORACLE_SQL = None
