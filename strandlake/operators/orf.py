"""Scores of reading frames: codon usage, k-mers by phase, and the Markov scores that they train."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as Q

#: Differences of log length and log Markov score that decide, the log frequency of a stop codon, thresholds
#: of a good and of a great hit.
LENGTH_GAP, MARKOV_GAP = 0.4, 0.3
STOP_SCORE = -20.0
GOOD_EVALUE, GOOD_SIM, GREAT_COVERAGE, GREAT_SIM = 1e-10, 20, 95, 60
ORDER = 5


def codon_scores(training: DataFrame) -> DataFrame:
    """codon, n, score of training texts (column orf): the log frequency, STOP_SCORE for stops; codons never seen have
    one less than the least."""
    seen = training.select(F.explode(Q.codons(F.col("orf"))).alias("codon")).groupBy("codon").agg(F.count(F.lit(1)).alias("n"))
    spark = training.sparkSession
    all_ = spark.createDataFrame([(c, a == "*") for c, a in Q.CODONS.items()], "codon string, stop boolean")
    rows = all_.join(seen, "codon", "left").fillna(0, ["n"])
    total = rows.where("NOT stop").agg(F.sum("n").alias("_t"), F.min(F.when(F.col("n") > 0, F.col("n"))).alias("_least"))
    rows = rows.crossJoin(F.broadcast(total))  # 64 rows and one
    score = F.when(F.col("stop"), F.lit(STOP_SCORE)).when(F.col("n") > 0, F.log(F.col("n") / F.col("_t"))).otherwise(F.log(F.col("_least") / F.col("_t")) - 1)
    return rows.select("codon", "n", score.alias("score"))


def kmers(texts: DataFrame, k: int, text: str = "orf") -> DataFrame:
    """kmer, phase (0 to 2, of its last letter) and n over all texts."""
    upper = F.upper(F.col(text))
    places = F.when(F.length(upper) >= k, F.sequence(F.lit(1), F.length(upper) - (k - 1))).otherwise(F.array().cast("array<int>"))
    rows = texts.select(upper.alias("_t"), F.explode(places).alias("_i"))
    return rows.select(F.expr(f"substring(_t, _i, {k})").alias("kmer"), ((F.col("_i") + k - 2) % 3).cast("int").alias("phase")).groupBy("kmer", "phase").agg(F.count(F.lit(1)).alias("n"))


def markov_scores(training: DataFrame, base: DataFrame, k: int = ORDER + 1, text: str = "orf") -> DataFrame:
    """kmer, phase, score: log of P(last letter | the letters before it, phase) over the letter's base frequency, with
    (n + 1) / (n of the prefix + 4). ``base`` has letter, freq."""
    full = kmers(training, k, text).where(F.col("kmer").rlike("^[ACGT]+$"))
    prefix = full.groupBy(F.expr(f"substring(kmer, 1, {k - 1})").alias("prefix"), "phase").agg(F.sum("n").alias("_p"))
    rows = full.withColumn("prefix", F.expr(f"substring(kmer, 1, {k - 1})")).join(prefix, ["prefix", "phase"]).withColumn("letter", F.expr("right(kmer, 1)")).join(base, "letter")
    return rows.select("kmer", "phase", F.log((F.col("n") + 1) / (F.col("_p") + 4) / F.col("freq")).alias("score"))


def base_frequencies(sequences: DataFrame, text: str = "seq") -> DataFrame:
    """letter, freq over both strands."""
    s = F.upper(F.col(text))
    count = lambda x: F.sum(F.length(s) - F.length(F.replace(s, F.lit(x), F.lit("")))).alias(x)
    n = sequences.agg(*[count(x) for x in "ACGT"])
    total = F.col("A") + F.col("C") + F.col("G") + F.col("T")
    at, gc = (F.col("A") + F.col("T")) / 2 / total, (F.col("G") + F.col("C")) / 2 / total
    return n.select(F.explode(F.array(*[F.struct(F.lit(x).alias("letter"), (at if x in "AT" else gc).alias("freq")) for x in "ACGT"])).alias("_b")).select("_b.letter", "_b.freq")
