"""Scores of multiple alignments: a row per member, cluster and aligned text of one length per cluster.

Columns of an alignment are rows (cluster, pos, letter, n) after one explode and one group; consensus, entropy and
sum-of-pairs follow from the counts of letters, not from pairs of members.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Score of a gap against a letter; clusters above this size with gaps are not summed over pairs.
GAP_SCORE, MOST_MEMBERS = -4.0, 50


def letter_counts(members: DataFrame) -> DataFrame:
    """cluster, pos (from 1), letter and n, with ``members`` rows per cluster and ``inside`` letters: gaps beyond the ends
    of a member are told apart as ``~``."""
    text = F.upper("aligned")
    head, tail = F.length(F.regexp_extract(text, "^-*", 0)), F.length(F.regexp_extract(text, "-*$", 0))
    marked = F.when(F.length(F.replace(text, F.lit("-"), F.lit(""))) == 0, F.repeat(F.lit("~"), F.length(text))).otherwise(
        F.concat(F.expr("repeat('~', _h)"), F.expr("substring(_t, _h + 1, length(_t) - _h - _e)"), F.expr("repeat('~', _e)"))
    )
    rows = members.withColumns({"_t": text, "_h": head, "_e": tail}).select("cluster", F.posexplode(F.filter(F.split(marked, ""), lambda c: c != "")).alias("pos", "letter"))
    return rows.groupBy("cluster", (F.col("pos") + 1).alias("pos"), "letter").agg(F.count(F.lit(1)).alias("n"))


def consensus(counts: DataFrame, matrix: DataFrame | None = None) -> DataFrame:
    """cluster and the consensus of its columns. A column with fewer than two letters is a gap. A letter that is more
    frequent than anything else is taken; where gaps are the most frequent, the second is, if it leads the third. Else that
    one is which has most other letters in the column with a positive score beside it; of these, or without a ``matrix``
    (a, b, score for a <= b), the most frequent. Equal counts go by the alphabet, gaps last."""
    gap = F.col("letter").isin("-", "~")
    rows = counts.groupBy("cluster", "pos", F.when(gap, "-").otherwise(F.col("letter")).alias("letter")).agg(F.sum("n").alias("n"))
    one = F.struct((-F.col("n")).alias("n"), (F.col("letter") == "-").alias("gap"), "letter")
    rows = rows.groupBy("cluster", "pos").agg(F.sort_array(F.collect_list(one)).alias("_c"))  # as many as there are letters
    related = [r.a + r.b for r in matrix.where("score > 0 AND a <> b").select("a", "b").distinct().collect()] if matrix is not None else []
    known = F.array(*[F.lit(x) for x in related]) if related else F.array().cast("array<string>")
    at, size = lambda i: F.get("_c", F.lit(i)), F.size("_c")
    letters = F.aggregate("_c", F.lit(0).cast("long"), lambda n, x: n + F.when(x["gap"], 0).otherwise(-x["n"]))
    friends = lambda x: F.size(F.filter("_c", lambda y: F.array_contains(known, F.concat(F.least(x["letter"], y["letter"]), F.greatest(x["letter"], y["letter"])))))
    counted = F.transform("_c", lambda x, i: F.struct((-friends(x)).alias("f"), i.alias("i"), x["letter"].alias("letter")))
    leads = lambda i: at(i)["n"] < F.coalesce(at(i + 1)["n"], F.lit(0))
    pick = F.when(letters <= 1, "-").when((size == 1) | (leads(0) & ~at(0)["gap"]), at(0)["letter"]).when(at(0)["gap"] & leads(1), at(1)["letter"]).otherwise(F.array_min(counted)["letter"])
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "letter"))), lambda x: x["letter"]), "")
    return rows.select("cluster", "pos", pick.alias("letter")).groupBy("cluster").agg(text.alias("consensus"))


#: Gaps in a row above which a cut is made, letters in a row that end the search before any gap, and letters
#: outside long gaps that end it after one.
LONG_GAP, LETTERS, SKIPS = 10, 4, 3


def trim_start(text: Column) -> Column:
    """Characters of a gapped text to leave out at its start: up to the last run of letters behind a long gap that is found
    before the search ends. Five letters before any gap end it; after one, the fourth letter that is not the first behind a
    long gap does."""
    runs = F.regexp_extract_all(text, F.lit("-+|[^-]+"), F.lit(0))

    def step(s: Column, run: Column) -> Column:
        size, gap = F.length(run), run.startswith("-")
        cut = s["seen"] & (s["gap"] > LONG_GAP)
        skips = s["skips"] + F.when(gap | ~s["seen"], 0).otherwise(size - F.when(cut, 1).otherwise(0))
        after = F.struct(
            (s["at"] + size).alias("at"), F.when(gap, size).otherwise(0).alias("gap"), (s["seen"] | gap).alias("seen"), skips.cast("int").alias("skips"),
            F.when(~gap & cut, s["at"]).otherwise(s["trim"]).alias("trim"), (~gap & F.when(s["seen"], skips > SKIPS).otherwise(size > LETTERS)).alias("done"),
        )
        return F.when(s["done"], s).otherwise(after)

    zero = F.lit(0)
    begin = F.struct(zero.alias("at"), zero.alias("gap"), F.lit(False).alias("seen"), zero.alias("skips"), zero.alias("trim"), F.lit(False).alias("done"))
    return F.aggregate(runs, begin, step, lambda s: s["trim"])


def trimmed(rows: DataFrame, text: str = "consensus") -> DataFrame:
    """Adds ``first`` and ``end``: of a gapped text, what is shown are the characters from ``first`` (from 0) up to ``end``.
    The end is found as the start of the reversed text is; the letter where that cut falls goes as well, and a cut at the
    very first character is none. A null text has nulls; an empty one 0 and 0."""
    back = trim_start(F.reverse(text))
    end = F.when((back > 0) & (back < F.length(text) - 1), F.length(text) - 1 - back).otherwise(F.length(text))
    # where the last run of the reversed text is the first character alone, the cut before it, if any, holds
    alone = F.length(F.regexp_extract(F.reverse(text), "^(.*[^-])?-+[^-]$", 1))
    short = F.reverse(F.substring(F.reverse(text), F.lit(1), alone))
    inner = trim_start(F.reverse(short))
    end = F.when(back == F.length(text) - 1, F.when((inner > 0) & (F.length(text) > 1), F.length(text) - 1 - inner).otherwise(F.length(text))).otherwise(end)
    return rows.withColumns({"first": trim_start(F.col(text)), "end": end})


def sum_of_pairs(counts: DataFrame, matrix: DataFrame) -> DataFrame:
    """cluster and score: per column the matrix score of all pairs, a gap against a letter GAP_SCORE, gaps against gaps
    and anything beyond the ends 0; over pairs times columns. Null for clusters above MOST_MEMBERS with gaps.

    ``matrix`` has a, b, score for letters in order (a <= b)."""
    c = counts.where("letter <> '~'")
    x = c.select("cluster", "pos", F.col("letter").alias("a"), F.col("n").alias("na"))
    y = c.select("cluster", "pos", F.col("letter").alias("b"), F.col("n").alias("nb"))
    pairs = x.join(y, ["cluster", "pos"]).where("a <= b").join(matrix, ["a", "b"], "left")
    times = F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb"))
    gap = (F.col("a") == "-").cast("int") + (F.col("b") == "-").cast("int")
    each = F.when(gap == 2, 0.0).when(gap == 1, GAP_SCORE).otherwise(F.coalesce("score", F.lit(GAP_SCORE)))
    sums = pairs.groupBy("cluster").agg(F.sum(times * each).alias("_s"))
    size = counts.groupBy("cluster", "pos").agg(F.sum("n").alias("_n"), F.max((F.col("letter") == "-").cast("int")).alias("_g")).groupBy("cluster").agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_c"), F.max("_g").alias("_g"))
    score = F.when((F.col("_n") > MOST_MEMBERS) & (F.col("_g") == 1), None).otherwise(F.coalesce("_s", F.lit(0.0)) / (F.col("_n") * (F.col("_n") - 1) / 2 * F.col("_c")))
    return size.where("_n > 1").join(sums, "cluster", "left").select("cluster", score.alias("sum_of_pairs"))


def entropy(counts: DataFrame, members: DataFrame) -> DataFrame:
    """cluster and conservation: the mean over columns of 1 - H / log(min(21, members)), with members weighted by how
    rare their letters are (1 / (n * kinds) per column, normalised)."""
    w = Window.partitionBy("cluster", "pos")
    col = counts.withColumn("letter", F.when(F.col("letter") == "~", "-").otherwise(F.col("letter"))).groupBy("cluster", "pos", "letter").agg(F.sum("n").alias("n"))
    col = col.withColumn("_k", F.count(F.lit(1)).over(w)).withColumn("_w", 1 / (F.col("n") * F.col("_k")))
    text = members.select("cluster", "member", F.posexplode(F.filter(F.split(F.upper("aligned"), ""), lambda c: c != "")).alias("pos", "letter")).withColumn("pos", F.col("pos") + 1)
    both = text.join(col.select("cluster", "pos", "letter", "_w"), ["cluster", "pos", "letter"])
    weight = both.groupBy("cluster", "member").agg(F.avg("_w").alias("weight"))
    p = text.join(weight, ["cluster", "member"]).groupBy("cluster", "pos", "letter").agg(F.sum("weight").alias("p"))
    h = p.groupBy("cluster", "pos").agg((-F.sum(F.col("p") * F.log("p"))).alias("h"))
    n = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("_n"))
    scale = F.log(F.least(F.col("_n"), F.lit(21)).cast("double"))
    return h.join(n, "cluster").groupBy("cluster").agg(F.avg(1 - F.when(scale > 0, F.col("h") / scale).otherwise(0.0)).alias("conservation"))


def length_sd(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster").agg(F.coalesce(F.stddev_samp(F.length(F.replace("aligned", F.lit("-"), F.lit("")))), F.lit(0.0)).alias("sd_len"))


def _log_factorial(n: Column) -> Column:
    """ln n! by Stirling's series, with x = n + 8 so that its error is below 1e-10 of a term for small n, too."""
    x = n.cast("double") + 8
    series = (x + 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)
    return series - reduce(lambda acc, i: acc + F.log(n.cast("double") + i), range(1, 9), F.lit(0.0))


def _binomial_tail(n: Column, depth: Column, q: float) -> Column:
    """The chance of ``n`` or more of ``depth``. Each term's logarithm comes from the one before it. Terms are summed up to 12
    standard deviations and 60 beyond the mean or ``n``; those left out are together below 1e-20 of the sum, so the work
    grows with the distance from ``n`` to the mean and the square root of ``depth``, not with its square."""
    d, k = depth.cast("double"), n.cast("double")
    first = _log_factorial(depth) - _log_factorial(n) - _log_factorial(depth - n) + k * math.log(q) + (d - k) * math.log1p(-q)
    last = F.least(d, F.ceil(F.greatest(k, d * q) + 12 * F.sqrt(d * q * (1 - q)) + 60)).cast("long")
    zero = F.struct(first.alias("term"), F.exp(first).alias("sum"))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((d - i + 1) / i) + math.log(q / (1 - q))
        return F.struct(term.alias("term"), (acc["sum"] + F.exp(term)).alias("sum"))

    more = F.when(last > n, F.sequence(n.cast("long") + 1, last)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(more, zero, step, lambda acc: acc["sum"])


def snps(bases: DataFrame, error: float = 0.01, least: int = 2, threshold: float = 0.001) -> DataFrame:
    """contig, pos, base, n, depth of variants: a base other than the most frequent, seen ``least`` times or more, whose
    count is unlikely among ``depth`` reads with an error of error/3 (upper tail of the binomial). ``bases`` has contig,
    pos, base, n."""
    w = Window.partitionBy("contig", "pos")
    rows = bases.withColumn("depth", F.sum("n").over(w)).withColumn("_r", F.row_number().over(w.orderBy(F.desc("n"), "base"))).where((F.col("_r") > 1) & (F.col("n") >= least))
    return rows.withColumn("p", _binomial_tail(F.col("n"), F.col("depth"), error / 3)).where(F.col("p") <= threshold).select("contig", "pos", "base", "n", "depth", "p")
