"""Similar pairs of sequences: loading, best mates, correlation and summaries.

A pair has seq1, seq2, ds1, ds2, evalue, sim, aln, cov1, cov2 and bits. Names are in order without regard to case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.numbers import percent_round, shared_ratio
from strandlake.operators.stats import quartiles


def canonical(rows: DataFrame, a: str = "seq1", b: str = "seq2") -> DataFrame:
    """Each row with its names in order, ignoring case; a pair of equal names goes."""
    swap = F.lower(F.col(a)) > F.lower(F.col(b))
    return rows.where(F.lower(a) != F.lower(b)).withColumns({a: F.when(swap, F.col(b)).otherwise(F.col(a)), b: F.when(swap, F.col(a)).otherwise(F.col(b))})


def load_pairs(hits: DataFrame, lengths: DataFrame) -> DataFrame:
    """Pairs of a search of all against all: the first line of a pair in the file counts, coverage is the alignment's
    length in percent of each sequence (and may be above 100). ``hits`` has line, seq1, seq2 and the alignment."""
    rows = canonical(hits)
    columns = [c for c in rows.columns if c not in ("seq1", "seq2")]
    first = rows.groupBy("seq1", "seq2").agg(F.min_by(F.struct(*columns), "line").alias("_r")).select("seq1", "seq2", *[F.col(f"_r.{c}").alias(c) for c in columns if c != "line"])
    side = lambda n: lengths.select(F.col("seq").alias(f"seq{n}"), F.col("len").alias(f"_len{n}"))
    rows = first.join(side(1), "seq1").join(side(2), "seq2")
    return rows.withColumns({f"cov{n}": percent_round(F.col("aln"), F.col(f"_len{n}")) for n in (1, 2)}).drop("_len1", "_len2")


def best_flags(hits: DataFrame, datasets: DataFrame) -> DataFrame:
    """seq1, seq2, best: 2 where each is the other's first hit in its dataset, 1 where only one side says so. First is by
    line of the file; ``hits`` has line, query, subject; ``datasets`` has seq, ds."""
    of = lambda c: datasets.select(F.col("seq").alias(c), F.col("ds").alias(f"_{c}"))
    rows = hits.where("query <> subject").join(of("subject"), "subject")
    first = rows.groupBy("query", "_subject").agg(F.min_by("subject", F.struct("line", "subject")).alias("mate")).select("query", "mate")
    pair = first.select(F.least("query", "mate").alias("seq1"), F.greatest("query", "mate").alias("seq2"))
    return pair.groupBy("seq1", "seq2").agg(F.count(F.lit(1)).cast("int").alias("best"))


def correlation(pairs: DataFrame, levels: DataFrame) -> DataFrame:
    """seq1, seq2, n_libs, pcc: Pearson's coefficient over the libraries that both have (null levels are passed over);
    0 where a side does not vary. ``levels`` has seq_id, lib, value.

    A sequence's levels go to its pairs as one map; libraries are unfolded where both sides' maps have met, which is where
    the sums are taken, so that a pair is shuffled once for each side and not for each library."""
    own = levels.where(F.col("value").isNotNull() & F.col("lib").isNotNull()).groupBy("seq_id", "lib").agg(F.collect_list("value").alias("_v"))
    own = own.groupBy("seq_id").agg(F.map_from_entries(F.collect_list(F.struct("lib", "_v"))).alias("_l"))
    side = lambda n: own.select(F.col("seq_id").alias(f"seq{n}"), F.col("_l").alias(f"_l{n}"))
    rows = pairs.select("seq1", "seq2").join(side(1), "seq1").join(side(2), "seq2").select("seq1", "seq2", "_l2", F.explode("_l1").alias("lib", "_x"))
    rows = rows.select("seq1", "seq2", "_x", F.explode(F.try_element_at("_l2", "lib")).alias("y")).select("seq1", "seq2", F.explode("_x").alias("x"), "y")
    x, y = F.col("x"), F.col("y")
    sums = rows.groupBy("seq1", "seq2").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(y * y).alias("syy"), F.sum(x * y).alias("sxy"))
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    vx, vy = n * F.col("sxx") - sx * sx, n * F.col("syy") - sy * sy
    pcc = F.when((vx > 1e-12) & (vy > 1e-12), (n * F.col("sxy") - sx * sy) / F.sqrt(vx * vy)).otherwise(0.0)
    return sums.select("seq1", "seq2", n.alias("n_libs"), pcc.alias("pcc"))


def pair_set(searches: dict[str, DataFrame]) -> DataFrame:
    """Pairs of several self-searches with their kinds joined by ``::`` in the order given, and the greatest bits."""
    rows = None
    for at, (kind, found) in enumerate(searches.items()):
        part = canonical(found).select("seq1", "seq2", "bits", F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind")).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    return rows.groupBy("seq1", "seq2").agg(F.max("bits").alias("bits"), F.array_join(F.transform(F.sort_array(F.collect_set("kind")), lambda k: k["kind"]), "::").alias("kinds"))


def best_bits(pairs: DataFrame, limit: int) -> DataFrame:
    """The ``limit`` pairs of the greatest bits, which are the ones to align."""
    return pairs.orderBy(F.desc("bits"), "seq1", "seq2").limit(limit)


def not_aligned(pairs: DataFrame, done: DataFrame) -> DataFrame:
    return pairs.join(done.select("seq1", "seq2"), ["seq1", "seq2"], "left_anti")


def kaks_class(kaks: Column, not_available: Column | None = None) -> Column:
    """NA, <1, about 1 (0.995 up to 1.006) and >1; null where nothing was computed."""
    known = F.when(kaks < 0.995, "<1").when(kaks < 1.006, "~1").when(kaks >= 1.006, ">1")
    return known if not_available is None else F.when(not_available, "NA").otherwise(known)


#: Bins of p-values, each from the last bound up to its own.
P_BINS = (1e-100, 1e-10, 1.0)


def kaks_summary(pairs: DataFrame, by: str = "method") -> DataFrame:
    """Per method: pairs of each class, quartiles of the ratio, means of ka, ks, their ratio and p, pairs with p below 0.05,
    and pairs by p: missing, below 1e-100, 1e-10 and 1. Nulls are left out of means and quartiles; a pair that nothing was
    computed for, with a null ratio that is not NA, has no class."""
    kind = kaks_class(F.col("kaks"), F.col("kaks_na"))
    n = lambda k: F.sum(F.when(kind == k, 1).otherwise(0)).alias({"NA": "n_na", "<1": "n_below", "~1": "n_one", ">1": "n_above"}[k])
    p, count = F.col("p"), lambda c, name: F.sum(F.when(c, 1).otherwise(0)).alias(name)
    bins = [count((p < high) & (p >= low if low else F.lit(True)), f"n_p_{i}") for i, (low, high) in enumerate(zip((None, *P_BINS), P_BINS, strict=False))]
    sums = pairs.groupBy(by).agg(
        n("NA"), n("<1"), n("~1"), n(">1"), *[F.avg(c).alias(f"mean_{c}") for c in ("ka", "ks", "kaks", "p")], count(p < 0.05, "n_significant"), count(p.isNull(), "n_p_na"), *bins
    )
    return sums.join(quartiles(pairs, by, "kaks").drop("n"), by, "left")


def weighted_similarity(pairs: DataFrame) -> DataFrame:
    """Similarity and coverage in percent over all alignments, weighted by their lengths: one row."""
    same = F.floor(F.col("aln") * F.col("sim") / 100 + 0.5)
    return pairs.agg((100 * F.sum(same) / F.sum("aln")).alias("sim_percent"), (100 * F.sum("aln") / F.sum(F.greatest("len1", "len2"))).alias("cov_percent"), F.count(F.lit(1)).alias("n_pairs"))


def coding_summary(scores: DataFrame) -> DataFrame:
    """Totals over pairs of the scores of coding sequences, one row: n_pairs and the sum of every count, percents of codons
    (exact, synonymous, nonsynonymous, fourfold, twofold, aa_exact, aa_positive, aa_negative), of letters (gaps, snps, GC and,
    of two letters each, CpG) and of SNPs (ts1 to tv3), ts/tv by place, and the ratios of shared GC and CpG. Where a total is
    0, so is its percent."""
    codon = ("exact", "synonymous", "nonsynonymous", "fourfold", "twofold", "aa_exact", "aa_positive", "aa_negative")
    letter = ("gaps", "snps", "gc_both", "gc_either", "cpg_both", "cpg_either", "cpg_codon_both", "cpg_codon_either")
    place = tuple(f"{k}{j}" for k in ("ts", "tv") for j in (1, 2, 3))
    sums = scores.agg(F.count(F.lit(1)).alias("n_pairs"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("len", "codons", *codon, *letter, *place)])
    share = lambda c, of, times=1: F.when(F.col(of) > 0, 100.0 * times * F.col(c) / F.col(of)).otherwise(0.0)
    percents = {f"{c}_percent": share(c, "codons") for c in codon} | {f"{c}_percent": share(c, "len", 2 if c.startswith("cpg") else 1) for c in letter} | {f"{c}_percent": share(c, "snps") for c in place}
    rates = {f"tstv{j}": F.when(F.col(f"tv{j}") > 0, F.col(f"ts{j}") / F.col(f"tv{j}")).otherwise(0.0) for j in (1, 2, 3)}
    return sums.withColumns({**percents, **rates, **{f"{c}_ratio": shared_ratio(F.col(f"{c}_both"), F.col(f"{c}_either")) for c in ("gc", "cpg", "cpg_codon")}})


def membership(pairs: DataFrame, members: DataFrame) -> DataFrame:
    """Adds to each pair the methods under which both sequences are in one cluster, in alphabetical order."""
    side = lambda n: members.select(F.col("seq_id").alias(f"seq{n}"), "method", "cluster")
    both = pairs.select("seq1", "seq2").join(side(1), "seq1").join(side(2), ["seq2", "method", "cluster"])
    methods = both.groupBy("seq1", "seq2").agg(F.array_join(F.sort_array(F.collect_set("method")), ",").alias("methods"))
    return pairs.join(methods, ["seq1", "seq2"], "left").fillna("", ["methods"])


def best_mates(pairs: DataFrame) -> DataFrame:
    """Per (sequence, other dataset) the best mate: e-value, then similarity, then name. Both directions of each pair."""
    ways = pairs.select(F.col("seq1").alias("seq"), F.col("ds1").alias("ds"), F.col("seq2").alias("mate"), F.col("ds2").alias("mate_ds"), "evalue", "sim")
    ways = ways.unionByName(pairs.select(F.col("seq2").alias("seq"), F.col("ds2").alias("ds"), F.col("seq1").alias("mate"), F.col("ds1").alias("mate_ds"), "evalue", "sim"))
    order = Window.partitionBy("seq", "mate_ds").orderBy("evalue", F.desc("sim"), "mate")
    return ways.where("ds <> mate_ds").withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
