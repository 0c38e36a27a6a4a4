"""Expression counts in long form: normalisation, filters, differential expression and its summaries.

A count row has seq_id, lib, rep and n; rep 0 is the library's total. Lengths come as seq_id, len.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions.logic import any_of, combine
from strandlake.operators.stats import numbered_rows, ranged, running, with_total

#: Cutoffs that differential expression is counted at.
DE_CUTOFFS = (1e-5, 1e-4, 1e-3, 1e-2, 5e-2)


def tpm(counts: DataFrame, lengths: DataFrame) -> DataFrame:
    """Adds ``tpm``: counts per kilobase, scaled so that each library sums to a million. Library sums are taken by a
    group and joined, so that a large library is summed before the shuffle."""
    rpk = F.when(F.col("len") > 0, F.col("n") * 1000.0 / F.col("len")).otherwise(0.0)
    rows = counts.where("rep = 0").join(lengths, "seq_id").withColumn("_rpk", rpk)
    total = rows.groupBy("lib").agg((F.sum("_rpk") / 1e6).alias("_total"))
    return rows.join(total, "lib").withColumn("tpm", F.when(F.col("_rpk") > 0, F.col("_rpk") / F.col("_total")).otherwise(0.0)).select("seq_id", "lib", "n", "tpm")


def rpkm(counts: DataFrame, lengths: DataFrame, sizes: DataFrame) -> DataFrame:
    """(n / (library size / 1e6)) * 1000 / length; ``sizes`` has lib, size."""
    rows = counts.where("rep = 0").join(lengths, "seq_id").join(sizes, "lib")
    return rows.withColumn("rpkm", F.col("n") / (F.col("size") / 1e6) * 1000 / F.col("len")).select("seq_id", "lib", "n", "rpkm")


def rpkm_to_tpm(rows: DataFrame) -> DataFrame:
    total = rows.groupBy("lib").agg(F.sum("rpkm").alias("_t"))
    return rows.join(total, "lib").withColumn("tpm", 1e6 * F.col("rpkm") / F.col("_t")).drop("_t")


def library_sizes(counts: DataFrame) -> DataFrame:
    return counts.where("rep = 0").groupBy("lib").agg(F.sum("n").alias("size"))


def with_totals(reps: DataFrame) -> DataFrame:
    """Replicate counts with a row of rep 0 per sequence and library."""
    total = reps.groupBy("seq_id", "lib").agg(F.sum("n").alias("n")).select("seq_id", "lib", F.lit(0).alias("rep"), "n")
    return reps.select("seq_id", "lib", "rep", "n").unionByName(total)


def member_counts(members: DataFrame, counts: DataFrame) -> DataFrame:
    """Counts per contig: members with a count of their own add it; others add one. ``members`` has contig, seq_id, lib."""
    own = members.join(counts.where("rep = 0").select("seq_id", F.col("lib").alias("_lib"), "n"), "seq_id", "left")
    return own.groupBy("contig", F.coalesce("_lib", "lib").alias("lib")).agg(F.sum(F.coalesce("n", F.lit(1))).alias("n"))


def r_statistic(counts: DataFrame, sizes: DataFrame) -> DataFrame:
    """sum over libraries of x * log10(x / (f * library size)) with f the sequence's share of all counts, for x above 0;
    rounded to a tenth, at least 0."""
    all_size = sizes.agg(F.sum("size").alias("_all"))
    own = counts.where("rep = 0").groupBy("seq_id").agg(F.sum("n").alias("_total"))
    rows = counts.where("rep = 0 AND n > 0").join(own, "seq_id").join(sizes, "lib").crossJoin(F.broadcast(all_size))
    term = F.col("n") * F.log10(F.col("n") / (F.col("_total") / F.col("_all") * F.col("size")))
    return rows.groupBy("seq_id").agg(F.greatest(F.round(F.sum(term), 1), F.lit(0.0)).alias("r_stat"))


def cpm_filter(samples: DataFrame, cpm: float = 1.0, least: int = 2) -> DataFrame:
    """Sequences with at least ``least`` samples whose counts per million of the sample are above ``cpm``.
    A sample is (lib, rep)."""
    total = samples.groupBy("lib", "rep").agg(F.sum("n").alias("_t"))
    high = samples.join(total, ["lib", "rep"]).where(F.col("n") / F.col("_t") * 1e6 > cpm)
    return high.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n_samples")).where(F.col("n_samples") >= least)


def count_filter(samples: DataFrame, above: int) -> DataFrame:
    return samples.where(F.col("n") > above).select("seq_id").distinct()


def library_filter(levels: DataFrame, include: dict | None = None, exclude: dict | None = None, value: str = "n") -> DataFrame:
    """Sequences by their libraries: include and exclude are {libs, value, how}; (all or any) of the included have at
    least the value, (all or any) of the excluded at most. A library that a sequence lacks counts as 0."""
    level = lambda lib: F.coalesce(F.max(F.when(F.col("lib") == lib, F.col(value))), F.lit(0))
    tests = []
    for spec, inside in ((include, True), (exclude, False)):
        if spec:
            tests.append(any_of([(level(x) >= spec["value"]) if inside else (level(x) <= spec["value"]) for x in spec["libs"]], spec.get("how", "all")))
    return levels.groupBy("seq_id").agg((combine(tests) if tests else F.lit(True)).alias("_keep")).where("_keep").select("seq_id")


def sample_matrix(samples: DataFrame, libs: list[str], reps: int) -> DataFrame:
    """Wide counts of the libraries' replicates, columns ``lib`` + number; libraries without replicates have ``lib``."""
    columns = [f"{x}{r}" for x in libs for r in range(1, reps + 1)]
    rows = samples.where(F.col("lib").isin(libs) & (F.col("rep") > 0)).withColumn("_c", F.concat("lib", F.col("rep").cast("string")))
    return rows.groupBy("seq_id").pivot("_c", columns).agg(F.sum("n")).fillna(0)


def de_results(raw: DataFrame, levels: DataFrame | None = None, group1: str | None = None, group2: str | None = None) -> DataFrame:
    """seq_id, contrast, p, direction. NaN and NULL are a result that is missing; with two groups of one library each,
    the direction is -1 where the first group's level is the lower one, else 1. ``levels`` has seq_id, lib, tpm."""
    p = F.when(F.isnan("p") | F.col("p").isNull(), None).otherwise(F.abs("p"))
    if levels is None:
        return raw.select("seq_id", "contrast", p.alias("p"), F.when(F.col("p") < 0, -1).otherwise(1).alias("direction"))
    one = lambda g: levels.where(F.col("lib") == g).select("seq_id", F.col("tpm").alias(f"_{g}"))
    rows = raw.join(one(group1), "seq_id", "left").join(one(group2), "seq_id", "left")
    low = F.coalesce(F.col(f"_{group1}"), F.lit(0.0)) < F.coalesce(F.col(f"_{group2}"), F.lit(0.0))
    return rows.select("seq_id", "contrast", p.alias("p"), F.when(low, -1).otherwise(1).alias("direction"))


def de_counts(results: DataFrame, cutoffs: tuple = DE_CUTOFFS) -> DataFrame:
    """Per contrast: results below each cutoff, up and down."""
    at = [F.sum((F.col("p") < c).cast("long")).alias(f"n_{c:g}".replace("-", "m").replace(".", "_")) for c in cutoffs]
    up = F.sum(((F.col("p") < cutoffs[-1]) & (F.col("direction") > 0)).cast("long")).alias("n_up")
    return results.groupBy("contrast").agg(F.count("p").alias("n_results"), *at, up)


def benjamini_hochberg(tests: DataFrame, p: str = "p", by: str = "contrast") -> DataFrame:
    """Adds ``adjusted``: the least of p * n / rank over this and later ranks, at most 1. Equal p have equal values.

    Ranks come from counts of distinct p per contrast, so rows with equal p, of which there may be many, are grouped
    before they are ordered. They are ordered in ranges, so no task has to hold a contrast."""
    values = tests.where(F.col(p).isNotNull()).groupBy(by, p).agg(F.count(F.lit(1)).alias("_m"))
    values = with_total(running(ranged(values, by, p), by, p, F.col("_m"), "_rank"), by, "_m", "_n")
    values = running(values, by, p, F.col(p) * F.col("_n") / F.col("_rank"), "adjusted", "min", later=True)
    values = values.select(F.col(by).alias("_by"), F.col(p).alias("_p"), F.least("adjusted", F.lit(1.0)).alias("adjusted"))
    return tests.join(values, (F.col(by) == F.col("_by")) & (F.col(p) == F.col("_p")), "left").drop("_by", "_p")


def enrichment_inputs(results: DataFrame, seq_go: DataFrame, lengths: DataFrame, cutoff: float = 0.05) -> DataFrame:
    """Of sequences with GO terms: is_de (0 or 1), length and the list of terms."""
    terms = seq_go.groupBy("seq_id").agg(F.sort_array(F.collect_set("gonum")).alias("terms"))
    rows = results.join(terms, "seq_id").join(lengths, "seq_id")
    return rows.select("seq_id", "contrast", F.coalesce((F.col("p") < cutoff).cast("int"), F.lit(0)).alias("is_de"), "len", "terms")


def de_length_stats(inputs: DataFrame) -> DataFrame:
    return inputs.where("is_de = 1").groupBy("contrast").agg(F.count(F.lit(1)).alias("n_de"), F.avg("len").alias("mean_len"), F.stddev_samp("len").alias("sd_len"))


def top_percent_cutoff(tests: DataFrame, percent: float, p: str = "p") -> DataFrame:
    """The p-value of the last of the first ``percent`` of all tests by absolute p; one row, or none without tests."""
    values = tests.where(F.col(p).isNotNull()).select(F.abs(F.col(p)).alias("cutoff"))
    n = max(values.count() * percent // 100, 1)
    return numbered_rows(values, F.col("cutoff")).where(F.col("row") == n).select("cutoff")
