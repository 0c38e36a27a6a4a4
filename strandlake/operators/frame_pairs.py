"""Which reading frames of two sequences to align, and how the parts around their coding regions differ.

Alignments are tried in turn for all pairs at once: the next frames are aligned only for pairs that the last ones left
undecided. What is chosen is a maximum over the rows of a pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as Q
from strandlake.operators.alignment import Matrix, align_pairs, columns_of, trimmed
from strandlake.plans.lineage import cut

#: Similarity in percent above which frames are good with fewer stops than the number beside it.
GOOD = ((90, None), (80, 50), (60, 10), (50, 5))
#: Fixed value: letters that an overlap has to have more of, to be scored without what hangs over.
LEAST_OVERLAP = 3
REGIONS = ("utr5", "cds", "utr3")


def good_enough(sim: Column, stops: Column) -> Column:
    return reduce(lambda a, b: a | b, ((sim > s) if n is None else ((sim > s) & (stops < n)) for s, n in GOOD))


def overlap_similarity(aligned: DataFrame, matrix: Matrix | None = None) -> DataFrame:
    """Adds sim, the percentage of the overlap's columns with letters that score above 0 (that are equal, without a
    matrix), and stops, its columns with a stop in either. Columns with a stop or a gap are no match."""
    pairs = [a + b for i, a in enumerate(matrix[0]) for j, b in enumerate(matrix[0]) if matrix[1][i, j] > 0] if matrix else []
    alike = (lambda c: F.concat(c["x"], c["y"]).isin(*pairs)) if pairs else (lambda c: c["x"] == c["y"])
    rows = aligned.withColumn("_c", columns_of(*trimmed(F.col("aligned1"), F.col("aligned2"))))
    has = lambda c, x: (c["x"] == x) | (c["y"] == x)
    match = F.size(F.filter("_c", lambda c: alike(c) & ~has(c, "*") & ~has(c, "-")))
    sim = F.when(F.size("_c") > 0, 100.0 * match / F.size("_c")).otherwise(0.0)
    return rows.withColumns({"sim": sim, "stops": F.size(F.filter("_c", lambda c: has(c, "*")))}).drop("_c")


def frame_choice(pairs: DataFrame, matrix: Matrix | None = None) -> DataFrame:
    """seq1, seq2, frame1, frame2, sim, stops, tried (alignments made): the frames in which two nucleotide sequences are
    compared as proteins.

    The ORFs' frames are taken if they are good enough. Else, for a pair found as proteins, the hit's frames are, if they
    are good enough, or the better of the two. A pair found as nucleotides keeps the ORFs' frames if the first one has the
    hit's orientation; else all frames of the hit's orientations are tried and the best is taken. Better is a greater
    similarity, then more stops; of equal ones the one tried first: ORFs, then frames from 3 down.

    ``pairs`` has one row for each seq1, seq2, with text1, text2, orf1, orf2, hit1, hit2 (1 to 3, -1 to -3) and is_aa. A
    null or zero frame has no letters, and a null text none either; such a try has similarity 0."""
    keys = ["seq1", "seq2"]
    rows = pairs.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("orf1", "orf2", "hit1", "hit2")})

    def tried(some: DataFrame, place: Column, f1: Column, f2: Column) -> DataFrame:
        protein = lambda text, f: F.when((f == 0) | text.isNull(), "").otherwise(Q.translate(text, F.when(f == 0, 1).otherwise(f)))
        texts = some.select(*keys, place.cast("int").alias("place"), f1.alias("frame1"), f2.alias("frame2"), protein(F.col("text1"), f1).alias("aa1"), protein(F.col("text2"), f2).alias("aa2"))
        return overlap_similarity(align_pairs(texts, matrix, columns=("aa1", "aa2")), matrix).select(*keys, "place", "frame1", "frame2", "sim", "stops")

    orf = cut(tried(rows, F.lit(0), F.col("orf1"), F.col("orf2")))
    open_ = orf.where(~good_enough(F.col("sim"), F.col("stops"))).select(*keys)
    rest = rows.join(open_, keys, "left_semi")
    other = rest.where(F.col("is_aa") & ~((F.col("orf1") == F.col("hit1")) & (F.col("orf2") == F.col("hit2"))))
    hit = tried(other, F.lit(1), F.col("hit1"), F.col("hit2"))
    side = lambda c: F.when(F.col(c) > 0, F.array(*map(F.lit, (3, 2, 1)))).when(F.col(c) < 0, F.array(*map(F.lit, (-1, -2, -3)))).otherwise(F.array().cast("array<int>"))
    turned = rest.where(~F.col("is_aa") & ~(F.signum("hit1") * F.signum("orf1") > 0))
    nine = turned.select("*", F.posexplode(side("hit1")).alias("_p", "_f")).select("*", F.posexplode(side("hit2")).alias("_q", "_g"))
    nine = nine.where(~((F.col("_f") == F.col("orf1")) & (F.col("_g") == F.col("orf2"))))
    all_ = tried(nine, 2 + F.col("_p") * 3 + F.col("_q"), F.col("_f"), F.col("_g"))
    first = (F.col("place") == 1) & good_enough(F.col("sim"), F.col("stops"))
    found = orf.unionByName(hit).unionByName(all_).groupBy(*keys).agg(
        F.max_by(F.struct("frame1", "frame2", "sim", "stops"), F.struct(first, "sim", "stops", -F.col("place"))).alias("_b"), F.count(F.lit(1)).alias("tried")
    )
    return found.select(*keys, "_b.*", "tried")


def regions(rows: DataFrame) -> DataFrame:
    """Adds utr5, cds and utr3, cut from ``seq`` on the strand of ``frame`` by ``start`` and ``end`` (from 1). Without a
    frame all three are null."""
    strand = F.upper(F.when(F.col("frame") < 0, Q.reverse_complement(F.col("seq"))).otherwise(F.col("seq")))
    whole = (F.col("frame") != 0) & (F.col("start") > 0)
    part = lambda a, b: F.when(whole, Q.region(strand, a, b))
    return rows.withColumns({"utr5": part(F.lit(1), F.col("start") - 1), "cds": part(F.col("start"), F.col("end")), "utr3": part(F.col("end") + 1, F.length("seq"))})


def region_totals(rows: DataFrame) -> DataFrame:
    """region, n, bases, c, g, cpg over sequences with utr5, cds and utr3, and for coding regions gc1, gc2, gc3: G and C at
    each place of the codons before the last one."""
    long_ = rows.select(F.explode(F.array(*[F.struct(F.lit(r).alias("region"), F.col(r).alias("t")) for r in REGIONS])).alias("_r")).select("_r.*").where("t IS NOT NULL")
    n = lambda x: F.length("t") - F.length(F.replace("t", F.lit(x), F.lit("")))
    coding = F.when(F.col("region") == "cds", Q.codons(F.substring(F.col("t"), F.lit(1), F.length("t") - 1)))
    place = lambda i: F.sum(F.size(F.filter(coding, lambda c: F.substring(c, i, 1).isin("G", "C"))).cast("long")).alias(f"gc{i}")
    total = lambda c, name: F.sum(c.cast("long")).alias(name)
    return long_.groupBy("region").agg(F.count(F.lit(1)).alias("n"), total(F.length("t"), "bases"), total(n("C"), "c"), total(n("G"), "g"), total(F.regexp_count("t", F.lit("CG")), "cpg"), *[place(i) for i in (1, 2, 3)])


def differences(aligned: DataFrame) -> DataFrame:
    """Adds len and diff, the columns of an alignment and those with two characters, and len_inner and diff_inner, the same
    of its overlap; the latter are null for overlaps of up to 3 letters. Where either text has no letters, diff is 0."""
    a, b = F.col("aligned1"), F.col("aligned2")
    inner1, inner2 = trimmed(a, b)
    unequal = lambda x, y: F.size(F.filter(columns_of(x, y), lambda c: c["x"] != c["y"]))
    empty = (F.length(F.replace(a, F.lit("-"), F.lit(""))) == 0) | (F.length(F.replace(b, F.lit("-"), F.lit(""))) == 0)
    enough = ~empty & (F.length(inner1) > LEAST_OVERLAP)
    return aligned.withColumns({"len": F.length(a), "diff": F.when(empty, 0).otherwise(unequal(a, b)), "len_inner": F.when(enough, F.length(inner1)), "diff_inner": F.when(enough, unequal(inner1, inner2))})


def region_differences(pairs: DataFrame) -> DataFrame:
    """seq1, seq2 and for each region its ``differences`` (utr5_len and so on), each region aligned for itself.

    ``pairs`` has seq1, seq2 and utr5_1, cds_1, utr3_1, utr5_2, cds_2, utr3_2. The three are aligned as rows of one table, so
    that a long region of one pair does not hold up the others. A null region has nulls."""
    parts = F.array(*[F.struct(F.lit(r).alias("region"), F.col(f"{r}_1").alias("text1"), F.col(f"{r}_2").alias("text2")) for r in REGIONS])
    rows = differences(align_pairs(pairs.select("seq1", "seq2", F.explode(parts).alias("_r")).select("seq1", "seq2", "_r.*")))
    value = lambda r, c: F.max(F.when(F.col("region") == r, F.col(c))).alias(f"{r}_{c}")
    return rows.groupBy("seq1", "seq2").agg(*[value(r, c) for r in REGIONS for c in ("len", "diff", "len_inner", "diff_inner")])
