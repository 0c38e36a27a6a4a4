"""Ranking, flagging, pruning and summing of database hits.

A hit row has seq_id, hit_id, db, bits, evalue, sim, seq_start, seq_end and frame; hit details add dbtype, taxonomy,
description and species. Every ranking ends with the hit id, so that it is a total order.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlake.functions import descriptions as D
from strandlake.functions.numbers import overlaps
from strandlake.plans.lineage import cut

#: Fixed value: a hit of the preferred database replaces the best annotation at this share of its bit score.
PREFERRED_SHARE = 0.7
#: Fixed value: hits up to this rank per database are kept when datasets are merged.
TOP_RANK = 5


def rank_per_database(hits: DataFrame) -> DataFrame:
    """Adds ``rank`` within (sequence, database): bit score, then e-value, then hit id."""
    return hits.withColumn("rank", F.row_number().over(Window.partitionBy("seq_id", "db").orderBy(F.desc("bits"), "evalue", "hit_id")))


def global_order() -> list[Column]:
    """Order of the hits of a sequence over all databases: bits, SwissProt, TrEMBL, e-value, good descriptions, rank, id."""
    return [F.desc("bits"), F.desc(F.col("dbtype") == "SP"), F.desc(F.col("dbtype") == "TR"), F.asc("evalue"), F.desc("good"), F.asc("rank"), F.asc("hit_id")]


def with_flags(hits: DataFrame, prefer: str | None = None) -> DataFrame:
    """Adds place, best_bits, best_anno, first_species, first_description and best_rank.

    best_anno is the first amino-acid hit with a good description; without one it is the best hit, or the first
    amino-acid hit where the best is of nucleotides. With ``prefer``, the first good hit of that database type takes its
    place if its bits are at least 0.7 of it. Both best hits get rank 1 of their databases.
    """
    by = Window.partitionBy("seq_id")
    at = F.col("place")
    rows = hits.withColumn("good", D.is_good(F.col("description"))).withColumn("place", F.row_number().over(by.orderBy(*global_order())))
    first = lambda c: F.min(F.when(c, at)).over(by)
    anno = F.coalesce(first(F.col("is_aa") & F.col("good")), first(F.col("is_aa")), F.min(at).over(by))
    rows = rows.withColumn("_anno", anno)
    if prefer:
        rows = rows.withColumn("_other", first((F.col("dbtype") == prefer) & F.col("good") & F.col("is_aa")))
        bits = lambda c: F.max(F.when(at == F.col(c), F.col("bits"))).over(by)
        rows = rows.withColumn("_anno", F.when(bits("_other") >= PREFERRED_SHARE * bits("_anno"), F.col("_other")).otherwise(F.col("_anno"))).drop("_other")
    species = F.row_number().over(Window.partitionBy("seq_id", F.lower(D.species(F.col("species")))).orderBy("place"))
    unique = F.row_number().over(Window.partitionBy("seq_id", D.unique_form(F.col("description"))).orderBy("place"))
    rank = F.when((at == 1) | (at == F.col("_anno")), 1).otherwise(F.col("rank"))
    return rows.select(
        *[rank.alias(c) if c == "rank" else F.col(c) for c in hits.columns], "place", "good", (at == 1).alias("best_bits"), (at == F.col("_anno")).alias("best_anno"),
        (species == 1).alias("first_species"), (unique == 1).alias("first_description"), (rank == 1).alias("best_rank"),
    )


def ranked_with_flags(hits: DataFrame, details: DataFrame, key: str, prefer: str | None = None) -> DataFrame:
    """Ranks and flags in one shuffle: details are joined first, then rows are dealt by sequence, which all windows of
    ``rank_per_database`` and ``with_flags`` can work on, since each of them groups by the sequence and more."""
    return with_flags(rank_per_database(hits.join(details, key).repartition("seq_id")), prefer)


def flag_number(region: Column | None = None) -> Column:
    """The flags as one number: 1 region, 2 best rank, 4 species, 8 description, 16 best bits, 32 best annotation."""
    flags = [(F.lit(False) if region is None else region, 1), (F.col("best_rank"), 2), (F.col("first_species"), 4), (F.col("first_description"), 8), (F.col("best_bits"), 16), (F.col("best_anno"), 32)]
    return sum((F.when(c, n).otherwise(0) for c, n in flags), F.lit(0)).cast("int")


def distinct_regions(hits: DataFrame, flank: int = 0) -> DataFrame:
    """Hits of a sequence that lie in no other kept hit of the same frame and orientation, with ``flank`` positions of
    slack; of two that lie in each other the better one stays. What is kept depends on order, so hits are dealt out by
    sequence and sorted, and each task reads them in order; a task holds the kept regions of one sequence at a time."""
    rows = hits.select("seq_id", "hit_id", "bits", "evalue", "seq_start", "seq_end", "frame").repartition("seq_id").sortWithinPartitions("seq_id", F.desc("bits"), "evalue", "hit_id")

    def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, kept = None, {}  # kept: by frame and orientation, (low, high, hit) of what stays so far, better ones first
        done = lambda: [(last, hit) for found in kept.values() for *_, hit in found]
        for batch in batches:
            out = []
            for row in batch.itertuples(index=False):
                if row.seq_id != last:
                    out += done()
                    last, kept = row.seq_id, {}
                low, high = sorted((row.seq_start, row.seq_end))
                better, stay = kept.setdefault((row.frame, row.seq_start <= row.seq_end), []), []
                for n, (a, b, hit) in enumerate(better):
                    if low >= a - flank and high <= b + flank:
                        stay += better[n:]
                        break
                    if not (a >= low - flank and b <= high + flank):
                        stay.append((a, b, hit))
                else:
                    stay.append((low, high, row.hit_id))
                better[:] = stay
            yield pd.DataFrame(out, columns=["seq_id", "hit_id"])
        yield pd.DataFrame(done(), columns=["seq_id", "hit_id"])

    return rows.mapInPandas(keep, hits.select("seq_id", "hit_id").schema)


#: Positions in a stretch of a sequence, where hits are paired by place; the width changes no result.
STRETCH = 500


def _placed(hits: DataFrame, side: str, keys: list[str], columns: list[str], flank: int = 0, whole: bool = True) -> DataFrame:
    """The hits' keys, their other columns and the ends of their region in order, named for a side, with a row for each
    stretch (``_at``) that the region meets with ``flank`` positions around it; or only for the one where it starts."""
    ends = [f("seq_start", "seq_end").cast("long") for f in (F.least, F.greatest)]
    rows = hits.where("seq_start IS NOT NULL AND seq_end IS NOT NULL").withColumns({"low": ends[0], "high": ends[1], "turned": F.col("seq_start") > F.col("seq_end")})
    at = lambda x: F.floor(x / STRETCH)
    stretch = F.explode(F.sequence(at(F.col("low") - flank), at(F.col("high") + flank))) if whole else at(F.col("low"))
    return rows.select(*keys, *[F.col(c).alias(f"{side}_{c}") for c in (*columns, "low", "high")], stretch.alias("_at"))


def contained(hits: DataFrame, flank: int = 0) -> DataFrame:
    """Pairs (seq_id, inner_hit, outer_hit) of hits where the inner lies in a better hit of the same frame and orientation,
    with ``flank`` positions of slack: the set-based rule. Hits without a region, frame or bits are in no pair.

    Hits meet by stretches of a sequence, the inner one where it starts, so those far apart are never held against each
    other and a sequence with many hits is shared out."""
    keys, columns = ["seq_id", "frame", "turned"], ["hit_id", "bits"]
    inner, outer = _placed(hits, "i", keys, columns, whole=False), _placed(hits, "o", keys, columns, flank)
    better = (F.col("o_bits") > F.col("i_bits")) | ((F.col("o_bits") == F.col("i_bits")) & (F.col("o_hit_id") < F.col("i_hit_id")))
    inside = (F.col("i_low") >= F.col("o_low") - flank) & (F.col("i_high") <= F.col("o_high") + flank)
    return inner.join(outer, [*keys, "_at"]).where(better & inside).select("seq_id", F.col("i_hit_id").alias("inner_hit"), F.col("o_hit_id").alias("outer_hit"))


def overlapping(hits: DataFrame) -> DataFrame:
    """Pairs (seq_id, hit1, hit2) of a sequence's hits, the smaller id first, whose regions share a position, ends not
    counted; hits without a region are in no pair. Hits meet by stretches, a pair in the one where the later one starts."""
    a, b = (_placed(hits, side, ["seq_id"], ["hit_id"]) for side in ("a", "b"))
    here = F.col("_at") == F.floor(F.greatest("a_low", "b_low") / STRETCH)
    met = here & (F.col("a_hit_id") < F.col("b_hit_id")) & overlaps(F.col("a_low"), F.col("a_high"), F.col("b_low"), F.col("b_high"))
    return a.join(b, ["seq_id", "_at"]).where(met).select("seq_id", F.col("a_hit_id").alias("hit1"), F.col("b_hit_id").alias("hit2"))


#: What has to be equal for two hits to be the same alignment; columns that the hits lack are passed over.
SAME_ALIGNMENT = ("bits", "evalue", "sim", "aln", "gaps", "mismatches", "seq_start", "seq_end", "hit_start", "hit_end", "hit_len")


def prune(hits: DataFrame, by: str = "description", slack: float = PREFERRED_SHARE) -> DataFrame:
    """Hits of each (sequence, database) without those that repeat one before: of neighbours with the same description
    (without ``{..}``), or with the same alignment as well, one stays.

    Neighbours stand in order of description, bits, e-value, similarity, rank and id. A hit is held against the last one
    kept of its run, which it replaces if it alone has a good description; or has terms, where that one has none and its
    bits are at least ``slack`` of it; or has more terms and no fewer bits. What a run keeps depends on all before, so a
    task reads its rows in order and carries one row along, whatever the length of a run. Where no hit of rank 1 is left
    in a sequence and database, the first by rank and id becomes one; other ranks stay.

    ``hits`` has rank, and ``go``, an array of terms; a null array has none. An empty table gives none."""
    names = hits.columns
    run = ["seq_id", "db", "_d"]
    order = [F.desc("bits"), F.asc("evalue"), F.desc("sim"), F.asc("rank"), F.asc("hit_id")]
    rows = hits.withColumns({"_d": D.without_evidence(F.col("description")), "_good": D.is_good(F.col("description")), "_n": F.greatest(F.size("go"), F.lit(0))})
    window = Window.partitionBy(*run).orderBy(*order)
    first = F.row_number().over(window) == 1
    if by != "description":
        like = F.struct(*[c for c in SAME_ALIGNMENT if c in names])
        first = first | ~like.eqNullSafe(F.lag(like).over(window))
    rows = rows.repartition(*run).withColumn("_first", first).sortWithinPartitions(*run, *order)

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # the last row kept, which the next one may still replace
        for batch in batches:
            both = batch if held is None else pd.concat([held, batch], ignore_index=True)
            good, n, bits, starts = (both[c].tolist() for c in ("_good", "_n", "bits", "_first"))
            keep, last = [True] * len(both), 0
            for i in range(1, len(both)):
                if not starts[i]:
                    better = good[i] and not good[last]
                    if not better and n[i] > n[last]:
                        better = bits[i] >= (slack * bits[last] if n[last] == 0 else bits[last])
                    keep[last if better else i] = False
                    if not better:
                        continue
                last = i
            held = both.iloc[[last]]
            keep[last] = False
            yield both[keep][names]
        if held is not None:
            yield held[names]

    kept = rows.mapInPandas(walk, hits.schema)
    top = F.min(F.struct("rank", "hit_id")).over(Window.partitionBy("seq_id", "db"))
    rank = F.when((F.col("_top.rank") > 1) & (F.col("_top.hit_id") == F.col("hit_id")), 1).otherwise(F.col("rank"))
    return kept.withColumn("_top", top).withColumn("rank", rank).select(*names)


def merge_hits(hits: DataFrame, top: int = TOP_RANK) -> DataFrame:
    """What a merged database keeps: the first ranks, and best hits of any kind."""
    return hits.where((F.col("rank") <= top) | F.col("best_bits") | F.col("best_anno"))


def by_hit(hits: DataFrame, libraries: Iterable[str] = (), contrasts: Iterable[str] = ()) -> DataFrame:
    """One row per hit id: sequences, best and rank-1 counts, the best alignment (bits, then e-value, then similarity),
    the greatest count per library and the p-value nearest to 0 per contrast, with its sign."""
    best = F.struct(F.col("bits"), (-F.col("evalue")).alias("e"), F.col("sim"), (-F.col("seq_id")).alias("s"))
    count = lambda c: F.sum(F.col(c).cast("long"))
    more = [F.max(c).alias(c) for c in libraries] + [F.min_by(c, F.struct(F.abs(c), F.col("seq_id"))).alias(c) for c in contrasts]
    rows = hits.groupBy("hit_id").agg(
        F.countDistinct("seq_id").alias("n_seqs"), count("best_bits").alias("n_best_bits"), count("best_anno").alias("n_best_anno"), count("best_rank").alias("n_rank1"),
        F.max(best).alias("_best"), *more,
    )
    return rows.select("hit_id", "n_seqs", "n_best_bits", "n_best_anno", "n_rank1", F.col("_best.bits").alias("bits"), (-F.col("_best.e")).alias("evalue"), F.col("_best.sim").alias("sim"), (-F.col("_best.s")).alias("best_seq"), *libraries, *contrasts)


def species_counts(hits: DataFrame) -> DataFrame:
    """Per species (two words): hits, and those that are the best by bits and by annotation, most of these first."""
    n = lambda c: F.sum(F.col(c).cast("long"))
    rows = hits.groupBy(D.species(F.col("species")).alias("species")).agg(F.count(F.lit(1)).alias("n_hits"), n("best_bits").alias("n_best_bits"), n("best_anno").alias("n_best_anno"))
    return rows.orderBy(F.desc("n_best_bits"), F.desc("n_best_anno"), F.desc("n_hits"), "species")


def database_counts(hits: DataFrame) -> DataFrame:
    """Per database: hits, best hits, and sequences that no other database hits."""
    only = hits.groupBy("seq_id").agg(F.min("db").alias("db"), F.max("db").alias("_last")).where("db = _last").groupBy("db").agg(F.count(F.lit(1)).alias("n_only"))
    n = lambda c: F.sum(F.col(c).cast("long"))
    rows = hits.groupBy("db").agg(F.count(F.lit(1)).alias("n_hits"), n("best_bits").alias("n_best_bits"), n("best_anno").alias("n_best_anno"))
    return rows.join(only, "db", "left").fillna(0, ["n_only"])


def unique_hit_counts(hits: DataFrame) -> DataFrame:
    return hits.groupBy("hit_id").agg(F.countDistinct("seq_id").alias("n_seqs"), F.sum(F.col("best_bits").cast("long")).alias("n_best"), F.min("evalue").alias("best_evalue"))


def unhit_entries(hits: DataFrame, known: DataFrame) -> DataFrame:
    """Entries of each database that no sequence hits: ``known`` has db and hit_id (a right join, counted)."""
    seen = hits.select("hit_id", F.lit(1).alias("_seen")).distinct()
    rows = seen.join(known, "hit_id", "right").groupBy("db")
    return rows.agg(F.count(F.lit(1)).alias("n_known"), F.count("_seen").alias("n_hit"), F.sum(F.col("_seen").isNull().cast("long")).alias("n_unhit"))


def shared_hit(pairs: DataFrame, hits: DataFrame, common: int = 30) -> DataFrame:
    """For each pair (seq1, seq2) the best hit that both have: greatest sum of bits, then hit id.

    Sequences with a hit of up to ``common`` sequences are brought together by it and then looked up among the pairs, which
    costs at most ``common`` rows for each hit of a sequence. Only for hits that more sequences have, of which a sequence
    has few, each pair is joined with its first sequence's hits."""
    degree = hits.groupBy("hit_id").agg(F.count(F.lit(1)).alias("_n"))
    hits = hits.select("seq_id", "hit_id", "bits").join(degree, "hit_id")
    side = lambda d, n: d.select(F.col("seq_id").alias(f"seq{n}"), "hit_id", F.col("bits").alias(f"_b{n}"))
    pairs = pairs.select("seq1", "seq2")
    few, many = hits.where(F.col("_n") <= common), hits.where(F.col("_n") > common)
    near = side(few, 1).join(side(few, 2), "hit_id").where("seq1 <= seq2").select(F.col("seq1").alias("_low"), F.col("seq2").alias("_high"), "hit_id", "_b1", "_b2")
    by_hit = pairs.withColumns({"_low": F.least("seq1", "seq2"), "_high": F.greatest("seq1", "seq2")}).join(near, ["_low", "_high"]).drop("_low", "_high")
    both = by_hit.unionByName(pairs.join(side(many, 1), "seq1").join(side(many, 2), ["seq2", "hit_id"]))
    return both.groupBy("seq1", "seq2").agg(F.max_by("hit_id", F.struct((F.col("_b1") + F.col("_b2")).alias("s"), (-F.col("hit_id")).alias("h"))).alias("hit_id"))


def with_shared_hit(pairs: DataFrame, hits: DataFrame, common: int = 30) -> DataFrame:
    """Pairs with ``hit_id``, the hit that ``shared_hit`` gives them, or null. Each has seq1 up to seq2.

    The best hit of two sequences is found among all that share one before pairs are looked at, so that pairs are read and
    shuffled once, by the same key. Hits that more than ``common`` sequences have are listed first; only if there are any,
    hits are told apart by it and pairs are read again for these."""
    heavy = cut(hits.groupBy("hit_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > common).select("hit_id"))
    any_ = bool(heavy.head(1))
    hits = hits.select("seq_id", "hit_id", "bits")
    side = lambda d, n: d.select(F.col("seq_id").alias(f"seq{n}"), "hit_id", F.col("bits").alias(f"_b{n}"))
    few = hits.join(heavy, "hit_id", "left_anti") if any_ else hits
    place = F.struct((F.col("_b1") + F.col("_b2")).alias("s"), (-F.col("hit_id")).alias("h")).alias("_p")
    rows = side(few, 1).join(side(few, 2), "hit_id").where("seq1 <= seq2").select("seq1", "seq2", place)
    if any_:
        many = hits.join(heavy, "hit_id", "left_semi")
        rows = rows.unionByName(pairs.select("seq1", "seq2").join(side(many, 1), "seq1").join(side(many, 2), ["seq2", "hit_id"]).select("seq1", "seq2", place))
    best = rows.groupBy("seq1", "seq2").agg(F.max("_p").alias("_p")).select("seq1", "seq2", (-F.col("_p.h")).alias("hit_id"))
    return pairs.join(best, ["seq1", "seq2"], "left")


def new_hits(loaded: DataFrame, arriving: DataFrame) -> DataFrame:
    """Arriving hits whose (sequence, hit) is not loaded yet."""
    return arriving.join(loaded.select("seq_id", "hit_id"), ["seq_id", "hit_id"], "left_anti")


def first_in_file(pairs: DataFrame, line: str = "line") -> DataFrame:
    """Of repeated pairs, the one that comes first in the file; ``line`` carries its place."""
    columns = [c for c in pairs.columns if c not in ("seq1", "seq2")]
    best = pairs.groupBy("seq1", "seq2").agg(F.min_by(F.struct(*columns), line).alias("_row"))
    return best.select("seq1", "seq2", *[F.col(f"_row.{c}").alias(c) for c in columns])
