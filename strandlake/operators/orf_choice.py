"""The choice of one reading frame per sequence, with or without the region of a database hit.

Candidates come from one scan of each strand, are pruned by a walk over neighbouring starts, scored, and reduced twice by
the same comparison: to one per frame, then to one per sequence. Walk and reductions are folds over sorted arrays of a
frame's candidates, which a sequence's length bounds. The comparison is no total order, so the order of the fold is part of
the rule: by start, starts with a codon ATG first, then by end, then those after a stop first, as a scan upward finds them;
frames from -3 to 3.

Positions are from 1 on the strand of the frame.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as Q
from strandlake.operators.orf import GOOD_EVALUE, GOOD_SIM, GREAT_COVERAGE, GREAT_SIM, LENGTH_GAP, MARKOV_GAP, ORDER

#: Fixed values. A candidate has more letters than LEAST, or LEAST_SHORT in sequences of up to LEAST letters. A whole frame
#: without a stop is a candidate if its first ATG lies beyond LATE_ATG; a hit's start may be up to INSIDE codons in.
LEAST, LEAST_SHORT, LATE_ATG, INSIDE = 30, 9, 10, 10
#: Distances below which one of two neighbouring starts goes: an ATG and a start after a stop, or any two.
CLOSE_TO_STOP, CLOSE = 120, 30
#: From this length and this Markov score on, differences count before those of smaller ones.
LONG, STRONG = 100, 10.0
#: A hit in several frames that stays below all three percentages is no good hit.
MULTI_FRAME = 40
#: Letters N are left out of the length of candidates that have so many in a row.
N_RUN = 9
#: Training: word length, share in percent from which two profiles are the same, log ratio up to which counts are.
WORD, SAME_PERCENT, SAME_COUNT = 5, 99, 0.5

FRAMES = (-3, -2, -1, 1, 2, 3)
CANDIDATE = "seq_id long, frame int, start int, end int, has_start boolean, has_stop boolean, after_stop boolean, anno boolean, good_hit boolean, full boolean, n_known int, orf string"
#: Candidates, and letters of them, that a task hands over at once.
HELD, HELD_LETTERS = 4096, 1 << 20
_STOP = re.compile("TAA|TAG|TGA")
_COMPLEMENT = str.maketrans("ACGT", "TGCA")


def hit_choice(hits: DataFrame, sequences: DataFrame, least_seq: float = 0, least_hit: float = 0) -> DataFrame:
    """seq_id, frame, hit_start, hit_end (on the strand), n_stops, good_hit, great_hit: the protein hit that guides each
    sequence, its best one by bits or else its best annotated one.

    A hit is good by e-value or similarity if both coverages reach their cutoffs; a hit of a sequence with hits in several
    frames (``multi_frame``) needs one of similarity and coverages to be 40 at least. Stops are counted in the codons of
    the hit before its last one. Rows with coordinates outside the sequence, or nulls in them, take no part. ``hits`` has
    seq_id, hit_id, is_aa, best_bits, best_anno, multi_frame, evalue, sim, seq_cov, hit_cov, seq_start and seq_end, where
    a start after the end means the other strand."""
    own = hits.where("is_aa AND (best_bits OR best_anno)")
    columns = ["evalue", "sim", "seq_cov", "hit_cov", "seq_start", "seq_end", "multi_frame"]
    one = own.groupBy("seq_id").agg(F.min_by(F.struct(*columns), F.struct(~F.col("best_bits"), "hit_id")).alias("_h")).select("seq_id", "_h.*")
    rows = one.join(sequences.select("seq_id", F.upper("seq").alias("_s")), "seq_id").withColumn("_n", F.length("_s"))
    rows = rows.where((F.least("seq_start", "seq_end") > 0) & (F.greatest("seq_start", "seq_end") <= F.col("_n")))
    turned = F.col("seq_end") <= F.col("seq_start")
    on = lambda c: F.when(turned, F.col("_n") - F.col(c) + 1).otherwise(F.col(c)).cast("int")
    rows = rows.withColumns({"hit_start": on("seq_start"), "hit_end": on("seq_end"), "_s": F.when(turned, Q.reverse_complement(F.col("_s"))).otherwise(F.col("_s"))})
    frame = (F.col("hit_start") + 2) % 3 + 1
    inside = Q.codons(Q.region(F.col("_s"), F.col("hit_start"), F.col("hit_end") - 1))
    good = ((F.col("evalue") <= GOOD_EVALUE) | (F.col("sim") >= GOOD_SIM)) & (F.col("seq_cov") >= least_seq) & (F.col("hit_cov") >= least_hit)
    poor = F.col("multi_frame") & (F.greatest("hit_cov", "seq_cov", "sim") < MULTI_FRAME)
    return rows.select(
        "seq_id", F.when(turned, -frame).otherwise(frame).cast("int").alias("frame"), "hit_start", "hit_end",
        F.size(F.filter(inside, lambda c: c.isin("TAA", "TAG", "TGA"))).alias("n_stops"), (good & ~poor).alias("good_hit"),
        ((F.col("hit_cov") >= GREAT_COVERAGE) & (F.col("sim") >= GREAT_SIM)).alias("great_hit"),
    )


Found = tuple[int, int, bool, bool, bool]


def between_stops(strand: str, frame: int) -> Iterator[Found]:
    """start, end, has_start, has_stop, after_stop of a frame's stretches between stops, and from the first ATG of each.
    An open stretch goes where the ATG begins it, and in a frame without stops where an ATG comes early."""
    size, first = len(strand), abs(frame)
    codons = [(i, strand[i - 1 : i + 2]) for i in range(first, size - 1, 3)]
    stops = [i + 2 for i, c in codons if _STOP.fullmatch(c)]
    begins = [first, *(s + 1 for s in stops)]
    for n, begin in enumerate(begins):
        stop = stops[n] if n < len(stops) else None
        end = stop or size
        atg = next((i for i, c in codons if begin <= i <= end and c == "ATG"), None)
        open_ = atg is None or atg > LATE_ATG if not stops else atg != begin
        if open_:
            yield begin, end, False, stop is not None, n > 0
        if atg is not None:
            yield atg, end, True, stop is not None, False


def around_hit(strand: str, frame: int, hit_start: int, hit_end: int, least: int) -> Iterator[Found]:
    """Candidates that a hit's region anchors: the region itself if an ATG begins it and a stop follows, else every ATG
    from its start up to the stop before it, that stop, or the frame's begin, down to the first stop from the region's last
    codon on. Without an ATG up there, the first within the region's first codons counts."""
    size = len(strand)
    codon = lambda i: strand[i - 1 : i + 2]
    begins = codon(hit_start) == "ATG"
    if begins and _STOP.fullmatch(codon(hit_end + 1)):
        yield hit_start, hit_end + 3, True, True, False
        return
    stop = next((i + 2 for i in range(hit_end - 2, size - 1, 3) if _STOP.fullmatch(codon(i))), None)
    end = stop or size
    if begins and end - hit_start + 1 > least:
        yield hit_start, end, True, stop is not None, False
        return
    atg = before = None
    for i in range(hit_start, 0, -3):
        if codon(i) == "ATG":
            atg = i
            yield i, end, True, stop is not None, False
        elif _STOP.fullmatch(codon(i)):
            before = i + 3
            yield before, end, False, stop is not None, True
            break
    if atg is None:
        atg = next((i for i in range(hit_start, min(hit_start + 3 * INSIDE, size - 1), 3) if codon(i) == "ATG"), None)
        if atg is not None:
            yield atg, end, True, stop is not None, False
    if atg is None and stop is None:
        yield hit_start, hit_end, False, False, False
    if before is None:
        yield abs(frame), end, False, stop is not None, False


def candidates(sequences: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Candidates of all frames of seq_id, seq, as CANDIDATE has them. ``hits`` is what ``hit_choice`` gives: the frame of
    a good hit is searched from its region, or in full if the region has stops. ``anno`` marks candidates of the hit's frame
    that overlap it. An end that leaves part of a codon is moved back to a whole one. Null and empty sequences have none."""
    rows = sequences.select(F.col("seq_id").cast("long").alias("seq_id"), "seq")
    extra = ["hit_frame", "hit_start", "hit_end", "n_stops", "good_hit"]
    if hits is None:
        rows = rows.select("*", *[F.lit(None).cast("boolean" if c == "good_hit" else "int").alias(c) for c in extra])
    else:
        rows = rows.join(hits.select("seq_id", F.col("frame").alias("hit_frame"), *extra[1:]), "seq_id", "left")

    names = [c.split()[0] for c in CANDIDATE.split(", ")]

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, size = [], 0
        for batch in batches:
            for r in batch.itertuples(index=False):
                if not r.seq:
                    continue
                seq, has_hit = r.seq.upper(), pd.notna(r.hit_frame)
                good = has_hit and bool(r.good_hit)
                least = LEAST_SHORT if len(seq) <= LEAST else LEAST
                for frame in FRAMES:
                    strand = seq if frame > 0 else seq.translate(_COMPLEMENT)[::-1]
                    here = has_hit and frame == r.hit_frame
                    if here and good and not r.n_stops:
                        found = around_hit(strand, frame, int(r.hit_start), int(r.hit_end), least)
                    else:
                        found = between_stops(strand, frame)
                    for start, end, atg, stop, after in dict.fromkeys(found):
                        if end - start + 1 <= least:
                            continue
                        end -= (end - start + 1) % 3
                        orf = strand[start - 1 : end]
                        known = len(orf) - (orf.count("N") if "N" * N_RUN in orf else 0)
                        anno = bool(here and r.hit_start <= end and r.hit_end >= start)
                        out.append((r.seq_id, frame, start, end, atg, stop, after, anno, good, abs(len(orf) - len(seq)) <= 3, known, orf))
                        size += len(orf)
                        if len(out) >= HELD or size >= HELD_LETTERS:
                            yield pd.DataFrame(out, columns=names)
                            out, size = [], 0
        if out:
            yield pd.DataFrame(out, columns=names)

    return rows.mapInPandas(scan, CANDIDATE)


def _in_order(rows: DataFrame, *by: str) -> DataFrame:
    """A row for each group with its candidates as a sorted array ``_all`` of structs."""
    columns = [c for c in rows.columns if c not in by or c == "frame"]
    place = ([F.col("frame").alias("_f")] if "frame" not in by else []) + [F.col("start").alias("_s"), (~F.col("has_start")).alias("_a"), F.col("end").alias("_e"), (~F.col("after_stop")).alias("_t")]
    array = F.sort_array(F.collect_list(F.struct(*place, F.struct(*columns).alias("row"))))
    return rows.groupBy(*by).agg(F.transform(array, lambda x: x["row"]).alias("_all"))


def without_close_starts(rows: DataFrame) -> DataFrame:
    """Candidates left after a walk over a frame's starts: of a start and the last one kept before it, one goes if they are
    less than 120 apart and one is an ATG and the other follows a stop (the ATG stays), or less than 30 apart: then the one
    without an ATG, or the later one where both or neither have it (of equal starts, the earlier in order)."""

    def step(kept: Column, x: Column) -> Column:
        last = F.element_at(kept, -1)
        gap, a, b = x["start"] - last["start"], last["has_start"], x["has_start"]
        near, rather = gap < CLOSE, gap < CLOSE_TO_STOP
        later = F.when(rather & a & x["after_stop"], True).when(rather & last["after_stop"] & b, False).when(near & (a != b), a).when(near, gap > 0)
        return F.when(later.isNull(), F.concat(kept, F.array(x))).when(later, kept).otherwise(F.concat(F.slice(kept, 1, F.size(kept) - 1), F.array(x)))

    grouped = _in_order(rows, "seq_id", "frame")
    kept = F.aggregate(F.slice("_all", 2, F.size("_all")), F.slice("_all", 1, 1), step)
    return grouped.select("seq_id", F.inline(kept)).select(*rows.columns)


def with_markov(rows: DataFrame, scores: DataFrame, k: int = ORDER + 1) -> DataFrame:
    """Adds ``markov``, the sum of the scores of the k-mers of ``orf`` by phase; k-mers without a score add nothing. The
    table has at most 3 * 4**k rows (12,288 by default) and goes to the tasks as one array."""
    table = np.zeros((4**k, 3))
    code = {c: i for i, c in enumerate("ACGT")}
    for r in scores.collect():
        table[sum(code[c] * 4 ** (k - 1 - i) for i, c in enumerate(r.kmer)), r.phase] = r.score
    digit = np.full(256, -1)
    digit[[ord(c) for c in "ACGT"]] = range(4)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields), "markov double"])

    def sums(text: str) -> float:
        d = digit[np.frombuffer(text.encode("latin-1", "replace"), np.uint8)]
        n = len(d) - k + 1
        if n <= 0:
            return 0.0
        number, bad = np.zeros(n, int), np.zeros(n, bool)
        for i in range(k):
            number, bad = number * 4 + d[i : i + n], bad | (d[i : i + n] < 0)
        phase = (np.arange(n) + k - 1) % 3
        return float(table[number[~bad], phase[~bad]].sum())

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(markov=[sums(t) for t in batch["orf"]])

    return rows.mapInPandas(add, schema)


def comparison(x: Column, y: Column) -> Column:
    """Below 0 where x is the better candidate, above 0 where y is, 0 where neither. In turn: length of 9; a full frame 1
    with hit and ATG; the hit, if it is good; log lengths more than 0.4 apart, then log Markov scores more than 0.3 apart,
    of long or strong ones first; both ends; an ATG against a stop before; any hit; the score if it differs by more, else
    the length. Differences of scores count in whole numbers."""
    size = lambda c: c["end"] - c["start"] + 1
    flag = lambda f: F.when(f(x) & ~f(y), -1).when(~f(x) & f(y), 1)
    log_len = lambda c: F.when(c["n_known"] > 0, F.log(c["n_known"].cast("double"))).otherwise(0.0)
    log_mk = lambda c: F.when(F.abs(c["markov"]) < 1, 0.01).otherwise(F.log(F.abs(c["markov"]))) * F.when(c["markov"] < 0, -1).otherwise(1)
    by_len, by_mk = size(y) - size(x), (y["markov"] - x["markov"]).cast("int")
    len_gap, mk_gap = F.abs(log_len(x) - log_len(y)), F.abs(log_mk(x) - log_mk(y))
    full = x["full"] & y["full"] & (x["frame"] == 1)
    long_, strong = (size(x) > LONG) | (size(y) > LONG), (x["markov"] > STRONG) | (y["markov"] > STRONG)
    ends = lambda c: c["has_start"] & c["has_stop"]
    return (
        F.when((size(x) < LEAST_SHORT) & (size(y) < LEAST_SHORT), 0).when(size(x) < LEAST_SHORT, 1).when(size(y) < LEAST_SHORT, -1)
        .when(full & (ends_differ := flag(lambda c: c["anno"] & c["has_start"])).isNotNull(), ends_differ)
        .when(full & ~x["anno"] & ~y["anno"] & (starts := flag(lambda c: c["has_start"])).isNotNull(), starts)
        .when(x["good_hit"] & (hit := flag(lambda c: c["anno"])).isNotNull(), hit)
        .when(long_ & (len_gap > LENGTH_GAP), by_len).when(strong & (mk_gap > MARKOV_GAP), by_mk)
        .when(len_gap > LENGTH_GAP, by_len).when(mk_gap > MARKOV_GAP, by_mk)
        .when((both := flag(ends)).isNotNull(), both)
        .when(x["has_start"] & y["after_stop"], -1).when(x["after_stop"] & y["has_start"], 1)
        .when(hit.isNotNull(), hit).when(len_gap < mk_gap, by_mk).otherwise(by_len)
    )


def reduced(rows: DataFrame, *by: str) -> DataFrame:
    """One row of each group: the first in order, replaced by any later one that the comparison puts before it."""
    grouped = _in_order(rows, *by)
    best = F.aggregate(F.slice("_all", 2, F.size("_all")), F.element_at("_all", 1), lambda b, x: F.when(comparison(b, x) > 0, x).otherwise(b))
    return grouped.select(*by, best.alias("_b")).select(*[c if c in by else f"_b.{c}" for c in rows.columns])


def best_orfs(rows: DataFrame) -> DataFrame:
    """One candidate per sequence, from those of each frame that are left by ``without_close_starts``. ``rows`` has
    ``markov``."""
    return reduced(reduced(rows, "seq_id", "frame"), "seq_id")


def profile(text: str) -> np.ndarray:
    """Counts of the words of five known letters, but for a last one that ends the text."""
    code = str.maketrans("ACGT", "0123")
    out = np.zeros(4**WORD, np.int32)
    upper = text.upper()
    for i in range(len(upper) - WORD):
        word = upper[i : i + WORD].translate(code)
        if word.isdigit() and word.isascii():
            out[int(word, 4)] += 1
    return out


def like_another(counts: np.ndarray, others: np.ndarray) -> bool:
    """Whether a profile is the same as one of others: of its words, 99 percent of those that are missing there or occur
    there about as often do the latter, and those missing are less than half of its places."""
    own = counts > 0
    theirs = others[:, own]
    missing = (theirs == 0).sum(1)
    with np.errstate(divide="ignore"):
        same = (np.abs(np.log(counts[own]) - np.log(theirs)) < SAME_COUNT).sum(1)
    share = 100.0 * same / np.maximum(same + missing, 1)
    return bool(((missing < counts.sum() // 2) & (same > 0) & (share >= SAME_PERCENT)).any())


def training_set(orfs: DataFrame, most: int = 2000, most_bases: int = 10**6, round_rows: int = 2000) -> DataFrame:
    """The longest ORFs (seq_id, orf) whose profile of words of five is not like that of one taken before, until there are
    ``most`` of them and ``most_bases`` letters. Those with a great hit (``great_hit``, if the rows have it) come first;
    equal lengths go by id; a null text takes no part.

    Which are taken depends on those before, so they are read in order, ``round_rows`` at a time, and no more of them than
    the bounds ask for; profiles of a round are counted in tasks."""
    spark = orfs.sparkSession
    great = F.coalesce(F.col("great_hit"), F.lit(False)) if "great_hit" in orfs.columns else F.lit(False)
    key = F.struct((~great).alias("g"), (-F.length("orf")).alias("l"), "seq_id")
    rows = orfs.where("orf IS NOT NULL").select("seq_id", "orf", key.alias("key"))

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"seq_id": batch["seq_id"], "profile": [profile(t).tolist() for t in batch["orf"]]})

    taken, bases, held, after = [], 0, np.zeros((256, 4**WORD), np.int32), None
    while True:
        rest = rows if after is None else rows.where(F.col("key") > F.struct(F.lit(after["g"]), F.lit(after["l"]), F.lit(after["seq_id"]).cast("long")))
        part = rest.orderBy("key").limit(round_rows)
        keys = [r.key for r in part.select("key").collect()]
        profiles = {r.seq_id: r.profile for r in part.select("seq_id", "orf").mapInPandas(counted, "seq_id long, profile array<int>").collect()}
        for after in keys:
            counts = np.array(profiles[after["seq_id"]], np.int32)
            if taken and like_another(counts, held[: len(taken)]):
                continue
            if len(taken) == len(held):
                held = np.concatenate([held, np.zeros_like(held)])
            held[len(taken)] = counts
            taken.append(after["seq_id"])
            bases -= after["l"]
            if bases >= most_bases and len(taken) >= most:
                break
        else:
            if len(keys) == round_rows:
                continue
        break
    ids = spark.createDataFrame([(i,) for i in taken], "seq_id long")
    return orfs.join(F.broadcast(ids), "seq_id", "left_semi")  # as many ids as the bounds allow
