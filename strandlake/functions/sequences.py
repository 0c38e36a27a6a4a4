"""Nucleotide and protein strings as column expressions."""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column
from pyspark.sql import functions as F

BASES = "TCAG"
#: Fixed value: the standard genetic code, amino acids of codons in the order of BASES at each position.
CODE = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {"".join(c): a for c, a in zip(product(BASES, repeat=3), CODE, strict=True)}


def reverse_complement(seq: Column) -> Column:
    """Letters other than ACGT stay as they are."""
    return F.translate(F.reverse(seq), "acgtACGT", "tgcaTGCA")


def codons(seq: Column, frame: Column | int = 1) -> Column:
    """The whole codons of frame 1 to 3, or -1 to -3 on the other strand, in capitals."""
    frame = F.lit(frame) if isinstance(frame, int) else frame
    strand = F.upper(F.when(frame < 0, reverse_complement(seq)).otherwise(seq))
    rest = F.substring(strand, F.abs(frame), F.length(strand))
    n = F.floor(F.length(rest) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(rest, i * 3 + 1, F.lit(3)))).otherwise(F.array().cast("array<string>"))


def amino_acid(codon: Column) -> Column:
    """X for codons that are not of ACGT."""
    table = F.create_map(*[F.lit(x) for pair in CODONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.upper(codon)), F.lit("X"))


def translate(seq: Column, frame: Column | int = 1) -> Column:
    return F.array_join(F.transform(codons(seq, frame), amino_acid), "")


def letters(seq: Column, kinds: str) -> Column:
    return F.length(F.regexp_replace(F.upper(seq), f"[^{kinds}]", ""))


def gc_ratio(seq: Column) -> Column:
    """G and C among A, C, G and T; 0 where there are none."""
    known = letters(seq, "ACGT")
    return F.when(known > 0, letters(seq, "GC") / known).otherwise(0.0)


def n_count(seq: Column) -> Column:
    return letters(seq, "N")


def cpg(seq: Column) -> Column:
    return F.regexp_count(F.upper(seq), F.lit("CG"))


def cpg_observed_expected(seq: Column) -> Column:
    """(#CpG / (#C * #G)) * length; 0 without C or G."""
    c, g = letters(seq, "C"), letters(seq, "G")
    return F.when((c > 0) & (g > 0), cpg(seq) / (c * g) * F.length(seq)).otherwise(0.0)


def cpg_percent(seq: Column) -> Column:
    return F.when(F.length(seq) > 0, 2 * cpg(seq) / F.length(seq) * 100).otherwise(0.0)


def codon_position_gc(cds: Column, position: int) -> Column:
    """GC ratio of the first, second or third letters of the codons."""
    picked = F.array_join(F.transform(codons(cds), lambda c: F.substring(c, position, 1)), "")
    return gc_ratio(picked)


def region(seq: Column, start: Column, end: Column) -> Column:
    """Letters start to end, both included, from 1; empty where they cross."""
    return F.when(end >= start, F.substring(seq, start, end - start + 1)).otherwise("")


def gap_map(aligned: Column) -> Column:
    """Gaps of an aligned sequence as an array of (start, len); start counts letters of the ungapped text before the gap
    as well as gaps before it."""
    runs = F.regexp_extract_all(aligned, F.lit("[^-]+|-+"), F.lit(0))
    step = lambda acc, run: F.struct(
        (acc["at"] + F.length(run)).alias("at"),
        F.when(run.startswith("-"), F.concat(acc["gaps"], F.array(F.struct(acc["at"].alias("start"), F.length(run).alias("len"))))).otherwise(acc["gaps"]).alias("gaps"),
    )
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,len:int>>").alias("gaps"))
    return F.aggregate(runs, none, step, lambda acc: acc["gaps"])


def gap_text(gaps: Column) -> Column:
    """``start-len:start-len``, or ``0`` without gaps."""
    joined = F.array_join(F.transform(gaps, lambda g: F.concat(g["start"].cast("string"), F.lit("-"), g["len"].cast("string"))), ":")
    return F.when(F.size(gaps) > 0, joined).otherwise("0")


def parse_gap_text(text: Column) -> Column:
    parts = F.transform(F.split(text, ":"), lambda x: F.struct(F.substring_index(x, "-", 1).cast("int").alias("start"), F.substring_index(x, "-", -1).cast("int").alias("len")))
    return F.when(text == "0", F.array().cast("array<struct<start:int,len:int>>")).otherwise(parts)


def with_gaps(seq: Column, gaps: Column) -> Column:
    """The sequence with its gaps put in, each at its place in the gapped text; gaps are in order."""
    return F.aggregate(gaps, seq, lambda text, g: F.concat(F.substring(text, F.lit(1), g["start"]), F.repeat(F.lit("-"), g["len"]), F.substring(text, g["start"] + 1, F.length(text))))
