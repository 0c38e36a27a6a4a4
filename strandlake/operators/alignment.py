"""Pairwise alignment and coding scores of pairs.

Alignment is dynamic programming, which DataFrame functions cannot express: pairs are dealt out by their cost and each
is aligned by a small numpy routine in an Arrow batch. What follows from an alignment is column expressions.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions import sequences as Q
from strandlake.functions.numbers import ratio, shared_ratio

#: Gap costs, and scores of equal and unequal nucleotides.
GAP_OPEN, GAP_EXTEND, NT_MATCH, NT_MISMATCH = 7.0, 0.7, 1.8, -1.0
#: Fixed value: what a stop against a letter costs in an overlap.
STOP_COST = 4
#: Cells that are held at once. Of larger pairs the rows between blocks are kept, and a block is worked out again for the
#: way back.
BLOCK_CELLS = 1 << 21

Matrix = tuple[str, np.ndarray]


def parse_matrix(lines: Iterable[str]) -> Matrix:
    """Letters and scores of a substitution matrix in the usual text form: a line of letters, then a line for each."""
    rows = [x.split() for x in lines if x.strip() and not x.startswith("#")]
    return "".join(rows[0]), np.array([[float(x) for x in r[-len(rows[0]) :]] for r in rows[1:]])


def substitution(a: str, b: str, matrix: Matrix | None = None) -> np.ndarray:
    """Scores of every letter of a against every letter of b: by a matrix, whose last letter stands for unknown ones, or
    by equality."""
    if matrix is None:
        x, y = (np.frombuffer(s.upper().encode("latin-1", "replace"), np.uint8) for s in (a, b))
        return np.where(x[:, None] == y, NT_MATCH, NT_MISMATCH)
    letters, table = matrix
    x, y = (np.array([letters.find(c) for c in s.upper()], int) for s in (a, b))
    return table[np.ix_(x, y)]


def align(a: str, b: str, matrix: Matrix | None = None, open_: float = GAP_OPEN, extend: float = GAP_EXTEND) -> tuple[float, str, str]:
    """Semi-global alignment with affine gaps; gaps at the ends are free. Of equal scores a gap in b is taken before a
    match, and a match before a gap in a. A gap of n letters costs open + n * extend. Memory grows with the length of b
    times the root of that of a."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0, a + "-" * m, "-" * n + b
    low, start = -1e18, open_ + extend  # start: what the first letter of a gap costs
    size = max(isqrt(n) + 1, BLOCK_CELLS // (m + 1))  # rows of a block
    first = [(np.zeros(m + 1), np.full(m + 1, low))]  # best and up of the row before each block
    ends = np.zeros(n + 1)  # best of the last column

    def block(k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """best, up and left of the row before the block and of its rows, and the scores of its rows."""
        rows = min(size, n - k * size)
        score = substitution(a[k * size : k * size + rows], b, matrix)
        best, up, left = np.zeros((rows + 1, m + 1)), np.full((rows + 1, m + 1), low), np.full((rows + 1, m + 1), low)
        best[0], up[0] = first[k]
        for i in range(1, rows + 1):
            up[i] = np.maximum(best[i - 1] - start, up[i - 1] - extend)
            row = np.maximum(up[i, 1:], best[i - 1, :-1] + score[i - 1])
            now, gap, r, edge = best[i], left[i], row.tolist(), 0.0
            g = low
            for j in range(m):  # a gap in a depends on the cell before it
                g = max(edge - start, g - extend)
                edge = r[j] if r[j] >= g else g
                gap[j + 1], now[j + 1] = g, edge
        return best, up, left, score

    for k in range(-(-n // size)):
        best, up, left, score = block(k)
        ends[k * size + 1 : k * size + len(best)] = best[1:, m]
        first.append((best[-1].copy(), up[-1].copy()))
    last = best[-1]
    i, j = (int(ends.argmax()), m) if ends.max() >= last.max() else (n, int(last.argmax()))
    total = float(ends[i] if j == m else last[j])
    out_a, out_b = [a[i:][::-1] + "-" * (m - j)], ["-" * (n - i) + b[j:][::-1]]  # from the end; one of the two tails is empty
    state = "best"
    while i and j:
        if (i - 1) // size != k:
            k = (i - 1) // size
            best, up, left, score = block(k)
        x = i - k * size  # the row in the block
        if state == "best":
            if best[x, j] == up[x, j]:
                state = "up"
            elif best[x, j] == best[x - 1, j - 1] + score[x - 1, j - 1]:
                i, j = i - 1, j - 1
                out_a.append(a[i])
                out_b.append(b[j])
            else:
                state = "left"
        elif state == "up":
            state = "up" if up[x, j] != best[x - 1, j] - start else "best"
            i -= 1
            out_a.append(a[i])
            out_b.append("-")
        else:
            state = "left" if left[x, j] != best[x, j - 1] - start else "best"
            j -= 1
            out_a.append("-")
            out_b.append(b[j])
    return total, a[:i] + "-" * j + "".join(out_a)[::-1], "-" * i + b[:j] + "".join(out_b)[::-1]


def align_linear(a: str, b: str, matrix: Matrix | None = None, gap: float = GAP_OPEN) -> tuple[float, str, str]:
    """Semi-global alignment in which each letter of a gap costs the same; gaps at the ends are free. Of equal scores a gap
    in b is taken before a match, and a match before a gap in a. Cells of an anti-diagonal are worked out together; what is
    kept of all cells is a byte each."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0, a + "-" * m, "-" * n + b
    if matrix is None:
        x, y = (np.frombuffer(s.upper().encode("latin-1", "replace"), np.uint8) for s in (a, b))
        score = lambda i, j: np.where(x[i - 1] == y[j - 1], NT_MATCH, NT_MISMATCH)
    else:
        x, y = (np.array([matrix[0].find(c) for c in s.upper()], int) for s in (a, b))
        score = lambda i, j: matrix[1][x[i - 1], y[j - 1]]
    before, last, way = np.zeros(n + 1), np.zeros(n + 1), np.zeros((n + 1, m + 1), np.int8)  # by row: two anti-diagonals
    for d in range(2, n + m + 1):
        i = np.arange(max(1, d - m), min(n, d - 1) + 1)
        j = d - i
        up = last[i - 1] - np.where(j == m, 0.0, gap)
        match = before[i - 1] + score(i, j)
        left = last[i] - np.where(i == n, 0.0, gap)
        best = np.where(match > up, match, up)
        way[i, j] = np.where(left > best, 2, np.where(match > up, 1, 0))
        now = np.zeros(n + 1)
        now[i] = np.where(left > best, left, best)
        before, last = last, now
    i, j, out_a, out_b = n, m, [], []
    while i or j:
        step = 2 if not i else 0 if not j else way[i, j]
        i, j = i - (step < 2), j - (step > 0)
        out_a.append(a[i] if step < 2 else "-")
        out_b.append(b[j] if step > 0 else "-")
    return float(last[n]), "".join(reversed(out_a)), "".join(reversed(out_b))


def align_pairs(pairs: DataFrame, matrix: Matrix | None = None, parts: int | None = None, columns: tuple = ("text1", "text2"), affine: bool = True) -> DataFrame:
    """Adds score, aligned1 and aligned2 to rows of pairs; null texts have nulls there. Gaps cost open + n * extend, or where
    not ``affine``, open for each letter. Rows are dealt out at random by key, since their cost has nothing to do with where
    they come from."""
    one, two = columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields), "score double", "aligned1 string", "aligned2 string"])
    rows = pairs.repartition(parts, F.xxhash64(one, two)) if parts else pairs.repartition(F.xxhash64(one, two))

    work = align if affine else align_linear

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [work(a, b, matrix) if a is not None and b is not None else (None, None, None) for a, b in zip(batch[one], batch[two], strict=True)]
            yield batch.assign(score=[x[0] for x in found], aligned1=[x[1] for x in found], aligned2=[x[2] for x in found])

    return rows.mapInPandas(run, schema)


def columns_of(a: Column, b: Column) -> Column:
    """The columns of an alignment as an array of (x, y)."""
    chars = lambda s: F.filter(F.split(F.upper(s), ""), lambda c: c != "")
    return F.zip_with(chars(a), chars(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))


def trimmed(a: Column, b: Column) -> tuple[Column, Column]:
    """Both aligned texts without the columns before the first and after the last that have a letter in each."""
    head = F.greatest(F.length(F.regexp_extract(a, "^-*", 0)), F.length(F.regexp_extract(b, "^-*", 0)))
    tail = F.greatest(F.length(F.regexp_extract(a, "-*$", 0)), F.length(F.regexp_extract(b, "-*$", 0)))
    cut = lambda s: F.substring(s, head + 1, F.greatest(F.length(s) - head - tail, F.lit(0)))
    return cut(a), cut(b)


def overlap_scores(aligned: DataFrame) -> DataFrame:
    """Adds start, end (of the overlap, from 1), matches, mismatches and gaps inside it."""
    a, b = trimmed(F.col("aligned1"), F.col("aligned2"))
    head = F.greatest(F.length(F.regexp_extract("aligned1", "^-*", 0)), F.length(F.regexp_extract("aligned2", "^-*", 0)))
    count = lambda f: F.size(F.filter("_c", f))
    rows = aligned.withColumn("_c", columns_of(a, b)).withColumn("start", head + 1)
    gap = lambda c: (c["x"] == "-") | (c["y"] == "-")
    return rows.withColumns({
        "end": F.col("start") + F.size("_c") - 1, "matches": count(lambda c: (c["x"] == c["y"]) & ~gap(c)),
        "mismatches": count(lambda c: (c["x"] != c["y"]) & ~gap(c)), "gaps": count(gap),
    }).drop("_c")


def overlap_sums(aligned: DataFrame, matrix: Matrix | None = None, open_: float = GAP_OPEN, extend: float = GAP_EXTEND, affine: bool = True) -> DataFrame:
    """Adds, from the first to the last column with a letter in each, overlap_len, positives (columns of a score above 0),
    overlap_gaps (columns), stops (columns with ``*`` in either) and overlap_score.

    The whole parts of scores and costs are summed: of a run of gaps, whichever side they are on, the first column costs
    ``open_`` and the others ``extend`` (``open_`` if not ``affine``); a stop against a letter costs STOP_COST. A matrix is
    read as in ``substitution``. Without any such column all are 0; a null side gives nulls."""
    gap = lambda c: (c["x"] == "-") | (c["y"] == "-")
    stop = lambda c: (c["x"] == "*") | (c["y"] == "*")
    if matrix is None:
        value = lambda c: F.when(c["x"] == c["y"], int(NT_MATCH)).otherwise(int(NT_MISMATCH))
    else:
        letters, table = matrix
        cells = F.lit([int(v) for v in np.asarray(table).ravel()])
        at = lambda x: F.coalesce(F.nullif(F.instr(F.lit(letters), x), F.lit(0)), F.lit(len(letters)))
        value = lambda c: F.element_at(cells, (at(c["x"]) - 1) * len(letters) + at(c["y"]))
    state = lambda total, opened: F.struct(total.alias("total"), opened.alias("opened"))

    def add(now: Column, c: Column) -> Column:
        cost = F.when(now["opened"], int(extend if affine else open_)).otherwise(int(open_))
        own = F.when(gap(c), -cost).when(stop(c), -STOP_COST).otherwise(value(c))
        return state(now["total"] + own, gap(c))

    count = lambda f: F.size(F.filter("_c", f))
    both = aligned.withColumn("_c", columns_of(F.col("aligned1"), F.col("aligned2")))
    both = both.withColumn("_b", F.transform("_c", lambda c: ~gap(c)))
    first = F.array_position("_b", True)
    length = F.size("_c") - F.array_position(F.reverse("_b"), True) + 2 - first
    cut = both.withColumn("_c", F.when(first == 0, F.slice("_c", 1, 0)).otherwise(F.slice("_c", F.greatest(first, F.lit(1)).cast("int"), F.greatest(length, F.lit(0)).cast("int"))))
    known = lambda c: F.when(F.col("_c").isNotNull(), c)
    return cut.withColumns({
        "overlap_len": known(F.size("_c")), "positives": known(count(lambda c: ~gap(c) & ~stop(c) & (value(c) > 0))),
        "overlap_gaps": known(count(gap)), "stops": known(count(stop)),
        "overlap_score": F.aggregate("_c", state(F.lit(0), F.lit(False)), add, lambda now: now["total"]),
    }).drop("_c", "_b")


def fitted_cds(aligned: Column, cds: Column) -> Column:
    """A coding sequence laid under its aligned protein: three letters for each, ``---`` for a gap."""
    chars = F.filter(F.split(aligned, ""), lambda c: c != "")
    before = lambda i: F.length(F.regexp_replace(F.substring(aligned, F.lit(1), i), "-", ""))
    return F.array_join(F.transform(chars, lambda c, i: F.when(c == "-", "---").otherwise(F.substring(cds, before(i) * 3 + 1, F.lit(3)))), "")


#: Transitions.
TRANSITIONS = ("AG", "GA", "CT", "TC")


def fold_class(codon: Column) -> Column:
    """4 or 2, the degeneracy that the first two letters of a codon give: 4 for two of G and C, 2 for two of A and T, else 4
    for a second C or T and 2 for a second A or G; null for other letters there."""
    one, two = F.substring(codon, 1, 1), F.substring(codon, 2, 1)
    return F.when(one.isin("C", "G") & two.isin("C", "G"), 4).when(one.isin("A", "T") & two.isin("A", "T"), 2).when(two.isin("C", "T"), 4).when(two.isin("A", "G"), 2)


def cds_scores(pairs: DataFrame, one: str = "cds1", two: str = "cds2", matrix: Matrix | None = None) -> DataFrame:
    """Scores of aligned coding sequences of equal length.

    By letters: len, gaps (columns with a gap), opens (gaps that do not follow one), snps, gc_both and gc_either,
    cpg_both and cpg_either, and these two within codons (cpg_codon_both, cpg_codon_either). By codons without a gap: codons,
    exact, synonymous, nonsynonymous; of synonymous ones fourfold, twofold and otherfold (the two codons' classes differ);
    aa_exact, aa_positive (a positive score in ``matrix``; none without one), aa_negative. ts1 to ts3 and tv1 to tv3 by
    place in the codon, transitions and transversions in all whole codons. Ratios: tstv, gc_ratio and cpg_ratio (shared of
    either). A null sequence has nulls."""
    a, b = F.upper(one), F.upper(two)
    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.length(s) / 3).cast("int") - 1), lambda i: F.substring(s, i * 3 + 1, F.lit(3)))
    none = F.array().cast("array<struct<x:string,y:string>>")
    rows = pairs.withColumn("_k", F.when(F.length(a) >= 3, F.zip_with(cut(a), cut(b), lambda x, y: F.struct(x.alias("x"), y.alias("y")))).otherwise(none))
    gap = lambda c: c["x"].contains("-") | c["y"].contains("-")
    rows = rows.withColumn("_f", F.transform(F.filter("_k", lambda c: ~gap(c)), lambda c: F.struct(c["x"].alias("x"), c["y"].alias("y"), Q.amino_acid(c["x"]).alias("p"), Q.amino_acid(c["y"]).alias("q"))))
    rows = rows.withColumn("_c", columns_of(a, b))
    same, equal = lambda c: c["p"] == c["q"], lambda c: c["x"] == c["y"]
    silent = lambda c: same(c) & ~equal(c)
    fold = lambda c, k: silent(c) & (fold_class(c["x"]) == k) & (fold_class(c["y"]) == k)
    related = [x + y for i, x in enumerate(matrix[0]) for j, y in enumerate(matrix[0]) if i != j and matrix[1][i, j] > 0] if matrix else []
    alike = (lambda c: ~same(c) & F.concat(c["p"], c["q"]).isin(*related)) if related else (lambda c: F.lit(False))
    n = lambda f, of="_f": F.size(F.filter(of, f))
    differs = lambda c: ~gap(c) & (c["x"] != c["y"])
    ts = lambda c: differs(c) & F.concat(c["x"], c["y"]).isin(*TRANSITIONS)
    tv = lambda c: differs(c) & ~F.concat(c["x"], c["y"]).isin(*TRANSITIONS)
    in_codons = F.slice("_c", 1, F.size("_k") * 3)
    at_place = lambda j: F.filter(in_codons, lambda c, i: i % 3 == j)
    gc = lambda x: x.isin("G", "C")
    at = lambda s: F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - 1, F.lit(1))), lambda i: F.when(F.substring(s, i, F.lit(2)) == "CG", i)), lambda i: i.isNotNull())
    rows = rows.withColumns({"_p": at(a), "_q": at(b)})
    inner = lambda c: F.filter(c, lambda i: (i % 3 != 0) & (i <= F.size("_k") * 3))
    rows = rows.withColumns({
        "len": F.length(a), "gaps": n(gap, "_c"), "opens": F.size(F.filter(F.transform("_c", lambda c, i: gap(c) & ~F.coalesce(gap(F.get("_c", i - 1)), F.lit(False))), lambda x: x)), "snps": n(differs, "_c"),
        "gc_both": n(lambda c: gc(c["x"]) & gc(c["y"]), "_c"), "gc_either": n(lambda c: gc(c["x"]) | gc(c["y"]), "_c"),
        "cpg_both": F.size(F.array_intersect("_p", "_q")), "cpg_either": F.size(F.array_union("_p", "_q")),
        "cpg_codon_both": F.size(F.array_intersect(inner("_p"), inner("_q"))), "cpg_codon_either": F.size(F.array_union(inner("_p"), inner("_q"))),
        "codons": F.size("_f"), "exact": n(equal), "synonymous": n(silent), "nonsynonymous": n(lambda c: ~same(c)),
        "fourfold": n(lambda c: fold(c, 4)), "twofold": n(lambda c: fold(c, 2)), "aa_exact": n(same), "aa_positive": n(alike),
        **{f"{k}{j + 1}": F.size(F.filter(at_place(j), f)) for k, f in (("ts", ts), ("tv", tv)) for j in range(3)},
    })
    total = lambda k: F.col(f"{k}1") + F.col(f"{k}2") + F.col(f"{k}3")
    rows = rows.withColumns({
        "otherfold": F.col("synonymous") - F.col("fourfold") - F.col("twofold"), "aa_negative": F.col("codons") - F.col("aa_exact") - F.col("aa_positive"), "transitions": total("ts"), "transversions": total("tv"),
        "gc_ratio": shared_ratio(F.col("gc_both"), F.col("gc_either")), "cpg_ratio": shared_ratio(F.col("cpg_both"), F.col("cpg_either")),
    })
    tstv = F.when((F.col("transitions") == 0) | (F.col("transversions") == 0), 0.0).otherwise(ratio(F.col("transitions").cast("double"), F.col("transversions")))
    return rows.withColumn("tstv", tstv).drop("_k", "_f", "_c", "_p", "_q")
