"""Filters of the tables, as data: what a user fills in becomes predicates, and what is left empty none.

A specification is plain and serialisable; ``column`` gives its predicate, or None, and Catalyst does the rest.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.functions.logic import any_of, combine, direction, in_range, like
from strandlake.functions.numbers import fold_filter

Range = tuple[float | None, float | None]


def _ranges(ranges: dict[str, Range]) -> list[Column]:
    return [c for name, (low, high) in ranges.items() if (c := in_range(F.col(name), low, high)) is not None]


def _present(name: str, wanted: bool | None) -> Column | None:
    filled = F.col(name).isNotNull() & (F.col(name) != "")
    return None if wanted is None else filled if wanted else ~F.coalesce(filled, F.lit(False))


@dataclass
class TextSearch:
    """Names, remarks, descriptions: a part of the text, with ``%`` as a wildcard, or a list of whole values."""

    name: str
    text: str | None = None
    values: Sequence[str] = ()
    negate: bool = False

    def column(self) -> Column | None:
        found = like(F.col(self.name), self.text) if self.text else F.lower(self.name).isin([v.lower() for v in self.values]) if self.values else None
        return found if found is None or not self.negate else ~F.coalesce(found, F.lit(False))


@dataclass
class Directed:
    """abs(value) below a cutoff with a sign, over several columns joined by ``how`` (p-values of contrasts)."""

    names: Sequence[str] = ()
    cutoff: float = 0.05
    way: str = "either"
    how: str = "any"

    def column(self) -> Column | None:
        return any_of([direction(F.col(n), self.cutoff, self.way) for n in self.names], self.how) if self.names else None


@dataclass
class Fold:
    """Fold change of at least ``least`` over pairs of columns."""

    pairs: Sequence[tuple[str, str]] = ()
    least: float = 2.0
    log: bool = False
    way: str = "either"
    how: str = "any"

    def column(self) -> Column | None:
        return any_of([fold_filter(F.col(a), F.col(b), self.least, self.log, self.way) for a, b in self.pairs], self.how) if self.pairs else None


@dataclass
class Levels:
    """Wide columns of libraries: (all or any) of the included at least a value, (all or any) of the excluded at most."""

    include: Sequence[str] = ()
    least: float = 1
    include_how: str = "any"
    exclude: Sequence[str] = ()
    most: float = 0
    exclude_how: str = "all"

    def column(self) -> Column | None:
        return combine([
            any_of([F.col(n) >= self.least for n in self.include], self.include_how) if self.include else None,
            any_of([F.col(n) <= self.most for n in self.exclude], self.exclude_how) if self.exclude else None,
        ])


@dataclass
class SequenceFilter:
    """Sequences by ranges (half open), texts, presence of remark or location, Ns, ORF, library levels, fold, p-values."""

    ranges: dict[str, Range] = field(default_factory=dict)
    texts: Sequence[TextSearch] = ()
    present: dict[str, bool | None] = field(default_factory=dict)
    has_n: bool | None = None
    orf_frame: int | None = None
    full_orf: bool = False
    hit_frame: bool = False
    datasets: Sequence[str] = ()
    levels: Levels | None = None
    fold: Fold | None = None
    de: Directed | None = None

    def column(self) -> Column | None:
        return combine([
            *_ranges(self.ranges), *[t.column() for t in self.texts], *[_present(k, v) for k, v in self.present.items()],
            None if self.has_n is None else (F.col("n_count") > 0 if self.has_n else F.col("n_count") == 0),
            None if self.orf_frame is None else F.col("frame") == self.orf_frame,
            F.col("has_start") & F.col("has_stop") if self.full_orf else None,
            F.col("frame") == F.col("hit_frame") if self.hit_frame else None,
            F.col("dataset").isin(list(self.datasets)) if self.datasets else None,
            *[x.column() for x in (self.levels, self.fold, self.de) if x],
        ])


@dataclass
class HitFilter:
    """Hits by thresholds, best flags, database types, annotations and species, and by their sequences' levels (a column for
    each library) and p-values."""

    evalue: float | None = None
    least: dict[str, float] = field(default_factory=dict)
    best: Sequence[str] = ()
    databases: Sequence[tuple[str, str]] = ()
    annotated: dict[str, str] = field(default_factory=dict)
    species: Sequence[str] = ()
    not_species: Sequence[str] = ()
    texts: Sequence[TextSearch] = ()
    de: Directed | None = None
    levels: Levels | None = None

    def column(self) -> Column | None:
        name = F.lower("species")
        return combine([
            None if self.evalue is None else F.col("evalue") <= self.evalue,
            *[F.col(k) >= v for k, v in self.least.items()],
            any_of([F.col(b) for b in self.best], "any") if self.best else None,
            combine([(F.col("dbtype") == t) & (F.col("taxonomy") == x) for t, x in self.databases], "or"),
            *[like(F.col(k), v) if v else _present(k, True) for k, v in self.annotated.items()],
            name.isin([s.lower() for s in self.species]) if self.species else None,
            ~name.isin([s.lower() for s in self.not_species]) if self.not_species else None,
            *[t.column() for t in self.texts], *[x.column() for x in (self.de, self.levels) if x],
        ])


@dataclass
class MergedSequenceFilter:
    """Sequences of merged datasets: texts, whether they have pairs, a hit, terms, their dataset, whether they are in
    clusters of methods (a column of each holds the cluster or null; True in, False not in), and half-open ranges of
    libraries' levels. Methods and levels are each joined by their own ``how``."""

    texts: Sequence[TextSearch] = ()
    paired: bool | None = None
    annotated: bool | None = None
    has_terms: bool | None = None
    dataset: str | int | None = None
    methods: dict[str, bool] = field(default_factory=dict)
    methods_how: str = "and"
    levels: dict[str, Range] = field(default_factory=dict)
    levels_how: str = "and"

    def column(self) -> Column | None:
        some = lambda name, wanted: None if wanted is None else (F.coalesce(name, F.lit(0)) > 0) == F.lit(wanted)
        return combine([
            *[t.column() for t in self.texts], some("n_pairs", self.paired), None if self.annotated is None else F.col("hit_id").isNotNull() == F.lit(self.annotated), some("n_terms", self.has_terms),
            None if self.dataset is None else F.col("dataset") == self.dataset,
            combine([F.col(m).isNotNull() == F.lit(inside) for m, inside in self.methods.items()], self.methods_how), combine(_ranges(self.levels), self.levels_how),
        ])


@dataclass
class SinglePairFilter:
    """Pairs of one dataset: a part of either name, a part of the search's kind, and least overlaps: for a prefix (nt, aa) the
    length, and the percents of length and similarity, the score over the length. All parts hold together."""

    name: str | None = None
    kind: str | None = None
    overlaps: dict[str, tuple[float, float, float]] = field(default_factory=dict)

    def column(self) -> Column | None:
        def enough(prefix: str, least: tuple[float, float, float]) -> Column:
            size, ratio, score = (F.col(f"{prefix}_{c}") for c in ("len", "ratio", "score"))
            return (size >= least[0]) & (ratio >= least[1] / 100) & (size > 0) & (score >= least[2] / 100 * size)

        either = combine([like(F.col(c), self.name) for c in ("seq1", "seq2")], "or") if self.name else None
        return combine([either, like(F.col("kind"), self.kind) if self.kind else None, *[enough(p, x) for p, x in self.overlaps.items()]])


@dataclass
class TermFilter:
    """GO terms. A search by id or name stands alone; otherwise thresholds, evidence, domain, level, slim and enrichment."""

    gonum: int | None = None
    name: str | None = None
    evalue: float | None = None
    least_seqs: int | None = None
    evidence: Sequence[str] = ()
    domain: str | None = None
    level: Range = (None, None)
    slim: bool = False
    enriched: Directed | None = None

    def column(self) -> Column | None:
        if self.gonum is not None:
            return F.col("gonum") == self.gonum
        if self.name:
            return like(F.col("name"), self.name)
        low, high = self.level
        return combine([
            None if self.evalue is None else F.col("best_evalue") <= self.evalue,
            None if self.least_seqs is None else F.col("n_seqs") >= self.least_seqs,
            any_of([F.col(c) != "" for c in self.evidence], "any") if self.evidence else None,
            None if self.domain is None else F.col("domain") == self.domain,
            None if low is None else F.col("level") >= low, None if high is None else F.col("level") <= high,
            F.col("is_slim") if self.slim else None, self.enriched.column() if self.enriched else None,
        ])


@dataclass
class PairFilter:
    """Pairs by ranges, Ka/Ks, dataset and cluster methods; all parts hold together."""

    ranges: dict[str, Range] = field(default_factory=dict)
    texts: Sequence[TextSearch] = ()
    kaks: Range | str = (None, None)
    same_dataset: bool | None = None
    datasets: tuple[int, int] | None = None
    methods: Sequence[str] = ()
    without_methods: Sequence[str] = ()
    has: Sequence[str] = ()

    def column(self) -> Column | None:
        has = lambda m: F.array_contains(F.split("methods", ","), m)
        both = None
        if self.datasets:
            a, b = self.datasets
            both = ((F.col("ds1") == a) & (F.col("ds2") == b)) | ((F.col("ds1") == b) & (F.col("ds2") == a))
        return combine([
            *_ranges(self.ranges), combine([t.column() for t in self.texts], "or"),
            F.col("kaks_na") if self.kaks == "NA" else in_range(F.col("kaks"), *self.kaks),
            None if self.same_dataset is None else (F.col("ds1") == F.col("ds2") if self.same_dataset else F.col("ds1") != F.col("ds2")),
            both, *[has(m) for m in self.methods], *[~has(m) for m in self.without_methods], *[F.col(c).isNotNull() for c in self.has],
        ])


@dataclass
class ClusterFilter:
    """Clusters by texts, ranges, class of taxa, method, and counts per dataset."""

    ranges: dict[str, Range] = field(default_factory=dict)
    texts: Sequence[TextSearch] = ()
    taxa: str | None = None
    method: str | None = None
    datasets: Levels | None = None

    def column(self) -> Column | None:
        return combine([
            *_ranges(self.ranges), *[t.column() for t in self.texts],
            None if self.taxa is None else F.col("taxa") == self.taxa, None if self.method is None else F.col("method") == self.method,
            self.datasets.column() if self.datasets else None,
        ])


@dataclass
class BestHitFilter:
    """Sequences by their best hit: ``which`` is bits, anno or go, the prefix of its columns (``bits_evalue`` and so on).

    Limits are (column, <= or >=, value), joined by ``how``; a taxonomy and a type are one limit together. Without limits
    on e-value, similarity or coverage, the best hit with terms has to be there. All but the sequences without a hit need
    one; ``databases`` limits the number of databases; ``differ`` asks for best hits that are not the same: ``bits_anno``, or
    ``go_both`` for one with terms that is neither of the two. ``annotated`` False asks for sequences without a hit, whatever
    else is set; None for all."""

    which: str = "bits"
    limits: Sequence[tuple[str, str, float]] = ()
    taxonomy: str | None = None
    dbtype: str | None = None
    how: str = "and"
    databases: tuple[str, int] | None = None
    differ: str | None = None
    annotated: bool | None = True

    def column(self) -> Column | None:
        if not self.annotated:
            return None if self.annotated is None else F.col("bits_hit_id").isNull()
        of = lambda c: F.col(f"{self.which}_{c}")
        limit = lambda c, op, v: c <= v if op == "<=" else c >= v
        kind = combine([None if v is None else of(c) == v for c, v in (("taxonomy", self.taxonomy), ("dbtype", self.dbtype))])
        bare = self.which == "go" and not {c for c, *_ in self.limits} & {"evalue", "sim", "hit_cov", "seq_cov"}
        parts = [of("hit_id").isNotNull() if bare else None, *[limit(of(c), op, v) for c, op, v in self.limits], kind]
        bits, anno, go = (F.col(f"{c}_hit_id") for c in ("bits", "anno", "go"))
        differ = {None: None, "bits_anno": bits != anno, "go_both": go.isNotNull() & (go != bits) & (go != anno)}[self.differ]
        n = None if self.databases is None else limit(F.col("n_databases"), *self.databases)
        return combine([bits.isNotNull(), combine(parts, self.how), n, differ])


def apply(df: DataFrame, spec) -> DataFrame:
    condition = spec.column() if spec is not None else None
    return df if condition is None else df.where(condition)
