"""Toxicity by a weighted grammar of clauses.

Terms come from a seed list and from the labels: words and word beginnings whose documents are labelled toxic far more
often than chance allows. A text is searched for all terms at once; each clause with a hit is read by one machine, the
composition of weighted transducers for insults, threats, negation, targets and reported speech. Its heaviest path says
what each term is in its clause and what it weighs there. The weights of the clause kinds are fitted to the labels, and
a text's score is made of the path weights of its clauses.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, written

#: At most about so many labelled rows are read for fitting: those with the smallest hashes of their ids.
MAX_LABELLED = 20_000
#: At most so many learned terms, the best supported first.
MAX_TERMS = 1_000
#: Of the documents that have a learned term, at least this share is toxic.
LEAST_RATE = 0.5
#: Lengths of the word beginnings that are tried as terms.
STEMS = (3, 4, 5, 6, 7, 8)
REJECT = 0.7

#: Seed words, by class. Insult, threat, target, negation, reported speech, stress, intent.
SEEDS = {
    "I": "idiot moron imbecile clown scum trash loser pathetic worthless disgusting stupid idiota imbécil idiote imbécile trottel abschaum",
    "T": "kill murder hurt destroy strangle stab töten umbringen matar tuer",
    "Y": "you your yours they them he she him her du dich dir ihr euch tú te vosotros usted tu toi vous",
    "N": "not never no isn't aren't don't nicht kein keine nie nunca jamás ne pas jamais",
    "R": "said says called quoted reported claimed sagte sagt dijo dice dit disait",
    "S": "such so total complete absolute utter damn bloody absoluter totaler voll tan totalmente quel vrai",
    "B": "will shall gonna going i'll we'll werde werden voy vamos vais allons",
}
#: What a clause makes of a term: insult, targeted insult, threat, negated, reported.
KINDS = ("insult", "targeted", "threat", "negated", "reported")
#: Weights before any label is seen: the bias, then each kind, their density, and a sure term.
PRIOR = (-3.0, 3.0, 4.0, 3.0, 0.5, 0.8, 0.5, 0.5)
#: Weight from which a term is sure, the greatest that it can have.
SURE = 2.0
SPAN = 4

TOKEN = re.compile(r"[^\W\d_]+(?:'[^\W\d_]+)?")
END = re.compile(r"[.!?;:\n]")


#: Weights of arcs: a stressed insult, a threat at someone and one with intent besides, an insult at someone; what negation
#: and reported speech take off; and what a bare threat word weighs when it is negated or reported.
STRESS, THREAT, INTENT, TARGETED, NEGATED, REPORTED, BARE = 0.5, 1.0, 0.5, 0.25, -0.5, -0.25, 0.5


@dataclass(frozen=True)
class Transducer:
    """A weighted machine on symbols. Each arc of a state and symbol is a next state, an output (None for the symbol
    itself) and a weight; there may be several, or none, where paths end. ``*`` stands for symbols without arcs of their
    own; a symbol that has not even that is copied. Paths begin at ``starts`` and count if they stop outside ``open``."""

    starts: tuple
    arcs: dict
    open: frozenset = frozenset()

    def step(self, state, symbol) -> tuple:
        found = self.arcs.get((state, symbol))
        return self.arcs.get((state, "*"), ((state, None, 0.0),)) if found is None else found

    def accepts(self, state) -> bool:
        return state not in self.open


class Composed:
    """The second machine reads what the first writes; weights of arcs are added. Product states and their arcs are made as
    they are met, and kept unless the first machine has an arc for each of many words."""

    def __init__(self, first: Transducer | Composed, second: Transducer | Composed, keep: bool = True):
        self.first, self.second, self.keep = first, second, keep
        self.starts = tuple((a, b) for a in first.starts for b in second.starts)
        self.arcs: dict = {}

    def step(self, state, symbol) -> tuple:
        found = self.arcs.get((state, symbol))
        if found is None:
            found = tuple(
                ((a, b), y or x, v + w)
                for a, x, v in self.first.step(state[0], symbol)
                for b, y, w in self.second.step(state[1], x or symbol)
            )
            if self.keep:
                self.arcs[state, symbol] = found
        return found

    def accepts(self, state) -> bool:
        return self.first.accepts(state[0]) and self.second.accepts(state[1])


def heaviest(machine: Transducer | Composed, symbols: Iterable[str], kinds: Iterable[str]) -> tuple[float, list[tuple[int, str, float]]]:
    """The weight of the heaviest path, and place, output and weight of its arcs that write one of ``kinds``. Of equal
    paths into a state, that which was met first stays."""
    paths = {s: (0.0, None) for s in machine.starts}
    for i, x in enumerate(symbols):
        ahead: dict = {}
        for state, (total, back) in paths.items():
            for to, out, w in machine.step(state, x):
                if to not in ahead or total + w > ahead[to][0]:
                    ahead[to] = (total + w, (back, (i, out or x, w)) if (out or x) in kinds else back)
        paths = ahead
    total, back = max((p for s, p in paths.items() if machine.accepts(s)), key=lambda p: p[0])
    found = []
    while back:
        back, arc = back
        found.append(arc)
    return total, found[::-1]


def insults(weights: dict[str, float]) -> Transducer:
    """Terms become I with their own weights, more right after a word of stress."""
    arcs: dict = {(s, t): ((0, "I", w + s * STRESS),) for t, w in weights.items() for s in (0, 1)}
    arcs |= {(s, "S"): ((1, None, 0.0),) for s in (0, 1)} | {(1, "*"): ((0, None, 0.0),)}
    return Transducer((0,), arcs)


def threats(span: int = SPAN) -> Transducer:
    """A threat word is V in place of T within ``span`` words of a word of intent."""
    arcs: dict = {}
    for left in range(span + 1):
        after = max(left - 1, 0)
        arcs[left, "B"] = ((span, None, 0.0),)
        arcs[left, "T"] = ((after, "V" if left else None, 0.0),)
        arcs[left, "*"] = ((after, None, 0.0),)
    return Transducer((0,), arcs)


def negation(span: int = SPAN) -> Transducer:
    """Terms within ``span`` words after a negation become n."""
    arcs: dict = {}
    for left in range(span + 1):
        after = max(left - 1, 0)
        arcs[left, "N"] = ((span, None, 0.0),)
        for x, w in (("I", NEGATED), ("T", BARE), ("V", BARE)):
            arcs[left, x] = ((after, "n" if left else None, w if left else 0.0),)
        arcs[left, "*"] = ((after, None, 0.0),)
    return Transducer((0,), arcs)


def targets(span: int = SPAN) -> Transducer:
    """Insults become J and threats U with a target at most ``span`` words away on either side. A state is the number of
    words for which the last target holds, and of those within which one must come, since a path has guessed so."""
    marks = {"I": ("J", TARGETED), "T": ("U", THREAT), "V": ("U", THREAT + INTENT)}
    arcs: dict = {}
    for left in range(span + 1):
        for due in range(span + 1):
            after = max(left - 1, 0)
            arcs[(left, due), "Y"] = (((span, 0), None, 0.0),)
            goes = due != 1
            rest = max(due - 1, 0)
            arcs[(left, due), "*"] = (((after, rest), None, 0.0),) if goes else ()
            for x, (y, w) in marks.items():
                guess = ((after, rest or span), y, w)
                if not goes:
                    arcs[(left, due), x] = ()
                elif left:
                    arcs[(left, due), x] = (((after, rest), y, w),)
                else:
                    arcs[(left, due), x] = (((after, rest), None, 0.0), guess)
    return Transducer(((0, 0),), arcs, frozenset((a, d) for a in range(span + 1) for d in range(1, span + 1)))


def reports() -> Transducer:
    """All terms of a clause with a word of reported speech, before or behind them, become q but for negated ones. Paths
    begin either without such a word, and end at one, or owe one."""
    arcs: dict = {("plain", "R"): (), ("owed", "R"): (("heard", None, 0.0),)}
    for state in ("owed", "heard"):
        for x, w in (("I", REPORTED), ("J", REPORTED), ("U", REPORTED), ("T", BARE), ("V", BARE)):
            arcs[state, x] = ((state, "q", w),)
    return Transducer(("plain", "owed"), arcs, frozenset(["owed"]))


#: From I insult, T threat, N negation, Y target, R reported speech, S stress and B intent to the kinds below: I insult, J
#: targeted insult, U targeted threat, n negated, q reported. Words of other outputs have no weight.
GRAMMAR = Composed(threats(), Composed(negation(), Composed(targets(), reports())))
OUTCOME = {"I": 0, "J": 1, "U": 2, "n": 3, "q": 4}


@dataclass(frozen=True)
class Model:
    """Weights of whole words and of word beginnings, and of the clause kinds; bounded by the seeds and MAX_TERMS."""

    words: dict[str, float]
    stems: dict[str, float]
    kinds: tuple[float, ...]

    def scorer(self) -> Scorer:
        return Scorer(self)


class Scorer:
    def __init__(self, model: Model):
        import ahocorasick

        self.model = model
        self.classes = {w: c for c in "BSRNYT" for w in SEEDS[c].split()}
        self.search = ahocorasick.Automaton()
        for term in {*model.words, *model.stems, *SEEDS["T"].split()}:
            self.search.add_word(term, len(term))
        self.search.make_automaton()
        self.lengths = sorted({len(x) for x in model.stems})
        self.machine = Composed(insults(model.words | {f"{x}*": w for x, w in model.stems.items()}), GRAMMAR, keep=False)

    def symbol(self, word: str) -> str:
        """The heaviest term that a word is or begins with, a stem with ``*``; else the word's class, or W."""
        best = self.model.words.get(word, 0.0)
        found = word if best > 0 else self.classes.get(word, "W")
        for n in self.lengths:
            w = self.model.stems.get(word[:n], 0.0) if len(word) >= n else 0.0
            if w > best:
                best, found = w, f"{word[:n]}*"
        return found

    def clauses(self, text: str | None) -> Iterator[tuple[int, int, float, list[tuple[int, str, float]]]]:
        """Start and end in the lower-cased text of each clause with a term, the weight of its path and the terms on it:
        place among the words, kind and weight."""
        low, done = (text or "").lower(), -1
        for end, size in self.search.iter(low):
            at = end - size + 1
            if at < done or (at and low[at - 1].isalpha()):
                continue
            start = max(low.rfind(x, 0, at) for x in ".!?;:\n") + 1
            stop = END.search(low, at)
            done = stop.start() if stop else len(low)
            weight, found = heaviest(self.machine, map(self.symbol, TOKEN.findall(low, start, done)), OUTCOME)
            yield start, done, weight, found

    def features(self, text: str | None) -> list[float]:
        """Per clause kind, the log of 1 plus the path weights of its terms, over all clauses of the whole text; then the
        same of all kinds for each hundred words, and whether a term that is neither negated nor reported is sure."""
        sums, sure = [0.0] * len(KINDS), False
        for _, _, _, found in self.clauses(text):
            for _, kind, w in found:
                sums[OUTCOME[kind]] += max(w, 0.0)
                sure |= w >= SURE and kind in "IJ"
        total = sum(sums)
        return [*map(math.log1p, sums), math.log1p(100 * total / len((text or "").split())) if total else 0.0, float(sure)]

    def score(self, text: str | None) -> float:
        z = self.model.kinds[0] + sum(a * b for a, b in zip(self.model.kinds[1:], self.features(text), strict=True))
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, z))))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """text and toxic of at most about ``max_labelled`` labelled documents that are not held out. A document that is
    labelled twice is toxic if one label says so; null labels and null ids are left out."""
    own = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    own = own.groupBy(F.col("doc_id").alias("_doc")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    n = own.count()
    if n > max_labelled:
        own = own.where(F.pmod(F.xxhash64("_doc"), F.lit(1 << 40)) < F.lit(int((1 << 40) * max_labelled / n)))
    own = written(own, "toxicity-labels")
    rows = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("text")).join(own, F.col("_id") == F.col("_doc"))
    return written(rows.select("text", "toxic"), "toxicity-training")


def term_counts(rows: DataFrame, hold: int = 100_000) -> DataFrame:
    """term, pos, neg: the toxic and other documents that have a term, pos_times, neg_times: how often they have it.
    A stem ends with ``*``. Counts are summed in each task, at most ``hold`` at a time, before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs: tuple[Counter, Counter] = (Counter(), Counter())
        times: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            terms = list({*docs[0], *docs[1]})
            columns = {"term": pa.array(terms, pa.string())}
            for name, c in (("pos", docs[1]), ("neg", docs[0]), ("pos_times", times[1]), ("neg_times", times[0])):
                columns[name] = pa.array([c[t] for t in terms], pa.int64())
                c.clear()
            return pa.RecordBatch.from_pydict(columns)

        for batch in batches:
            for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = Counter(TOKEN.findall((text or "").lower()))
                for w, n in list(own.items()):
                    for k in STEMS:
                        if len(w) > k:
                            own[w[:k] + "*"] += n
                side = 1 if toxic else 0
                docs[side].update(own.keys())
                times[side].update(own)
                if len(docs[0]) + len(docs[1]) > hold:
                    yield out()
        yield out()

    sums = [F.sum(c).alias(c) for c in ("pos", "neg", "pos_times", "neg_times")]
    return rows.mapInArrow(count, "term string, pos long, neg long, pos_times long, neg_times long").groupBy("term").agg(*sums)


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_terms: int = MAX_TERMS) -> Model:
    """Fit terms and clause weights to a bounded number of labelled rows; with no labels, the seeds and PRIOR stand."""
    rows = training_rows(docs, labels, max_labelled)
    n, toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    seeds = dict.fromkeys(SEEDS["I"].split(), 1.0)
    if not n or not 0 < toxic < n:
        return Model(seeds, {}, PRIOR)
    base = toxic / n
    counts = written(term_counts(rows), "toxicity-terms")
    rate = F.col("pos") / (F.col("pos") + F.col("neg"))
    proof = F.col("pos") * F.log(rate / base) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - rate) / (1 - base))).otherwise(0.0)
    enough = math.log(max(counts.count(), 1)) + math.log(100)
    words_in = counts.where("NOT endswith(term, '*')").agg(F.sum("pos_times"), F.sum("neg_times")).first()
    odds = (F.col("pos_times") + 0.5) / (F.col("neg_times") + 0.5) * ((words_in[1] + 1) / (words_in[0] + 1))
    weight = F.least(F.log(odds) / 3, F.lit(SURE))
    known = {r.term: r.weight for r in counts.where(F.col("term").isin(list(seeds))).select("term", weight.alias("weight")).collect()}
    words = {w: x for w in seeds if (x := known.get(w, 1.0)) > 0}
    best = counts.where((F.col("pos") > 0) & (rate >= LEAST_RATE)).withColumn("proof", proof).where(F.col("proof") >= enough)
    stems: dict[str, float] = {}
    for r in best.where(weight > 0.3).select("term", weight.alias("weight"), "proof").orderBy(F.desc("proof"), "term").limit(max_terms).collect():
        if r.term.endswith("*"):
            stems[r.term[:-1]] = r.weight
        else:
            words[r.term] = max(r.weight, words.get(r.term, 0.0))
    draft = Model(words, stems, PRIOR)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = draft.scorer()
        for batch in batches:
            found = [own.features(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.float64())), batch.column(1)], names=["x", "toxic"])

    seen = rows.mapInArrow(featured, "x array<double>, toxic int").collect()  # bounded by max_labelled
    x = np.array([[1.0, *r.x] for r in seen])
    return Model(words, stems, tuple(fit(x, np.array([r.toxic for r in seen], float))))


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 50) -> np.ndarray:
    """Logistic regression drawn towards PRIOR, by Newton's method; kinds never speak for a text."""
    prior = np.array(PRIOR)
    w = prior.copy()
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        grad = x.T @ (p - y) + ridge * (w - prior)
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge * np.eye(len(w)), grad)
        w = w - step
        w[1:] = np.maximum(w[1:], 0.0)
        if np.abs(step).max() < 1e-6:
            break
    return placed(w, x, y)


def placed(w: np.ndarray, x: np.ndarray, y: np.ndarray, cost: float = 2.0) -> np.ndarray:
    """The weights with the bias moved so that REJECT falls where the rows are split best: toxic rows above the cut less
    ``cost`` times clean ones, halfway to the next row below."""
    z = x @ w
    order = np.argsort(-z, kind="stable")
    z, gain = z[order], np.cumsum(np.where(y[order] > 0, 1.0, -cost))
    ends = np.flatnonzero(np.append(z[1:] < z[:-1] - 1e-9, True))
    best = ends[gain[ends].argmax()]
    below = z[best + 1] if best + 1 < len(z) else z[best] - 2
    w = w.copy()
    w[0] += math.log(REJECT / (1 - REJECT)) - max((z[best] + below) / 2, z[best] - 1)
    return w


def scored(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """The rows with a score from 0 to 1 in place of any column of that name. A null or empty text has the score of a
    text without clauses; equal texts have equal scores; an empty table gives no rows."""
    keep = docs.drop(score)
    at = keep.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields), f"`{score}` double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = model.scorer()
        for batch in batches:
            found = pa.array([own.score(x) for x in batch.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, found], names=[*batch.schema.names, score])

    bounded_batches(docs.sparkSession)
    return keep.mapInArrow(run, schema)
