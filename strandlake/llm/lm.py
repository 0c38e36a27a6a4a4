"""Masked pseudo-likelihood of documents under a window network that looks both ways.

Words are counted over the whole corpus; the most frequent become symbols of their own, the others share symbols by
hash. A small network, trained in numpy inside the tasks, predicts each symbol from those on both sides of it: every
task runs its own descent over its part of the corpus, Spark averages the weights, and the next round starts from the
average. A word's probability is that of its symbol, times the word's share of the symbol's occurrences in the table of
all words. A document's score is the sum of the log-probabilities of all its words, each masked in turn.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, parts, written

#: Symbols: the most frequent words, then the hash classes of all others. One more stands for what is beyond the text.
OWN, SHARED = 192, 64
SYMBOLS = OWN + SHARED
#: Symbols on each side, and the width of the hidden layer.
SIDE, HIDDEN = 2, 16
#: Rounds of training; in each, one in STRIDE words is predicted, in each round other ones, all words in all rounds.
ROUNDS, STRIDE = 2, 2
#: Occurrences that each shared symbol keeps for the words that the table does not have, all of them together.
UNSEEN = 1
#: Words of the texts that share a list of distinct words.
CHUNK = 1 << 20
#: Words in a batch of scoring and of training, the step of descent, and how much longer it is for context weights, since
#: a symbol is around few words of a batch.
BATCH, STEP_BATCH, RATE, CONTEXT_RATE = 2048, 512, 1.0, 32
SEED = 11

_SIZES = {"context": (2 * SIDE, SYMBOLS + 1, HIDDEN), "hidden": (HIDDEN,), "out": (HIDDEN, SYMBOLS), "bias": (SYMBOLS,)}

#: Where the rows of each place begin in ``context``.
_PLACES = np.arange(2 * SIDE)[:, None] * (SYMBOLS + 1)
#: Sums of rows by a product, which is faster.
_ONES = np.ones(SYMBOLS, np.float32)


@dataclass
class Network:
    """context: what each symbol at each place adds to the hidden layer; out and bias: from there to the symbols."""

    context: np.ndarray
    hidden: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, counts: np.ndarray) -> Network:
        """Small random weights, and the bias of the symbols' frequencies."""
        rng = np.random.default_rng(SEED)
        made = {k: rng.normal(0, 0.1, size).astype(np.float32) for k, size in _SIZES.items()}
        return cls(**made | {"hidden": np.zeros(HIDDEN, np.float32), "bias": np.log((counts + 1) / (counts + 1).sum()).astype(np.float32)})

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in _SIZES])

    @classmethod
    def of(cls, flat: np.ndarray) -> Network:
        parts, at = {}, 0
        for k, size in _SIZES.items():
            n = int(np.prod(size))
            parts[k], at = flat[at : at + n].reshape(size).astype(np.float32), at + n
        return cls(**parts)

    def layer(self, around: np.ndarray) -> np.ndarray:
        at = around.astype(np.intp)
        h = self.context[0].take(at[0], 0)
        h += self.hidden
        for j in range(1, 2 * SIDE):
            h += self.context[j].take(at[j], 0)
        return np.tanh(h, out=h)

    def before_exp(self, h: np.ndarray) -> np.ndarray:
        """Of each row of the hidden layer a number for each symbol; the bias goes in as one more row of ``out``."""
        return np.concatenate([h, np.ones((len(h), 1), np.float32)], 1) @ np.concatenate([self.out, self.bias[None]])

    def top(self) -> float:
        """What no exponent is above."""
        return float((np.abs(self.out).sum(0) + np.abs(self.bias)).max())

    def log_probs(self, around: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Of each symbol, given the symbols around it (a row per place)."""
        z = self.before_exp(self.layer(around))
        own = z[np.arange(len(symbols)), symbols].astype(np.float64)
        if self.top() > 60:
            high = z.max(1, keepdims=True)
            return own - high[:, 0] - np.log(np.exp(z - high).sum(1))
        return own - np.log(np.exp(z, out=z) @ _ONES)

    def learn(self, around: np.ndarray, symbols: np.ndarray, rate: float) -> None:
        """One step of descent over a batch."""
        n = len(symbols)
        h = self.layer(around)
        z = self.before_exp(h)
        if self.top() > 60:
            z -= z.max(1, keepdims=True)
        np.exp(z, out=z)
        total = z @ _ONES
        z[np.arange(n), symbols] -= total
        each = np.float32(rate / n) / total  # of a row, kept out of the wide table
        back = (z @ self.out.T) * (1 - h * h)
        back *= each[:, None]
        self.out -= (h * each[:, None]).T @ z
        self.bias -= each @ z
        self.hidden -= back.sum(0)
        back *= -CONTEXT_RATE
        at = ((around + _PLACES)[:, :, None] * HIDDEN + np.arange(HIDDEN)).ravel()
        np.add.at(self.context.reshape(-1), at, np.tile(back, (2 * SIDE, 1)).ravel())


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().lower().split()


def word_counts(docs: DataFrame, text: str = "text", hold: int = 200_000) -> DataFrame:
    """word and n over all texts; each task sums what it reads, at most ``hold`` words at a time, before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                found.update(words_of(text))
            if len(found) > hold:
                yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})
                found.clear()
        yield pa.RecordBatch.from_pydict({"word": pa.array(list(found), pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

    return docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _symbol(word: Column) -> Column:
    """The shared symbol of a word, as ``shared`` gives it."""
    return (F.pmod(F.crc32(word), F.lit(SHARED)) + OWN).cast("int")


def shared(word: bytes) -> int:
    return OWN + zlib.crc32(word) % SHARED


def symbol_counts(counts: DataFrame) -> tuple[list[bytes], np.ndarray]:
    """The words that are symbols of their own, most frequent first, and how often each symbol stands in the corpus."""
    best = [(bytes(r.word), r.n) for r in counts.orderBy(F.desc("n"), "word").limit(OWN).collect()]
    n = np.zeros(SYMBOLS)
    n[: len(best)] = [x for _, x in best]
    for r in counts.groupBy(_symbol(F.col("word")).alias("symbol")).agg(F.sum("n").alias("n")).collect():  # SHARED rows at most
        n[r.symbol] = r.n
    for word, x in best:
        n[shared(word)] -= x
    return [w for w, _ in best], n


def with_symbols(docs: DataFrame, own: list[bytes], id_col: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """chunk, doc_id, the symbols of the text's words (a byte each), and of its words of shared symbols the places (32-bit
    numbers) in the chunk's list of distinct ones. The list is in ``words`` of one row of each chunk, null in the others.
    Chunks are numbered by partition: write the rows before they are read twice."""
    number = {w: i for i, w in enumerate(own)}

    def turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, ids, symbols, places, size = TaskContext.get().partitionId() << 32, [], [], [], 0
        known: dict[bytes, tuple[int, int]] = {}

        def out() -> pa.RecordBatch:
            lists = [list(known)] + [None] * (len(ids) - 1)
            columns = [pa.array([name] * len(ids), pa.int64()), pa.array(ids, pa.int64()), pa.array(symbols, pa.binary()), pa.array(places, pa.binary()), pa.array(lists, pa.list_(pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_id", "symbols", "places", "words"])

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                line, at = bytearray(), []
                for w in words_of(text):
                    symbol = number.get(w)
                    if symbol is None:
                        found = known.get(w)
                        if found is None:
                            found = known[w] = (shared(w), len(known))
                        symbol, place = found
                        at.append(place)
                    line.append(symbol)
                ids.append(i)
                symbols.append(bytes(line))
                places.append(np.array(at, np.uint32).tobytes())
                size += len(line)
                if size >= chunk:
                    yield out()
                    name, ids, symbols, places, size = name + 1, [], [], [], 0
                    known.clear()
        if ids:
            yield out()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(turn, "chunk long, doc_id long, symbols binary, places binary, words array<binary>")


def word_shares(symbols: DataFrame, counts: DataFrame, totals: np.ndarray) -> DataFrame:
    """chunk, place and the logarithm of the share that each word of the chunk's list has in its symbol's occurrences,
    of which UNSEEN more are for words that ``counts`` does not have."""
    words = symbols.where("words IS NOT NULL").select(F.col("chunk").alias("chunk"), F.posexplode("words").alias("place", "word"))
    logs = F.array(*[F.lit(float(x)) for x in np.log(np.maximum(totals[OWN:], 0) + UNSEEN)])
    total = F.element_at(logs, _symbol(F.col("word")) - OWN + 1)
    return words.join(counts, "word", "left").select("chunk", "place", (F.log(F.coalesce("n", F.lit(UNSEEN)).cast("double")) - total).alias("share"))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the symbols of several texts: the symbols around each (SIDE on either side, a row per place), the symbols
    themselves, and the number of each one's text. Beyond a text's ends there is the symbol SYMBOLS."""
    gap = bytes(SIDE)
    raw = np.frombuffer(gap + gap.join(texts) + gap, np.uint8).astype(np.int16)
    sizes = np.array([len(x) for x in texts])
    starts = np.cumsum(np.concatenate([[SIDE], sizes[:-1] + SIDE])) if len(sizes) else sizes
    inside = np.zeros(len(raw) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, starts + sizes, -1)
    inside = np.cumsum(inside)[:-1] > 0
    raw[~inside] = SYMBOLS
    at = np.flatnonzero(inside)
    around = np.stack([raw[at + j] for j in range(-SIDE, SIDE + 1) if j])
    return around, raw[at], np.repeat(np.arange(len(texts)), sizes)


def _texts(batches: Iterable[pa.RecordBatch], hold: int = 1 << 20) -> Iterator[list[list]]:
    """The columns as lists, of which ``symbols`` bounds the size."""
    held, size = None, 0
    for batch in batches:
        at = batch.schema.names.index("symbols")
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            held = held or [[] for _ in row]
            for to, x in zip(held, row, strict=True):
                to.append(x)
            size += len(row[at])
            if size > hold:
                yield held
                held, size = None, 0
    if held:
        yield held


def train(symbols: DataFrame, counts: np.ndarray, rounds: int = ROUNDS, stride: int = STRIDE) -> Network:
    """Weights from descent in every task, averaged by the words that each has seen; the sums run in Spark by weight, so
    only the averages, as many as the network has weights, come to the driver."""
    net = Network.new(counts)
    for r in range(rounds):
        start = net.flat()

        def descend(batches: Iterator[pa.RecordBatch], start=start, r=r) -> Iterator[pa.RecordBatch]:
            own, seen = Network.of(start), 0
            for (texts,) in _texts(batches):
                around, symbols, _ = windows(texts)
                chosen = slice(r * stride // rounds, None, stride)
                around, symbols = around[:, chosen], symbols[chosen]
                mixed = np.random.default_rng(SEED + r).permutation(len(symbols))
                for i in range(0, len(mixed), STEP_BATCH):
                    some = mixed[i : i + STEP_BATCH]
                    own.learn(around[:, some], symbols[some], RATE)
                seen += len(symbols)
            yield pa.RecordBatch.from_pydict({"weights": pa.array([own.flat().tolist()], pa.list_(pa.float32())), "seen": pa.array([seen], pa.int64())})

        got = symbols.mapInArrow(descend, "weights array<float>, seen long").where("seen > 0")
        each = got.select("seen", F.posexplode("weights").alias("at", "weight"))
        mean = each.groupBy("at").agg((F.sum(F.col("weight").cast("double") * F.col("seen")) / F.sum("seen")).alias("weight")).collect()
        if mean:
            flat = np.empty(len(start))
            flat[[x["at"] for x in mean]] = [x["weight"] for x in mean]
            net = Network.of(flat)
    return net


def score(symbols: DataFrame, shares: DataFrame, net: Network) -> DataFrame:
    """doc_id, n_tokens, log_likelihood (natural logarithm, summed over all words) and mean_log_likelihood."""

    def run(docs: pa.Table, shares: pa.Table) -> pa.Table:
        share = np.zeros(shares.num_rows)
        share[shares.column("place").to_numpy()] = shares.column("share").to_numpy()
        done = []
        columns = [docs.column(c).combine_chunks() for c in ("doc_id", "symbols", "places")]
        for ids, texts, places in _texts([pa.RecordBatch.from_arrays(columns, names=["doc_id", "symbols", "places"])]):
            around, own, place = windows(texts)
            sums = np.array([share[np.frombuffer(x, np.uint32)].sum() for x in places])
            for i in range(0, len(own), BATCH):
                part = slice(i, i + BATCH)
                got = np.bincount(place[part] - place[i], net.log_probs(around[:, part], own[part]))
                sums[place[i] : place[i] + len(got)] += got
            sizes = [len(x) for x in texts]
            means = [s / n if n else None for s, n in zip(sums.tolist(), sizes, strict=True)]
            done.append(pa.table([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sums, pa.float64()), pa.array(means, pa.float64())], names=["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"]))
        return pa.concat_tables(done)

    docs = symbols.select("chunk", "doc_id", "symbols", "places").repartition(2 * parts(symbols.sparkSession), "chunk")
    return docs.groupBy("chunk").cogroup(shares.groupBy("chunk")).applyInArrow(run, "doc_id long, n_tokens long, log_likelihood double, mean_log_likelihood double")


def pseudo_likelihood(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Count, train and score over all documents.

    Null and empty texts have no words, the sum 0 and a null mean. Repeated rows score alike; a null id is kept; other
    columns are not looked at. An empty table gives no rows.
    """
    counts = written(word_counts(docs, text), "lm-words")
    own, totals = symbol_counts(counts)
    symbols = written(with_symbols(docs, own, id_col, text), "lm-symbols")
    return score(symbols, word_shares(symbols, counts, totals), train(symbols.select("symbols"), totals))
