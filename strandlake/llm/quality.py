"""Quality rules with verdicts on hosts.

Each text gets its own counts and a verdict of its own. Failures are then summed by host, each host's rate is drawn
towards a beta prior that is fitted to all hosts, and the hosts' verdicts are joined back to their documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, fresh, written

LEAST_WORDS = 50
MOST_REPEATED = 50
#: A host is rejected when its shrunk rate of failures is above this.
HOST_RATE = 0.6

#: The characters that count as symbols, and ASCII white space.
SYMBOLS = b"#*$%&|<>"
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of a whole text; zeros for a null."""
    raw = (text or "").encode()
    words = raw.split()
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.split()]
    repeated = 0
    windows = list(zip(words, words[1:], words[2:], strict=False))
    found = Counter(windows)
    if len(found) < len(windows):
        end = 0  # words before this are counted
        for i, w in enumerate(windows):
            if found[w] > 1:
                repeated += i + 3 - max(i, end)
                end = i + 3
    return len(words), chars, symbols, len(lines) - len(set(lines)), repeated


def with_counts(docs: DataFrame, text: str = "text", names: Sequence[str] = COUNTS) -> DataFrame:
    """The rows with the counts of their texts as columns ``names``, which come in batches through Arrow; other columns pass
    untouched. Columns of ``docs`` that have one of these names, in any case, are replaced."""
    added = {n.lower() for n in names}
    keep = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in added])
    at = keep.columns.index(text)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields), *(f"`{c}` long" for c in names)])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [counts(x) for x in batch.column(at).to_pylist()]
            more = [pa.array([x[i] for x in found], pa.int64()) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, *names])

    bounded_batches(docs.sparkSession)
    return keep.mapInArrow(add, schema)


def base_failed(n_words: str = "n_words", n_repeat_words: str = "n_repeat_words") -> Column:
    return (F.col(n_words) < LEAST_WORDS) | (100 * F.col(n_repeat_words) > MOST_REPEATED * F.col(n_words))


def host_verdicts(rows: DataFrame, host: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """host, docs, failures, shrunk_rate, host_kept; ``rows`` has the host and ``base_failed``.

    The prior is beta with the mean and variance of the hosts' rates (method of moments over all hosts; where they do
    not vary, it outweighs every host). Sums are taken before the shuffle, so a host may hold any share of the rows.
    A null host is a host of its own.
    """
    sums = rows.groupBy(F.col(host).alias("host")).agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    sums = written(sums, "hosts")
    r = F.col("failures") / F.col("docs")
    moments = sums.agg(F.avg(r).alias("_mean"), F.coalesce(F.var_pop(r), F.lit(0.0)).alias("_var")).first()
    m, v = moments["_mean"] or 0.0, moments["_var"] or 0.0
    weight = max(m * (1 - m) / v - 1, 1.0) if v > 1e-12 else 1e6
    shrunk = (F.col("failures") + F.lit(weight * m)) / (F.col("docs") + F.lit(weight))
    return sums.withColumn("shrunk_rate", shrunk).withColumn("host_kept", F.col("shrunk_rate") <= F.lit(rate))


def judged(docs: DataFrame, text: str = "text", host: str = "source", rate: float = HOST_RATE, names: dict[str, str] | None = None) -> DataFrame:
    """The rows with counts, ``base_failed`` and ``kept``: no failure of their own and a host that is kept. ``names`` gives
    these columns other names; columns of ``docs`` with the names that are used are replaced, all others pass untouched.

    Host verdicts come from a first pass over text and host alone. Null and empty texts have no words and fail; rows
    that repeat are judged alike; an empty table gives none."""
    name = {c: (names or {}).get(c, c) for c in (*COUNTS, "base_failed", "kept")}
    narrow = with_counts(docs.select(F.col(text).alias("text"), F.col(host).alias("host"))).select("host", base_failed().alias("base_failed"))
    key, kept = fresh(docs, "_host"), fresh(docs, "_host_kept")
    hosts = written(host_verdicts(narrow, "host", rate).select(F.col("host").alias(key), F.col("host_kept").alias(kept)), "host-verdicts")
    rows = with_counts(docs.drop(name["base_failed"], name["kept"]), text, [name[c] for c in COUNTS])
    rows = rows.withColumn(name["base_failed"], base_failed(name["n_words"], name["n_repeat_words"]))
    joined = rows.join(hosts, F.col(f"`{host}`").eqNullSafe(F.col(key)), "left")
    return joined.withColumn(name["kept"], ~F.col(name["base_failed"]) & F.coalesce(kept, F.lit(True))).drop(key, kept)


def kept_only(docs: DataFrame, text: str = "text", host: str = "source", rate: float = HOST_RATE) -> DataFrame:
    """The rows that ``judged`` keeps, with their own columns, whatever these are called."""
    names: dict[str, str] = {}
    for c in (*COUNTS, "base_failed", "kept"):
        names[c] = fresh(docs, f"_{c}")
    return judged(docs, text, host, rate, names).where(F.col(names["kept"])).select([F.col(f"`{c}`") for c in docs.columns])
