"""Fill-in-the-middle rearrangement of texts.

Texts are cut as UTF-8 bytes and never decoded. An index of exceptions holds, for the characters of more than one byte
only, where they stand and how many bytes they have beyond one; a binary search in it turns a cut by code points into one
by bytes and back, and between exceptions the two differ by a constant.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, fresh, handed_back

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Units that a text can be cut into; a word takes the white space before it, and white space at the end is one more.
UNITS = ("line", "char", "word")
WORDS = re.compile(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
#: What rearranged rows have besides the columns they come with.
ADDED = ("n", "form", "prefix_chars", "middle_chars", "output")


@dataclass
class Exceptions:
    """The characters of more than one byte of a text: ``at`` in code points, ``at_byte`` in bytes, and ``excess``, the
    bytes beyond one for each character up to and with this one."""

    at: np.ndarray
    at_byte: np.ndarray
    excess: np.ndarray
    n_bytes: int

    @classmethod
    def of(cls, raw: np.ndarray) -> Exceptions:
        at_byte = np.flatnonzero(raw >= 0xC0)
        lead = raw[at_byte]
        more = 1 + (lead >= 0xE0).astype(np.int64) + (lead >= 0xF0)
        excess = np.cumsum(more)
        return cls(at_byte - (excess - more), at_byte, excess, len(raw))

    @property
    def n_chars(self) -> int:
        return self.n_bytes - (int(self.excess[-1]) if len(self.excess) else 0)

    def bytes_of(self, chars: np.ndarray | int) -> np.ndarray:
        """Bytes of the first so many code points."""
        before = np.searchsorted(self.at, chars, side="left")
        return chars + np.where(before > 0, self.excess[before - 1], 0) if len(self.at) else np.asarray(chars)

    def chars_of(self, cut: np.ndarray | int) -> np.ndarray:
        """Code points of the first so many bytes, which end between two characters."""
        before = np.searchsorted(self.at_byte, cut, side="left")
        return cut - np.where(before > 0, self.excess[before - 1], 0) if len(self.at) else np.asarray(cut)


def ends(raw: np.ndarray, index: Exceptions, unit: str) -> np.ndarray:
    """Where each unit of a text ends, in bytes."""
    if unit == "char":
        return index.bytes_of(np.arange(1, index.n_chars + 1))
    if unit == "word":
        return np.array([m.end() for m in WORDS.finditer(raw.tobytes())], np.int64)
    found = np.flatnonzero(raw == 10) + 1
    return found if not len(raw) or (len(found) and found[-1] == len(raw)) else np.append(found, len(raw))


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 from the seed and the row's id; a null id draws as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in (0, 4, 8, 12)]


def rearrange(raw: bytes, h: list[int], unit: str, rate: int, spm: int) -> tuple[int, str, int | None, int | None, bytes]:
    """n, form, prefix_chars, middle_chars and output of one text."""
    data = np.frombuffer(raw, np.uint8)
    index = Exceptions.of(data)
    stops = ends(data, index, unit)
    n = len(stops)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not raw or h[2] % 100 >= rate or any(m in raw for m in marks):
        return n, "plain", None, None, raw
    a, b = (int(stops[k - 1]) if k else 0 for k in sorted((h[0] % (n + 1), h[1] % (n + 1))))
    p, s, m = marks
    before, after = int(index.chars_of(a)), int(index.chars_of(b))
    form = "spm" if h[3] % 100 < spm else "psm"
    parts = (s, raw[b:], p, raw[:a]) if form == "spm" else (p, raw[:a], s, raw[b:])
    return n, form, before, after - before, b"".join((*parts, m, raw[a:b]))


def transformed(docs: DataFrame, unit: str = "line", rate: int = 100, spm: int = 50, seed: int = 7, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows with n (units of the text, long), form (plain, psm or spm), prefix_chars and middle_chars (long, null if
    plain) and output (string).

    ``rate`` percent of the rows are rearranged, ``spm`` percent of these with the suffix first; both and the two cuts are
    drawn from the seed and the row's integer id alone. The prefix ends after the smaller draw of units, the middle after
    the larger. Null and empty texts are plain with an output of no characters; so are texts that hold one of the three
    marks. Rows that repeat come out alike, rows of a null id draw as one; an empty table gives none. Columns that ``docs``
    has beside them pass untouched, but those with the name of a column added are replaced.
    """
    if unit not in UNITS:
        raise ValueError(f"unit has to be one of {UNITS}")
    keep = docs.select([F.col(f"`{c}`") for c in docs.columns if c.lower() not in ADDED])
    one, two = fresh(keep, "_fim_id"), fresh(keep, "_fim_text")
    rows = keep.withColumns({one: F.col(id_col).cast("long"), two: F.coalesce(F.col(text).cast("binary"), F.lit(b""))})
    names = keep.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keep.schema.fields), "n long, form string, prefix_chars long, middle_chars long, output string"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(len(names)), batch.column(len(names) + 1)
            got = [rearrange(t.as_py(), draws(seed, i.as_py()), unit, rate, spm) for i, t in zip(ids, texts, strict=True)]
            columns = [pa.array([g[k] for g in got], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *columns[:4], columns[4].cast(pa.string())], names=[*names, *ADDED])
        handed_back()

    bounded_batches(docs.sparkSession)
    return rows.mapInArrow(cut, schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made from, by the marks alone: no part of a rearranged text holds one."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    at = lambda i: F.coalesce(F.get(part, F.lit(i)), F.lit(""))
    return F.when(form == "psm", F.concat(at(1), at(3), at(2))).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(output)
