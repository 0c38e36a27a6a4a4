"""BPE encoding and decoding by a table of distinct words.

Each task packs the documents that it reads into blocks of bounded size. A block's distinct words meet the other blocks'
in word buckets, where each distinct word is encoded once; the ids go back to the blocks, and each document looks its words
up by position. Decoding starts from a document's ids alone and joins them to the vocabulary's pieces, a table whose size
the vocabulary fixes.

Words are cut at ASCII white space, where the vocabulary's own rules cut too. Words of ASCII alone go into the table in lower
case, as its rules have them, except where that could make a special token of what is none. Everything else (Unicode
forms, other letters' case, other white space, special tokens, splits within words) is left to the tokenizers library.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import bounded_batches, handed_back, parts

DEFAULT_TOKENIZER = "word_bpe_49k.json"
#: Bytes of texts in a block, all of which a task holds at once; a longer text is a block of its own.
BLOCK_BYTES = 16 << 20
#: Bytes of texts whose ids and pieces go back to Spark at once.
RESULT_BYTES = 2 << 20
RESULT = "doc_id long, ids binary, decoded string"

_loaded: dict[str, object] = {}


def tokenizer_file(name: str = DEFAULT_TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer(path: str):
    """The tokenizer of a file, without truncation and padding, loaded once in a process."""
    if path not in _loaded:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        own.no_truncation()
        own.no_padding()
        _loaded[path] = own
    return _loaded[path]


def pieces(path: str) -> pa.Array:
    """The id-to-piece table: the piece of id i at place i, made once in a process."""
    key = f"pieces of {path}"
    if key not in _loaded:
        own = tokenizer(path)
        _loaded[key] = pa.array([own.id_to_token(i) or "" for i in range(own.get_vocab_size(with_added_tokens=True))], pa.string())
    return _loaded[key]


def joined_pieces(ids: list[bytes], path: str) -> pa.Array:
    """The texts of lists of ids (32-bit little-endian numbers): their pieces, joined by a space."""
    return _joined(pa.array(np.frombuffer(b"".join(ids), "<u4")), np.cumsum([0, *(len(x) // 4 for x in ids)]), path)


def _joined(ids: pa.Array, ends: np.ndarray, path: str) -> pa.Array:
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pieces(path).take(ids)), " ")


def raw_tokens(path: str) -> tuple[bytes, ...]:
    """The tokens, in lower case, that the library looks for in the raw text, case by case."""
    return tuple(t.content.encode().lower() for t in tokenizer(path).get_added_tokens_decoder().values() if not t.normalized)


def words_of(text: str | None, raw: tuple[bytes, ...] = ()) -> list[bytes]:
    """The words of a text in order, those of ASCII alone in lower case. Words with other characters stay as they are, since
    a capital may compose with a mark after it, and so do words that have one of ``raw`` in lower case."""
    own = (text or "").encode()
    low = own.lower()
    if low == own:
        return own.split()
    words = low.split()
    special = any(t in low for t in raw)
    if special or not own.isascii():
        words = [y if y.isascii() and not (special and any(t in y for t in raw)) else x for x, y in zip(own.split(), words, strict=True)]
    return words


def _pack(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(3).compress(raw)


def _unpack(packed: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(packed)


def _pack_numbers(numbers: Iterable[int], n: int = -1) -> bytes:
    """32-bit numbers, all first bytes before all second ones: the high ones are mostly equal."""
    return _pack(np.fromiter(numbers, np.uint32, n).view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpack_numbers(packed: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpack(packed), np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


_ROWS = pa.schema([("doc_id", pa.int64()), ("text", pa.large_string())])


def _ends(rows: pa.RecordBatch) -> np.ndarray:
    """The bytes up to the end of each row, ids included."""
    return np.cumsum(pc.fill_null(pc.binary_length(rows.column(1)), 0).to_numpy(zero_copy_only=False) + 16)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text) as compressed blocks, which is what is shuffled. A block is named after what it holds, so that it
    keeps its name if it has to be made again."""
    held: list[pa.RecordBatch] = []
    size = 0

    def out() -> pa.RecordBatch:
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, _ROWS) as stream:
            for x in held:
                stream.write_batch(x)
        raw = sink.getvalue()
        return pa.RecordBatch.from_pydict({"block": pa.array([xxhash.xxh3_128_digest(raw)], pa.binary()), "packet": pa.array([_pack(raw)], pa.binary())})

    for batch in batches:
        rows = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.large_string())], schema=_ROWS)
        ends = _ends(rows)
        at = 0
        while at < rows.num_rows:
            past = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, past + BLOCK_BYTES - size, "right")), at + (not held))
            if to > at:
                held.append(rows.slice(at, to - at))
                size += int(ends[to - 1]) - past
                at = to
            if at < rows.num_rows or size >= BLOCK_BYTES:
                yield out()
                held, size = [], 0
    if held:
        yield out()
    handed_back()


def _texts(packet: bytes) -> Iterator[tuple[pa.Array, list[str | None]]]:
    """A block's ids and texts, in runs of about RESULT_BYTES."""
    for rows in pa.ipc.open_stream(_unpack(packet)):
        ends = _ends(rows)
        at = 0
        while at < rows.num_rows:
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RESULT_BYTES, "right")), at + 1)
            part = rows.slice(at, to - at)
            yield part.column(0), part.column(1).to_pylist()
            at = to


def _block_words(path: str, buckets: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = raw_tokens(path)
        for batch in batches:
            for block, packet in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own: set[bytes] = set()
                for _, texts in _texts(packet):
                    for text in texts:
                        own.update(words_of(text, raw))
                dealt: dict[int, list[bytes]] = {}
                for word in own:
                    dealt.setdefault(zlib.crc32(word) % buckets, []).append(word)
                keys = sorted(dealt)
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array([block] * len(keys), pa.binary()), "bucket": pa.array(keys, pa.int32()),
                    "words": pa.array([_pack(b"\n".join(sorted(dealt[k]))) for k in keys], pa.binary()),
                })
        handed_back()

    return cut


def _encode_bucket(path: str):
    def encode(group: pa.Table) -> pa.Table:
        own = tokenizer(path)
        lists = [_unpack(x).split(b"\n") for x in group.column("words").to_pylist()]
        distinct = sorted(set().union(*lists))
        known: dict[bytes, list[int]] = {}
        for i in range(0, len(distinct), 20_000):
            some = distinct[i : i + 20_000]
            known.update(zip(some, (x.ids for x in own.encode_batch([w.decode() for w in some], add_special_tokens=False)), strict=True))
        ids, sizes = [], []
        for words in lists:
            got = [known[w] for w in words]
            sizes.append(_pack_numbers((len(x) for x in got), len(got)))
            ids.append(_pack_numbers(i for x in got for i in x))
        return pa.table({"block": group.column("block"), "words": group.column("words"), "ids": pa.array(ids, pa.binary()), "sizes": pa.array(sizes, pa.binary())})

    return encode


def _table(rows: list[dict[str, bytes]]) -> tuple[pa.Array, pa.ListArray]:
    """A block's words and, at the same places, their ids; in Arrow, as objects of their own take many times the bytes."""
    if not rows:
        return pa.array([], pa.binary()), pa.array([], pa.list_(pa.uint32()))
    words = pa.concat_arrays([pa.array(_unpack(x["words"]).split(b"\n"), pa.binary()) for x in rows])
    sizes = np.concatenate([[0], *(_unpack_numbers(x["sizes"]) for x in rows)])
    ids = np.concatenate([_unpack_numbers(x["ids"]) for x in rows])
    return words, pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int64), pa.int32()), pa.array(ids))


def _look_up(path: str):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        special = raw_tokens(path)
        for batch in batches:
            for i in range(batch.num_rows):
                words, ids_of = _table(batch.column(1)[i].as_py() or [])
                for own, texts in _texts(batch.column(0)[i].as_py()):
                    cut = [pa.array(words_of(text, special), pa.binary()) for text in texts]
                    places = pc.index_in(pa.concat_arrays(cut), value_set=words)
                    if places.null_count:
                        raise KeyError("a word is not in its block's table")
                    lists = ids_of.take(places)
                    ends = lists.offsets.to_numpy().astype(np.int64)[np.cumsum([0, *map(len, cut)])]
                    flat = lists.flatten()
                    ids = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.array(4 * ends, pa.int32()).buffers()[1], pa.py_buffer(flat.to_numpy())])
                    yield pa.RecordBatch.from_pydict({"doc_id": own, "ids": ids, "decoded": _joined(flat, ends, path)})
        handed_back()

    return found


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int | None = None) -> DataFrame:
    """doc_id, ids (32-bit little-endian numbers, one after the other) and decoded (the pieces joined by a space).

    ``buckets`` is the number of word buckets, by default the shuffle partitions. Null and empty texts, and those of white
    space alone, have no ids and decode to an empty text; repeated rows come out as often as they came in; a null id is
    kept. Other columns are not looked at.
    """
    bounded_batches(docs.sparkSession)
    n = buckets or parts(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_blocks, "block binary, packet binary").repartition(2 * n, "block")
    words = rows.mapInArrow(lambda it, cut=_block_words(path, n): cut(it), "block binary, bucket int, words binary")
    table = words.groupBy("bucket").applyInArrow(_encode_bucket(path), "block binary, words binary, ids binary, sizes binary")
    # A block's packet and its table are bounded by BLOCK_BYTES, or by one longer text. They go to Python as one row, whose
    # results come back run by run.
    table = table.repartition(2 * n, "block").groupBy("block").agg(F.collect_list(F.struct("words", "ids", "sizes")).alias("_table"))
    return rows.join(table.hint("merge"), "block", "left").select("packet", "_table").mapInArrow(_look_up(path), RESULT)


def decoded(encodings: DataFrame, path: str) -> DataFrame:
    """doc_id and text of given ids: each batch joins its ids to the pieces. Null ids give an empty text."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = joined_pieces([x or b"" for x in batch.column(1).to_pylist()], path)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["doc_id", "text"])

    return encodings.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")
