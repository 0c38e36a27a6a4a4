"""WARC archives: one gzip member per record, read in sequence.

Archives are rows (path, content), the shape that Spark's ``binaryFile`` reader gives, so the reader takes files as well.
The writer decides by payload digest which record is the response and which are revisits of it, and cuts archives at a
bounded size. The reader inflates piece by piece, frames records by their Content-Length and verifies each digest.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import scratch_path

#: An archive is closed when it holds this many bytes, so that one row or file stays small whatever the input.
ARCHIVE_BYTES = 8 << 20
#: Payloads below this are always written in full.
LEAST_REVISIT = 100
PIECE = 1 << 16
#: How a gzip member and a record start.
MAGIC, START = b"\x1f\x8b\x08", b"WARC/"

RECORD_SCHEMA = "page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long, url string, payload binary, problem string"


def with_roles(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST_REVISIT) -> DataFrame:
    """Each page with its payload, digest and the page that it revisits (null for responses).

    Of payloads that are equal and long enough, the smallest id is the response; rows that repeat that id are responses
    too, and rows without an id are responses. A null page is written as an empty payload; rows that repeat are records
    each; other columns do not go along; a table without rows makes no archive. Equal payloads are met by digest alone: the digests are counted before
    the shuffle, only those of several ids go on, and the page rows join that table, whose size Spark knows.
    """
    rows = pages.select(
        F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    firsts = (
        rows.where((F.length("payload") >= least) & F.col("page_id").isNotNull())
        .groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last"))
        .where("last > first").select(F.col("digest").alias("_digest"), "first")
    )
    path = scratch_path(pages.sparkSession, "warc-firsts")
    firsts.write.parquet(path)
    firsts = pages.sparkSession.read.schema("_digest string, first long").parquet(path)
    joined = rows.join(firsts, F.col("digest") == F.col("_digest"), "left")
    refers = F.when(F.col("page_id") > F.col("first"), F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", refers.alias("refers_to"))


def _b32(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _line(text: str) -> str:
    """A header value without line ends."""
    return " ".join(text.split())


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One record, compressed as a gzip member of its own. A revisit has the HTTP header only."""
    revisit = refers_to is not None
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Date: 1970-01-01T00:00:00Z"]
    head.append(f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>")
    if url is not None:
        head.append(f"WARC-Target-URI: {_line(url)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += [
        f"WARC-Payload-Digest: sha256:{_b32(digest)}", f"WARC-Block-Digest: sha256:{_b32(hashlib.sha256(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def write_archives(roles: DataFrame, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Archives as rows (path, content) in the shared folder. ``roles`` is what ``with_roles`` gives."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, n, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(batch.num_columns)), strict=True):
                held.append(record_bytes(*row))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_pydict({"path": [f"part-{part:06d}-{n:06d}.warc.gz"], "content": [b"".join(held)]})
                    n, held, size = n + 1, [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"path": [f"part-{part:06d}-{n:06d}.warc.gz"], "content": [b"".join(held)]})

    spark = roles.sparkSession
    path = scratch_path(spark, "warc-archives")
    rows = roles.select("page_id", "url", "payload", "digest", "refers_to")
    rows.mapInArrow(pack, "path string, content binary").write.option("compression", "uncompressed").parquet(path)
    return spark.read.schema("path string, content binary").parquet(path)


def _member(view: memoryview, at: int) -> tuple[bytes, int]:
    """The inflated bytes of the gzip member that starts at ``at``, inflated piece by piece, and where it ends."""
    member, out = zlib.decompressobj(31), []
    while not member.eof and at < len(view):
        piece = view[at : at + PIECE]
        out.append(member.decompress(piece))
        at += len(piece)
    if not member.eof:
        raise ValueError("cut short: a gzip member has no end")
    return b"".join(out), at - len(member.unused_data)


def _starts_record(view: memoryview, at: int) -> bool:
    try:
        return zlib.decompressobj(31).decompress(view[at : at + PIECE], len(START)) == START
    except zlib.error:
        return False


def inflated(content: bytes) -> Iterator[tuple[bytes | None, str | None]]:
    """The inflated bytes of each gzip member, one after the other, and what is wrong where there are none. After a damaged
    member the next one that starts a record is read on from, so damage costs the records that it lies in."""
    view, at = memoryview(content), 0
    while 0 <= at < len(view):
        try:
            member, at = _member(view, at)
            yield member, None
        except (zlib.error, ValueError) as e:
            yield None, str(e)[:200]
            at = content.find(MAGIC, at + 1)
            while at >= 0 and not _starts_record(view, at):
                at = content.find(MAGIC, at + 1)


def parsed(member: bytes) -> dict:
    """The record of a member: header fields by lower-case name, and the block as its Content-Length frames it."""
    head, found, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    size = int(fields["content-length"])
    if len(rest) < size or rest[size:] not in (b"\r\n\r\n", b""):
        raise ValueError("the block does not fit its Content-Length")
    return fields | {"": rest[:size]}


def _page(uri: str | None) -> int | None:
    name = (uri or "").strip("<>").rpartition(":")[2]
    return int(name) if name.lstrip("-").isdigit() else None


def read_record(member: bytes) -> dict:
    """A row of RECORD_SCHEMA; ``problem`` says what is wrong with a record whose digest or framing does not hold."""
    row = dict.fromkeys(("page_id", "record_type", "payload_bytes", "payload_digest", "refers_to", "url", "payload", "problem"))
    try:
        fields = parsed(member)
        block = fields[""]
        row |= {"page_id": _page(fields.get("warc-record-id")), "record_type": fields.get("warc-type"), "url": fields.get("warc-target-uri")}
        row["payload_digest"] = base64.b32decode(fields["warc-payload-digest"].partition(":")[2]).hex()
        if fields.get("warc-block-digest") != f"sha256:{_b32(hashlib.sha256(block).hexdigest())}":
            row["problem"] = "block digest"
        elif row["record_type"] == "revisit":
            row["refers_to"] = _page(fields.get("warc-refers-to"))
        else:
            payload = block.partition(b"\r\n\r\n")[2]
            row |= {"payload": payload, "payload_bytes": len(payload)}
            if hashlib.sha256(payload).hexdigest() != row["payload_digest"]:
                row["problem"] = "payload digest"
    except (ValueError, KeyError) as e:
        row["problem"] = str(e)[:200]
    return row


def read_archives(archives: DataFrame) -> DataFrame:
    """Every record of the archives (columns path, content), in RECORD_SCHEMA. Archives are read one after the other,
    records come out in small batches. A damaged stretch gives a row that names the problem, with nulls elsewhere; the records
    after it are read. A null or empty archive has no records, an empty table gives none."""
    schema = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for member, problem in inflated(content.as_py() or b""):
                    if member is None:
                        rows.append(dict.fromkeys(schema.names) | {"problem": problem})
                        continue
                    rows.append(read_record(member))
                    size += len(member)
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema=schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return archives.select("content").mapInArrow(unpack, RECORD_SCHEMA)


def resolved(records: DataFrame) -> DataFrame:
    """Records without their payloads, revisits with the payload size of the response that they refer to."""
    narrow = records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "problem")
    path = scratch_path(records.sparkSession, "warc-records")
    narrow.write.option("compression", "zstd").parquet(path)
    rows = records.sparkSession.read.schema(narrow.schema).parquet(path)
    whole = rows.where("record_type = 'response'").groupBy(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest")).agg(F.max("payload_bytes").alias("_bytes"))
    revisits = rows.where("record_type = 'revisit'").join(whole, (F.col("refers_to") == F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    revisits = revisits.withColumns({
        "payload_bytes": F.col("_bytes"),
        "problem": F.coalesce("problem", F.when(F.col("_bytes").isNull(), F.lit("its response is missing"))),
    })
    return rows.where("record_type IS NULL OR record_type <> 'revisit'").unionByName(revisits.select(*narrow.columns))


def export_files(archives: DataFrame, folder: str) -> None:
    """Each archive as a file of its own in a folder that all executors mount."""

    def save(rows) -> None:
        import os

        for row in rows:
            with open(os.path.join(folder, row.path), "wb") as f:
                f.write(row.content)

    archives.foreachPartition(save)
