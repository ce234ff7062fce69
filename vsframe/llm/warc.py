"""WARC archives: writing, reading, and revisit resolution.

Records are WARC/1.1: a version line, named fields, an empty line, a block of
Content-Length bytes, two line ends. Each is a gzip member of its own, as usual;
a file is a run of members, cut by bytes, and an empty member that Spark's
text writer adds. The reader takes any number of records a member.

A record whose payload equals another's can be a ``revisit``: header fields
only, with WARC-Refers-To naming the record that has the payload. Resolution
shuffles headers by payload digest, each with its locator (file, offset of its
member, number within it), never payloads. Then every file is read once more
beside its revisits' locators, payloads are copied from where they lie, and the
archives are written anew, deduplicated, with fresh headers.

Nulls: a null payload is empty, a null URL an absent field, a null id an empty
one (such a record never is the one referred to unless all its equals are).
Records that repeat are told apart by their locators. An empty table gives an
archive without records. Long payloads: a task holds one file's bytes and one
record, and a file is longer than its limit only by one record. Line ends
in URLs are percent-encoded, so that no header can be forged. Columns other than
page_id, url and html are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vsframe.llm.common import materialize, salted_join
from vsframe.session import shared_dir

#: Compressed bytes from which a file ends: bounds what one read task holds.
FILE_BYTES = 8 << 20
#: Bytes that are decompressed at once, and of payloads in one batch of rows.
PIECE_BYTES, BATCH_BYTES = 1 << 16, 1 << 22
#: Smallest payload that may become a revisit.
MIN_BYTES = 0
#: WARC-Date of written records: the crawl gives none, and re-runs must agree.
DATE = "1970-01-01T00:00:00Z"
_RECORD = "urn:record:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

SCHEMA = "record_type string, id long, url string, payload_digest string, payload_bytes long, refers_to long, payload string"
_TYPES = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
_LOCATED = "path string, offset long, place int, id long, payload_digest string, payload_bytes long"


class Record(NamedTuple):
    """A record: its fields by lower-case name, its block, and where it stands
    (offset of its member in the file, number within the member)."""

    fields: dict[str, str]
    block: memoryview
    offset: int
    place: int


def digest_of(payload: bytes | memoryview) -> str:
    """Bare upper-case base32 SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _named(id_: int | None) -> str:
    return f"<{_RECORD}{'' if id_ is None else id_}>"


def _number(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").removeprefix(_RECORD)
    return int(text) if text else None


def format_record(
    id_: int | None, url: str | None, payload: bytes | memoryview, digest: str, size: int, refers_to: int | None = None, revisit: bool = False
) -> bytes:
    """A whole record; a revisit has the digest and size of its payload, not the payload."""
    block = b"" if revisit else payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_named(id_)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}"]
    if revisit:
        lines += [f"WARC-Refers-To: {_named(refers_to)}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return b"".join(["\r\n".join(lines).encode(), b"\r\n\r\n", block, b"\r\n\r\n"])


def member(data: bytes) -> bytes:
    """A gzip member; its time stamp is zero, so that re-runs agree."""
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


_EMPTY_MEMBER = member(b"")


def members(content: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, data) of each gzip member of a file."""
    at, view = 0, memoryview(content)
    while at < len(content):
        unpacker, start, parts = zlib.decompressobj(31), at, []
        while not unpacker.eof:
            if at >= len(content):
                raise ValueError(f"the member at byte {start} does not end within its file")
            piece = view[at : at + PIECE_BYTES]
            parts.append(unpacker.decompress(piece))
            at += len(piece) - len(unpacker.unused_data)
        yield start, b"".join(parts)


def parse_records(content: bytes) -> Iterator[Record]:
    """Every record of an archive file, by Content-Length; blocks may hold anything."""
    for offset, data in members(content):
        at, view, place = 0, memoryview(data), 0
        while at < len(data):
            end = data.index(b"\r\n\r\n", at)
            lines = data[at:end].decode("utf-8").split("\r\n")
            if not lines[0].startswith("WARC/"):
                raise ValueError(f"no record at byte {at} of the member at byte {offset}")
            fields = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines[1:])}
            block, at = end + 4, end + 4 + int(fields["content-length"])
            if at > len(data):
                raise ValueError(f"the record at byte {end} of the member at byte {offset} does not end within it")
            yield Record(fields, view[block:at], offset, place)
            at, place = at + 4, place + 1


def _write(contents: DataFrame, path: str) -> None:
    """Each row's bytes as a file, which the writer ends with an empty member."""
    contents.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1").option(
        "lineSep", _EMPTY_MEMBER.decode("iso-8859-1")
    ).option("maxRecordsPerFile", 1).text(path)


def _files_of(records: Iterator[bytes], file_bytes: int) -> Iterator[pa.RecordBatch]:
    """Records as members, a row of ``file_bytes`` or one record more a file."""
    held, size = [], 0
    for record in records:
        held.append(member(record))
        size += len(held[-1])
        if size >= file_bytes:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])


def write_archives(pages: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """Write a response a row of ``pages`` (page_id, url, html) as archives."""

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for id_, url, html in zip(*batch.columns):
                payload = (html.as_py() or "").encode()
                yield format_record(id_.as_py(), url.as_py(), payload, digest_of(payload), len(payload))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _files_of(records(batches), file_bytes)

    plain = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    _write(plain.mapInArrow(work, "value binary"), path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of every file below ``path`` but hidden ones."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")


def _rows(files: DataFrame, row: Callable[[str, Record], tuple], ddl: str, types: list[pa.DataType]) -> DataFrame:
    """A row a record, batches bounded by their blocks' bytes."""
    names = [c.split()[0] for c in ddl.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path, content in zip(*batch.columns):
                for record in parse_records(content.as_py()):
                    rows.append(row(path.as_py(), record))
                    size += len(record.block) + 256
                    if size > BATCH_BYTES:
                        yield out(rows)
                        rows, size = [], 0
        if rows:
            yield out(rows)

    return files.mapInArrow(work, ddl)


def _known(fields: dict[str, str]) -> tuple[int | None, str, int]:
    return _number(fields["warc-record-id"]), fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of all archives below ``path``; payload null for revisits."""

    def row(_: str, record: Record) -> tuple:
        fields, (id_, digest, size) = record.fields, _known(record.fields)
        payload = str(record.block, "utf-8") if fields["warc-type"] == "response" else None
        return fields["warc-type"], id_, fields.get("warc-target-uri"), digest, size, _number(fields.get("warc-refers-to")), payload

    return _rows(_files(spark, path), row, SCHEMA, _TYPES)


def read_headers(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, place, id, payload_digest, payload_bytes): locators and
    headers of the responses below ``path``, no payloads."""

    def row(file: str, record: Record) -> tuple:
        return file, record.offset, record.place, *_known(record.fields), record.fields["warc-type"]

    types = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.string()]
    found = _rows(_files(spark, path), row, f"{_LOCATED}, kind string", types)
    return found.where("kind = 'response'").drop("kind")


def resolve_revisits(headers: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """The rows of ``headers`` that become revisits, with refers_to.

    ``headers``: id, payload_digest, payload_bytes of responses, and any other
    columns. Of equal payloads of at least ``min_bytes`` that of the largest id
    stays. The largest id combines before the shuffle by digest, and the join back
    is salted: any share of the records may have one payload.
    """
    able = headers.where(F.col("payload_bytes") >= min_bytes)
    originals = (
        able.groupBy("payload_digest").agg(F.max("id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    )
    return salted_join(able, originals, ["payload_digest"], "id", "inner").where(
        "refers_to IS NOT NULL AND (id IS NULL OR id <> refers_to)"
    )


def deduplicate_archives(spark: SparkSession, source: str, target: str, min_bytes: int = MIN_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Rewrite the responses of the archives at ``source`` to ``target`` with
    revisits resolved and every header made anew.

    Revisits' locators gather per file, a few bytes a record of it, and meet
    the files on their paths: broadcast if Spark finds them small enough.
    """
    headers = materialize(read_headers(spark, source), "warc-headers")
    found = resolve_revisits(headers, min_bytes).groupBy("path").agg(F.collect_list(F.struct("offset", "place", "refers_to")).alias("marks"))
    marks = materialize(found, "warc-revisits")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[bytes]:
        for batch in batches:
            for content, marks in zip(*batch.columns):
                refers = {(m["offset"], m["place"]): m["refers_to"] for m in marks.as_py() or ()}
                for record in parse_records(content.as_py()):
                    if record.fields["warc-type"] == "response":
                        id_, digest, size = _known(record.fields)
                        to = refers.get((record.offset, record.place))
                        yield format_record(id_, record.fields.get("warc-target-uri"), record.block, digest, size, to, to is not None)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _files_of(records(batches), file_bytes)

    joined = _files(spark, source).join(marks, "path", "left").select("content", "marks")
    _write(joined.mapInArrow(work, "value binary"), target)


def archive_report(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives, deduplicate them, and
    read the result back: page_id, payload_bytes, payload_digest, record_type,
    refers_to. Payload bytes and digest are those of the full payload.
    """
    spark = pages.sparkSession
    first, second = shared_dir(spark, "warc-responses"), shared_dir(spark, "warc-deduplicated")
    write_archives(pages, first)
    deduplicate_archives(spark, first, second, min_bytes)
    return read_archives(spark, second).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to"
    )
