"""Token ids as length-delimited binary records, with an offset index.

A record is a frame of little-endian 32-bit words: the payload's length in
bytes (two words), the masked checksum of these, the payload, and the payload's
masked checksum. Checksums are CRC-32C, masked by a rotation and a constant,
so that a checksum stored within checked data does not weaken it. A payload is
one document: its id (two words), one word of flags, then its token ids, of 16
bits where the vocabulary has no larger ids (padded to a whole word), else of 32.
A file is a run of frames and one line feed, which Spark's
text writer adds; files are cut by bytes, at ``FILE_BYTES`` or one longer frame.

Documents are written in ascending order (null ids first; equal ids by
xxhash64 of the text, then by text): the range shuffle deals equal rows to several
tasks too, as their row number is part of its key. The offset index is a
separate table, one row a record: file, offset, length, id, number of ids,
checksum, and ids before it. It is made from the files, whose frames it verifies,
and a reader in any order (``read_records``) takes only what it names.

Nulls: a null text is empty, and an empty one has the end id alone. Long texts
are encoded whole; blocks of text and of records are bounded but for one longer
document. Repeated rows give a record each. An empty table gives no records.
Columns other than the id and the text are not read, so their names cannot clash.
"""

from __future__ import annotations

import functools
import itertools
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vsframe.llm.common import materialize, text_chunks
from vsframe.session import shared_dir

#: Bytes of frames in one file: bounds what one read holds.
FILE_BYTES = 8 << 20
#: Distinct pieces that a worker's cache keeps; beyond it the cache begins anew.
CACHE_WORDS = 1 << 20
#: Bytes of text that are cut into pieces at once.
TEXT_BYTES = 8 << 20

#: Fixed values of the checksum: the reflected Castagnoli polynomial and the mask.
_POLYNOMIAL, _MASK = 0x82F63B78, 0xA282EAD8
#: 32-bit words that the checksum takes in lockstep.
_BLOCK = 256
_HEAD = 3  # words before a payload: length, length, checksum
_OWN = 3  # words of a payload before its ids: id, id, flags
#: Flags: the id is not null; ids take 16 bits; the last 16 bits are padding.
_KNOWN, _NARROW, _PADDED = 1, 2, 4


def _tables() -> np.ndarray:
    """Tables 0..3: the register after a byte and 0..3 zero bytes more."""
    register = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        register = np.where(register & 1, (register >> 1) ^ np.uint32(_POLYNOMIAL), register >> 1).astype(np.uint32)
    tables = [register]
    for _ in range(3):
        tables.append((tables[-1] >> 8) ^ register[tables[-1] & 255])
    return np.stack(tables)


_T = _tables()


def _by_word(register: np.ndarray) -> np.ndarray:
    """The register after the four bytes that were combined into it."""
    return _T[3][register & 255] ^ _T[2][(register >> 8) & 255] ^ _T[1][(register >> 16) & 255] ^ _T[0][register >> 24]


def _skips() -> tuple[np.ndarray, np.ndarray]:
    """The start register after 0.._BLOCK zero words; and, for each byte of a
    register, what it becomes after _BLOCK zero words."""
    start = np.full(1, 0xFFFFFFFF, np.uint32)
    starts = [start]
    for _ in range(_BLOCK):
        start = _by_word(start)
        starts.append(start)
    far = (np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    for _ in range(_BLOCK):
        far = _by_word(far)
    return np.concatenate(starts), far


_STARTS, _FAR = _skips()


def masked_checksums(words: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Masked CRC-32C of each run ``words[starts[i] : starts[i] + counts[i]]``.

    The checksum is linear, so all blocks of all runs advance together from an
    empty register; then each run folds its blocks. A run's short block comes
    first, where leading zero words change nothing.
    """
    blocks = -(-counts // _BLOCK)
    short = counts - (blocks - 1) * _BLOCK  # words of the first block
    first = np.cumsum(blocks) - blocks
    padded = np.zeros(int(blocks.sum()) * _BLOCK, np.uint32)
    inner = np.arange(int(counts.sum()), dtype=np.int64) - np.repeat(np.cumsum(counts) - counts, counts)
    padded[np.repeat(first * _BLOCK + np.where(blocks > 0, _BLOCK - short, 0), counts) + inner] = words[np.repeat(starts, counts) + inner]
    columns = np.ascontiguousarray(padded.reshape(-1, _BLOCK).T)
    register = np.zeros(columns.shape[1], np.uint32)
    for column in columns:
        register = _by_word(register ^ column)
    state = np.full(len(counts), 0xFFFFFFFF, np.uint32)
    some = blocks > 0
    state[some] = _STARTS[short[some]] ^ register[first[some]]
    for k in range(1, int(blocks.max(initial=0))):
        on = np.flatnonzero(blocks > k)
        s = state[on]
        s = _FAR[0][s & 255] ^ _FAR[1][(s >> 8) & 255] ^ _FAR[2][(s >> 16) & 255] ^ _FAR[3][s >> 24]
        state[on] = s ^ register[first[on] + k]
    crc = ~state
    return ((crc >> 15) | (crc << 17)) + np.uint32(_MASK)


def frames(doc_ids: np.ndarray, known: np.ndarray, ids: np.ndarray, counts: np.ndarray, narrow: bool) -> tuple[np.ndarray, np.ndarray]:
    """All frames as 32-bit words, and n + 1 word offsets of the frames.

    ``ids`` holds the documents' token ids one after another, ``counts`` how
    many each has; ``known`` is false where an id is null. Ids take 16 bits
    each if ``narrow``.
    """
    odd = counts % 2 if narrow else np.zeros(len(counts), np.int64)
    sizes = _OWN + ((counts + odd) // 2 if narrow else counts)
    offsets = np.concatenate([[0], np.cumsum(sizes + _HEAD + 1)])
    at, out = offsets[:-1], np.zeros(offsets[-1], "<u4")
    length = (sizes * 4).astype(np.uint64)
    numbers = np.where(known, doc_ids, 0).astype(np.int64).view(np.uint64)
    low = np.uint64(0xFFFFFFFF)
    out[at], out[at + 1] = length & low, length >> np.uint64(32)
    out[at + 2] = masked_checksums(out, at, np.full(len(at), 2))
    out[at + 3], out[at + 4] = numbers & low, numbers >> np.uint64(32)
    out[at + 5] = known * _KNOWN + narrow * _NARROW + odd * _PADDED
    units, each = (out.view("<u2"), 2) if narrow else (out, 1)
    inner = np.arange(len(ids)) - np.repeat(np.cumsum(counts) - counts, counts)
    units[np.repeat(each * (at + _HEAD + _OWN), counts) + inner] = ids
    out[offsets[1:] - 1] = masked_checksums(out, at + _HEAD, sizes)
    return out, offsets


def token_ids(words: np.ndarray, start: int, end: int) -> np.ndarray:
    """The ids (uint32) of the frame ``words[start:end]``."""
    flags, ids = int(words[start + _HEAD + _OWN - 1]), words[start + _HEAD + _OWN : end - 1]
    if flags & _NARROW:
        ids = ids.view("<u2")[: -1 if flags & _PADDED else None]
    return ids.astype("<u4")


_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | (_BYTE >= 97) & (_BYTE <= 122)
#: Between pieces that are encoded in one call.
_BETWEEN = " \x01 "
#: ASCII punctuation but the apostrophe, which contractions begin with.
_MARK = (_BYTE > 32) & (_BYTE < 127) & ~_LETTER & ~((_BYTE >= 48) & (_BYTE <= 57)) & (_BYTE != 39)


class WordEncoder:
    """Token ids by the tokenizers library, each distinct piece encoded once.

    The vocabulary ignores case, drops white space and joins no ids across it,
    nor across a border of letters and other marks. So a text's ids are those
    of its pieces between ASCII white space and such ASCII borders, whose
    A-Z may be lower-cased where no combining mark can follow. Strings of
    special tokens within a text are ordinary text.
    """

    def __init__(self, path: str):
        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.encode_special_tokens = True
        self._between = self._tokenizer.encode(_BETWEEN, add_special_tokens=False).ids
        self.largest = max(self._tokenizer.get_vocab(with_added_tokens=True).values())
        if len(self._between) != 1:
            raise ValueError("the vocabulary has no id of its own for the separator")
        self._forget()

    def _forget(self) -> None:
        self._known: dict[str, int] = {}
        self._ids, self._at, self._size = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _entries(self, pieces: list[str]) -> np.ndarray:
        """Cache entries of distinct pieces, encoding those that it lacks."""
        new = [p for p in pieces if p not in self._known]
        if new and len(self._known) + len(new) > CACHE_WORDS:
            self._forget()
            new = pieces
        if new:
            found, sizes = self._many(new)
            self._known.update(zip(new, range(len(self._at), len(self._at) + len(new))))
            self._at = np.concatenate([self._at, len(self._ids) + np.cumsum(sizes) - sizes])
            self._size = np.concatenate([self._size, sizes])
            self._ids = np.concatenate([self._ids, found])
        return np.fromiter(map(self._known.__getitem__, pieces), np.int64, len(pieces))

    def _many(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has: hundreds a call, as one
        text with a separator between two, where no piece has its ids."""
        texts = [_BETWEEN.join(pieces[i : i + 256]) for i in range(0, len(pieces), 256)]
        found = [e.ids for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        ids = np.fromiter(itertools.chain.from_iterable(f + self._between for f in found), np.uint32)
        ends = np.flatnonzero(ids == self._between[0])
        if len(ends) == len(pieces):
            return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1
        found = [e.ids for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return np.fromiter(itertools.chain.from_iterable(found), np.uint32), np.fromiter(map(len, found), np.int64, len(found))

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (UTF-8 bytes and n + 1 offsets), each with the end
        id appended, and how many each has."""
        pieces = pc.ascii_split_whitespace(_apart(data, offsets))
        coded = pieces.flatten().dictionary_encode()
        entry = self._entries(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        each = self._size[entry]
        before = np.concatenate([[0], np.cumsum(each)])
        cuts = before[np.concatenate([[0], np.cumsum(pc.list_value_length(pieces).to_numpy().astype(np.int64))])]
        counts = np.diff(cuts) + 1
        out = np.full(int(counts.sum()), end_id, np.uint32)
        source = np.repeat(self._at[entry] - before[:-1], each) + np.arange(before[-1])
        out[np.arange(before[-1]) + np.repeat(np.arange(len(counts)), counts - 1)] = self._ids[source]
        if len(self._known) > CACHE_WORDS:
            self._forget()  # one chunk had more than the cache may keep
        return out, counts


def _apart(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The texts with a space at each border of a letter and a mark, both
    ASCII, and A-Z lower-cased before an ASCII byte or a text's end."""
    n = len(data)
    plain = np.ones(n + 1, bool)
    plain[:n] = data < 128
    plain[offsets] = True
    lower = data + np.uint8(32) * (_UPPER[data] & plain[1:])
    letter, mark = _LETTER[data], _MARK[data]
    cut = np.flatnonzero(letter[:-1] & mark[1:] | mark[:-1] & letter[1:]) + 1
    spaced = np.insert(lower, cut, 32)
    moved = offsets + np.searchsorted(cut, offsets)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(moved.astype(np.int64)), pa.py_buffer(spaced))


@functools.cache
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def _records(docs: DataFrame, tokenizer_path: str, end_id: int, file_bytes: int) -> DataFrame:
    """Files' contents, in order: rows (doc_id, text) of each task as frames."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, held, size = _encoder(tokenizer_path), [], 0
        narrow = max(encoder.largest, end_id) < 1 << 16

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["value"])

        for rows, data, cuts in text_chunks(batches, "text", TEXT_BYTES):
            ids, counts = encoder.encode(data, cuts, end_id)
            known = rows.column(0).is_valid().to_numpy(zero_copy_only=False)
            words, offsets = frames(pc.fill_null(rows.column(0), 0).to_numpy(), known, ids, counts, narrow)
            raw, at, lo = words.tobytes(), (4 * offsets).tolist(), 0
            for a, b in zip(at, at[1:]):  # whole frames, as many as fit
                if size and size + b - lo > file_bytes:
                    held.append(raw[lo:a])
                    yield out()
                    held, size, lo = [], 0, a
                if not size and b - lo > file_bytes and a > lo:
                    held.append(raw[lo:a])
                    yield out()
                    held, lo = [], a
            held.append(raw[lo:])
            size += len(raw) - lo
        if size:
            yield out()

    return docs.mapInArrow(work, "value binary")


def write_records(
    docs: DataFrame, path: str, tokenizer_path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES
) -> None:
    """Write every document's token ids and the end id to ``path``, in order."""
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    keyed = plain.withColumns({"h": F.xxhash64("text"), "place": F.monotonically_increasing_id()})
    ordered = keyed.repartitionByRange("doc_id", "h", "place").sortWithinPartitions("doc_id", "h", "text")
    contents = _records(ordered.select("doc_id", "text"), tokenizer_path, end_id, file_bytes)
    contents.select(F.col("value").cast("string")).write.option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def parse_frames(content: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The words of a file and n + 1 word offsets of its frames, all verified."""
    end, at, starts = len(content) - len(content) % 4, 0, [0]
    if content and content[end:] != b"\n":
        raise ValueError("a file of records ends with one line feed")
    while at < end:
        at += 4 * (_HEAD + 1) + struct.unpack_from("<Q", content, at)[0]
        if at > end or at % 4:
            raise ValueError(f"the frame at byte {4 * starts[-1]} does not end within its file")
        starts.append(at // 4)
    words, offsets = np.frombuffer(content, "<u4", end // 4), np.array(starts, np.int64)
    first = offsets[:-1]
    for place, begin, size in (
        (first + 2, first, np.full(len(first), 2)),
        (offsets[1:] - 1, first + _HEAD, np.diff(offsets) - _HEAD - 1),
    ):
        wrong = np.flatnonzero(words[place] != masked_checksums(words, begin, size))
        if len(wrong):
            raise ValueError(f"a checksum of the frame at byte {4 * first[wrong[0]]} does not hold")
    return words, offsets


def _doc_ids(words: np.ndarray, first: np.ndarray) -> pa.Array:
    low, high = words[first + 3].astype(np.uint64), words[first + 4].astype(np.uint64)
    return pa.array((low | high << np.uint64(32)).view(np.int64), mask=words[first + 5] & 1 == 0)


_ENTRY = pa.schema(
    [
        ("path", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("before", pa.int64()),
    ]
)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, content in zip(batch.column(0), batch.column(1)):
            words, offsets = parse_frames(content.as_py())
            first, cuts = offsets[:-1], offsets.tolist()
            counts, crcs = np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
            for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                ids = token_ids(words, a, b)
                counts[k], crcs[k] = len(ids), zlib.crc32(ids)
            columns = [
                pa.array([path.as_py()] * len(first), pa.string()),
                pa.array(4 * first),
                pa.array(4 * np.diff(offsets)),
                _doc_ids(words, first),
                pa.array(counts),
                pa.array(crcs),
                pa.array(np.cumsum(counts) - counts),
            ]
            yield pa.RecordBatch.from_arrays(columns, schema=_ENTRY)


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)


def _number(pattern: str) -> Column:
    return F.regexp_extract("path", pattern, 1).cast("int")


def offset_index(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the files below ``path``, whose frames are read and
    verified: path, offset and length in bytes, doc_id, n_tokens, ids_crc32,
    and start, the number of ids in all records before it.

    Files are ordered by the task that wrote them and its file number. Their
    sums run within a task, then over tasks (one row each).
    """
    found = materialize(_files(spark, path).select("path", "content").mapInArrow(_entries, _spark_schema()), "record-entries")
    files = found.groupBy("path").agg(F.sum("n_tokens").alias("ids"))
    files = files.withColumns({"task": _number(r"/part-(\d+)-[^/]*$"), "file": _number(r"-c(\d+)[^/]*$")})
    tasks = files.groupBy("task").agg(F.sum("ids").alias("ids"))
    earlier = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    tasks = tasks.select("task", F.coalesce(F.sum("ids").over(earlier), F.lit(0)).alias("earlier"))
    within = Window.partitionBy("task").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.withColumn("within", F.coalesce(F.sum("ids").over(within), F.lit(0))).join(tasks, "task")
    starts = files.select("path", (F.col("earlier") + F.col("within")).alias("base"))
    return found.join(starts, "path").select(
        "path", "offset", "length", "doc_id", "n_tokens", "ids_crc32", (F.col("base") + F.col("before")).alias("start")
    )


def _spark_schema() -> str:
    return "path string, offset long, length long, doc_id long, n_tokens long, ids_crc32 long, before long"


def read_records(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, token_ids) of the records that ``wanted`` names by path and
    offset, once for each naming.

    Offsets meet per file (a file's records are bounded by its bytes), so a
    wanted table of any order reads each file at most once, and only the named
    frames are decoded.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(batch.column(0), batch.column(1)):
                words, offsets = parse_frames(content.as_py())
                first = np.array(places.as_py(), np.int64) // 4
                own = [token_ids(words, a, b).view("<i4") for a, b in zip(first, offsets[np.searchsorted(offsets, first) + 1])]
                yield pa.RecordBatch.from_arrays([_doc_ids(words, first), pa.array(own, pa.list_(pa.int32()))], ["doc_id", "token_ids"])

    places = wanted.groupBy("path").agg(F.collect_list("offset").alias("places"))
    found = _files(spark, path).select("path", "content").join(places, "path")
    return found.select("content", "places").mapInArrow(work, "doc_id long, token_ids array<int>")


def token_record_report(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the records and their index, and read them back: doc_id, start,
    n_tokens and ids_crc32 of each document."""
    spark = docs.sparkSession
    path = shared_dir(spark, "token-records")
    write_records(docs, path, tokenizer_path, end_id)
    index = materialize(offset_index(spark, path), "token-record-index")
    return index.select("doc_id", "start", "n_tokens", "ids_crc32")
