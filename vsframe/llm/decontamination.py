"""Benchmark decontamination by Wu-Manber search for many word windows.

Texts are lower-cased (A-Z) and cut into words; an item's test strings are its
windows of ten consecutive words, or the whole item if it has fewer. Strings of
one length are searched together: the hash of the last two words of the current
window looks up a shift table that says how far the window may move without
missing a string; where it says 0, the hash's bucket names the strings that end
so, and a direct comparison of words confirms them.

The shift loop runs over many stretches of text at once, one numpy lane each.
Items with no word, and null texts, match nothing; repeated items and rows are
reported each on their own. Long texts are searched whole, a bounded number of
texts or one longer one at a time. Without documents nothing returns, without
items every document, unmarked.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vsframe.llm.common import RollingHash, ascii_lower, fresh, lower_bytes, materialize, mix64, salted_join, text_chunks, utf8, word_spans
from vsframe.session import shared_dir

#: Words of a test string.
WINDOW = 10
#: Bytes of benchmark text that are searched for in one pass over the documents;
#: the bound on what is broadcast. More items make more passes.
BLOCK_BYTES = 8 << 20
#: Words that one lane of the shift loop covers.
LANE = 256
_TABLE_BITS = 20

_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return RollingHash(data).slices(starts, ends)


def _block(words: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hash of the ``size`` (1 or 2) words that end at ``at``."""
    return words[at] if size == 1 else mix64(words[at - 1] * np.uint64(0x9E3779B97F4A7C15) + words[at])


class Strings:
    """The test strings of one length, with their shift table and buckets."""

    def __init__(self, length: int, words: np.ndarray, starts: np.ndarray, items: np.ndarray):
        self.length, self.block = length, min(2, length)
        self.starts, self.items = starts, items
        self.shift = np.full(1 << _TABLE_BITS, length - self.block + 1, np.uint8)
        for last in range(self.block - 1, length):  # nearer the end: smaller shift
            hashes = _block(words, starts + last, self.block)
            self.shift[(hashes >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)] = length - 1 - last
        suffix = _block(words, starts + length - 1, self.block)
        order = np.argsort(suffix, kind="stable")
        self.order, self.suffix = order, suffix[order]

    def candidates(self, words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(last word, string) pairs with equal suffix hashes; lanes cover
        windows that end in [lo, hi)."""
        at, until, stops = lo, hi, []
        while len(at):
            jump = self.shift[(_block(words, at, self.block) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)]
            stops.append(at[jump == 0])
            at = at + np.maximum(jump, 1)
            left = at < until
            at, until = at[left], until[left]
        ends = np.concatenate(stops) if stops else np.zeros(0, np.int64)
        hashes = _block(words, ends, self.block)
        first, last = np.searchsorted(self.suffix, hashes, "left"), np.searchsorted(self.suffix, hashes, "right")
        n = last - first
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(ends, n), self.order[np.repeat(first, n) + within]


class Patterns:
    """All test strings of a block of items."""

    def __init__(self, ids: list, texts: list, window: int = WINDOW):
        self.ids = ids
        data, offsets = utf8(pa.array(texts, pa.string()))
        self.data = lower_bytes(data)
        self.word_starts, self.word_ends, counts = word_spans(self.data, offsets, _IS_WORD)
        self.words = _hashes(self.data, self.word_starts, self.word_ends)
        self.raw = self.data.tobytes()
        first = np.cumsum(counts) - counts
        self.groups = []
        for length in np.unique(np.minimum(counts, window)):
            if length:
                of = np.flatnonzero(np.minimum(counts, window) == length)
                n = counts[of] - length + 1
                starts = np.repeat(first[of], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                self.groups.append(Strings(int(length), self.words, starts, np.repeat(of, n)))

    def search(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words per row; and for each occurrence its row, first word within
        the row, length in words, and item (index into ``ids``)."""
        data = lower_bytes(data)
        starts, ends, counts = word_spans(data, offsets, _IS_WORD)
        words, raw = _hashes(data, starts, ends), data.tobytes()
        first = np.cumsum(counts) - counts
        found = [np.zeros((0, 4), np.int64)]
        for strings in self.groups:
            m = strings.length
            n = np.maximum(counts - m + 1, 0)
            lanes = -(-n // LANE)
            row = np.repeat(np.arange(len(counts)), lanes)
            lo = first[row] + m - 1 + (np.arange(len(row)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * LANE
            hi = np.minimum(lo + LANE, (first + counts)[row])
            last, which = strings.candidates(words, lo, hi)
            begin, there = last - m + 1, strings.starts[which]
            same = words[begin] == self.words[there]  # the prefix test, before whole strings
            begin, there, which = begin[same], there[same], which[same]
            equal = np.fromiter(
                (
                    all(
                        raw[a:b] == self.raw[c:d]
                        for a, b, c, d in zip(
                            starts[x : x + m].tolist(),
                            ends[x : x + m].tolist(),
                            self.word_starts[y : y + m].tolist(),
                            self.word_ends[y : y + m].tolist(),
                        )
                    )
                    for x, y in zip(begin.tolist(), there.tolist())
                ),
                bool,
                len(begin),
            )
            begin, which = begin[equal], which[equal]
            row = np.searchsorted(first, begin, "right") - 1  # the last row that begins there has words
            found.append(np.column_stack([row, begin - first[row], np.full(len(row), m), strings.items[which]]))
        hits = np.concatenate(found)
        return counts, *hits[np.lexsort((hits[:, 1], hits[:, 0]))].T


def _merged(starts: list[int], ends: list[int]) -> list[dict]:
    """Unions of intervals that overlap or touch."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    out: tuple[str, str, str] = ("n_words", "spans", "items"),
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with three more columns: words in the text, the word ranges
    covered by benchmark strings (merged, end exclusive), and the distinct ids
    of the items that these come from, as text in text order.

    Items come as ``item_id`` and ``text``, in blocks of about ``block_bytes``
    of text, each sent to every task. One block is searched for in one pass over
    the documents, which are never shuffled. Of several, each is a job of its own
    that writes its hits, so that tasks hold one block at a time; then hits meet
    the documents by the texts' SHA-256.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    plain = docs.drop(*out)
    if blocks == 1:
        return _search(plain, _sent(spark, items), text_col, out)

    n_words, spans, ids = out
    key, place, joined = fresh(docs, "_key", "_place", "_joined")
    digest = F.unhex(F.sha2(F.coalesce(text_col, F.lit("")), 256))
    texts = plain.select(digest.alias("key"), F.col(text_col).alias("text"))
    root = shared_dir(spark, "benchmark-hits")
    for k in range(blocks):
        sent = _sent(spark, items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k))
        hits = _search(texts, sent, "text", ("n", "spans", "items")).where(F.size("spans") > 0)
        # copies of a text have equal hits
        hits.groupBy("key").agg(F.first("spans").alias("spans"), F.first("items").alias("items")).write.parquet(f"{root}/{k}")
        sent.destroy()
    schema = T.StructType([T.StructField("key", T.BinaryType()), T.StructField("spans", SPANS), T.StructField("items", _IDS)])
    found = spark.read.schema(schema).parquet(*(f"{root}/{k}" for k in range(blocks)))
    each = found.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    merged = materialize(each.mapInArrow(_merge_rows, schema), "benchmark-hits")
    named = merged.select(F.col("key").alias(key), F.struct("spans", "items").alias(joined))
    words = F.size(F.regexp_extract_all(ascii_lower(F.coalesce(text_col, F.lit(""))), F.lit(_WORD), F.lit(0)))
    keyed = plain.withColumns({key: digest, place: F.monotonically_increasing_id()})
    marked = salted_join(keyed, named, [key], place, "left")
    return marked.select(
        *plain.columns,
        words.cast("long").alias(n_words),
        F.coalesce(F.col(joined)["spans"], F.array().cast(SPANS)).alias(spans),
        F.coalesce(F.col(joined)["items"], F.array().cast(_IDS)).alias(ids),
    )


_IDS = T.ArrayType(T.StringType())
_SPAN_LISTS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _sent(spark: SparkSession, items: DataFrame) -> Broadcast:
    """A block of items, about its bytes of text, for every task."""
    rows = items.collect()
    return spark.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))


def _merge_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [_merged([x["start"] for x in row], [x["end"] for x in row]) for row in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, _SPAN_LISTS), batch.column(2)], ["key", "spans", "items"])


def _search(docs: DataFrame, sent: Broadcast, text_col: str, out: tuple[str, str, str]) -> DataFrame:
    """``docs`` with the columns ``out`` for one block of items."""
    fields = [T.StructField(n, t) for n, t in zip(out, (T.LongType(), SPANS, _IDS))]
    schema = T.StructType([*docs.schema, *fields])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = Patterns(*sent.value)
        for rows, data, offsets in text_chunks(batches, text_col):
            counts, row, start, length, item = patterns.search(data, offsets)
            spans, ids = [[] for _ in counts], [[] for _ in counts]
            cuts = np.searchsorted(row, np.arange(len(counts) + 1)).tolist()
            ends = start + length
            for r in np.unique(row).tolist():
                a, b = cuts[r], cuts[r + 1]
                spans[r] = _merged(start[a:b].tolist(), ends[a:b].tolist())
                ids[r] = sorted({patterns.ids[i] for i in set(item[a:b].tolist())} - {None})
            more = [pa.array(counts, pa.int64()), pa.array(spans, _SPAN_LISTS), pa.array(ids, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *more], schema.names)

    return docs.mapInArrow(search, schema)


def covered(spans: Column) -> Column:
    """Words covered by merged ranges."""
    return F.aggregate(spans, F.lit(0).cast("long"), lambda acc, s: acc + s["end"] - s["start"])


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    marked = mark_contamination(docs.select("doc_id", "text"), benchmark)
    hit = covered(F.col("spans"))
    return marked.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
