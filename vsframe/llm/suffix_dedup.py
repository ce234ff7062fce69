"""Removal of repeated byte strings by longest previous factors.

A byte goes when it lies in a string of ``length`` bytes that also starts
elsewhere, in the same text or another. Texts are cut into overlapping slices
that can be compared on their own:

1. Every window of ``length`` bytes has an anchor, the ``gram`` bytes of least
   hash in it (leftmost on ties). Equal windows have equal anchors, so windows
   whose anchor occurs once cannot repeat. Windows are kept as runs that share
   one anchor; a run's bytes are a slice.
2. Slices of repeated anchors that are equal as a whole (128 bits of two unlike
   hashes) repeat in all their windows. Of each, one representative goes on, and
   only where an anchor has several different slices.
3. All slices of an anchor meet in one task, which sorts the suffixes that begin
   windows to depth ``length`` by rank doubling, and finds the common prefixes of
   neighbours from the ranks of all depths. For each suffix the nearest entries
   of smaller position before and after it in suffix order, with the least
   common prefix on the way, give the longest factor that starts earlier;
   of larger position, the longest that starts later. A window whose longest
   factor reaches ``length`` repeats. An anchor with too many different slices for one
   task is refined: its windows are cut into blocks by their distance to the
   anchor, blocks meet by a 128-bit hash of the bytes that all windows of a block
   share, equal blocks (by such a hash) collapse, and groups that are still too
   large are cut into narrower blocks, down to single windows.

With ``keep_first`` a window goes only if it has an earlier match (by doc_id,
null first, then key, then offset), so the first copy stays; else every copy
goes. Null texts are empty; texts that share an id, or have none, are told apart
by their key; repeated rows, of one key, are copies of each other, and
``keep_first`` treats them as one. Long texts are anchored whole, in overlapping
segments. An empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vsframe.llm.common import RollingHash, Steps, discard, key_filter, materialize, passes, salted_join, text_chunks

LENGTH = 200
GRAM = 32
#: Different slices of one anchor that one task may compare by suffix order.
GROUP_SLICES = 512
#: Windows of a block, by refinement step; a block of one is its window.
BLOCKS = (32, 4, 1)
#: Bytes of slices that are sorted at once.
SORT_BYTES = 2 << 20
_PLACE_BITS = 24
_SEGMENT = 1 << 23  # longer texts are anchored in overlapping segments


def _anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Row, first window, windows, anchor hash and two slice hashes of every run."""
    n, rolling = len(data), RollingHash(data)
    grams = rolling.windows(gram)
    width = length - gram + 1
    places = np.arange(len(grams), dtype=np.uint64)
    packed = (grams >> np.uint64(_PLACE_BITS) << np.uint64(_PLACE_BITS)) | places
    blocks = -(-len(packed) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(packed)] = packed
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - length + 1
    least = np.minimum(behind[:windows], ahead[width - 1 : width - 1 + windows])
    anchor = (least & np.uint64((1 << _PLACE_BITS) - 1)).astype(np.int64)
    valid = np.ones(windows + 1, bool)
    valid[windows] = False
    for end in offsets[1:].tolist():  # windows across the ends of texts
        valid[max(0, end - length + 1) : end] = False
    first = valid[:windows].copy()
    first[1:] &= (anchor[1:] != anchor[:-1]) | ~valid[: windows - 1]
    starts = np.flatnonzero(first)
    last = valid[:windows].copy()
    last[:-1] &= first[1:] | ~valid[1:windows]
    ends = np.flatnonzero(last)
    row = np.searchsorted(offsets, starts, "right") - 1
    # sums of the slices' mixed gram hashes, unlike the rolling hash of their bytes
    sums = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(grams, out=sums[1:])
    sums = sums[ends + width] - sums[starts]
    return row, starts - offsets[row], ends - starts + 1, grams[anchor[starts]], rolling.slices(starts, ends + length), sums


def anchor_runs(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """The same for texts of any size: a single long one goes in segments that
    overlap by a window less one byte."""
    if len(data) < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, np.uint64))
    if len(data) <= _SEGMENT + length:
        return _anchor_runs(data, offsets, length, gram)
    parts = []
    for at in range(0, len(data) - length + 1, _SEGMENT):  # one row: chunks of several are far smaller
        piece = data[at : at + _SEGMENT + length - 1]
        row, start, *rest = _anchor_runs(piece, np.array([0, len(piece)]), length, gram)
        parts.append((row, start + at, *rest))
    return tuple(np.concatenate(x) for x in zip(*parts))


def suffix_ranks(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, np.ndarray]]]:
    """Rank, in suffix order to depth ``length``, of the suffixes at ``starts``;
    and (depth, ranks of all suffixes) for the depths below it.

    Doubling: ranks to depth 8 are the bytes themselves; two ranks of one depth
    side by side are a rank of twice the depth, and two that overlap of any
    depth between.
    """
    padded = np.concatenate([data, np.zeros(length, np.uint8)])
    rank = np.zeros(len(data) + 1, np.int64)
    value = np.zeros(len(data), np.uint64)
    for j in range(8):
        value = value << np.uint64(8) | padded[j : j + len(data)]
    rank[:-1] = np.unique(value, return_inverse=True)[1]
    levels, depth = [(8, rank.copy())], 8
    while 2 * depth <= length:
        ahead = rank[np.minimum(np.arange(len(data)) + depth, len(data))]
        rank[:-1] = np.unique(rank[:-1] * len(rank) + ahead, return_inverse=True)[1]
        depth *= 2
        levels.append((depth, rank.copy()))
    return np.unique(rank[starts] * len(rank) + rank[starts + length - depth], return_inverse=True)[1], levels


def common_prefixes(data: np.ndarray, levels: list[tuple[int, np.ndarray]], a: np.ndarray, b: np.ndarray, length: int) -> np.ndarray:
    """Length, ``length`` at most, of the common prefix of the suffixes at a[i]
    and b[i]: the deepest ranks that agree advance both, then single bytes."""
    n, out = len(data), np.zeros(len(a), np.int64)
    # the deepest level may fit more than once
    for depth, rank in [levels[-1]] * (length // levels[-1][0] - 1) + levels[::-1]:
        x, y = a + out, b + out
        same = (x < n) & (y < n) & (out + depth <= length)
        same[same] = rank[x[same]] == rank[y[same]]
        out[same] += depth
    for _ in range(7):
        x, y = a + out, b + out
        same = (x < n) & (y < n) & (out < length)
        same[same] = data[x[same]] == data[y[same]]
        if not same.any():
            break
        out[same] += 1
    return out


def _nearest_smaller(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each entry, the common prefix with the nearest entry before it of
    smaller position; 0 without one. ``shared[i]`` is that of i and i - 1.

    All entries look back at once. One that meets a position no smaller goes
    on from where that entry has come to: what lies between is no smaller either.
    """
    n = len(position)
    back, least = np.arange(-1, n - 1), shared.copy()
    on = np.arange(n)
    while True:
        on = on[back[on] >= 0]
        on = on[position[back[on]] >= position[on]]
        if not len(on):
            return np.where(back >= 0, least, 0)
        over = back[on]
        least[on], back[on] = np.minimum(least[on], least[over]), back[over]


def longest_previous_factors(position: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """For each entry in suffix order, the longest prefix that a suffix of
    smaller position shares: the nearest smaller ones on both sides have it.

    ``shared[i]`` is the common prefix of entries i and i - 1 (0 for the first).
    """
    after = np.concatenate([[0], shared[:0:-1]])
    return np.maximum(_nearest_smaller(position, shared), _nearest_smaller(position[::-1], after)[::-1])


def factor_matches(
    data: np.ndarray, starts: np.ndarray, position: np.ndarray, length: int
) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix of ``data`` at ``starts``, its longest factor (``length``
    at most) that starts earlier, and later, by ``position`` (equal: neither)."""
    rank, levels = suffix_ranks(data, starts, length)
    order = np.lexsort((position, rank))
    at, r = starts[order], rank[order]
    shared = np.zeros(len(order), np.int64)
    if len(order):
        equal = r[1:] == r[:-1]
        shared[1:] = length
        differ = np.flatnonzero(~equal) + 1
        shared[differ] = common_prefixes(data, levels, at[differ], at[differ - 1], length)
    earlier, later = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    earlier[order] = longest_previous_factors(position[order], shared)
    later[order] = longest_previous_factors(-position[order], shared)
    return earlier, later


def _runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of runs of True."""
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def repeated_spans(
    docs: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, group_slices: int = GROUP_SLICES
) -> DataFrame:
    """(key, start, end): byte ranges, not merged, that go from the texts of
    ``docs`` (key, doc_id, text); key is a hash of the row."""
    steps = Steps(docs.sparkSession)
    lowest = F.lit(-(1 << 63)).cast("long")
    docs = docs.select("key", F.coalesce("doc_id", lowest).alias("doc_id"), "text")

    def whole_spans(rows: DataFrame) -> DataFrame:
        """All bytes of the rows' windows."""
        return rows.select("key", F.col("ws").alias("start"), (F.col("ws") + F.col("n") + (length - 1)).alias("end"))

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            row, start, n, h, sh, sh2 = anchor_runs(data, offsets, length, gram)
            key, doc = rows.column(0).to_numpy(), rows.column(1).to_numpy()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(h.view(np.int64)),
                    pa.array(sh.view(np.int64)),
                    pa.array(sh2.view(np.int64)),
                    pa.array(key[row]),
                    pa.array(doc[row]),
                    pa.array(start, pa.int32()),
                    pa.array(n, pa.int32()),
                ],
                ["h", "sh", "sh2", "key", "doc_id", "ws", "n"],
            )

    anchors = materialize(
        docs.mapInArrow(anchor, "h long, sh long, sh2 long, key long, doc_id long, ws int, n int"), "anchors"
    )
    repeated = anchors.groupBy("h").agg(F.count(F.lit(1)).alias("of")).where("of > 1").select("h")
    live = materialize(salted_join(anchors, repeated, ["h"], "key", "left_semi"), "repeated-anchors")
    discard(anchors)
    steps.end()
    slices = materialize(
        live.groupBy("h", "sh", "sh2")
        .agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "key", "ws", "n")).alias("rep"))
        .select("h", "sh", "sh2", "c", "rep.*"),
        "slices",
    )

    # slices equal as a whole
    firsts = slices.where("c > 1").select("h", "sh", "sh2", F.col("key").alias("key1"), F.col("ws").alias("ws1"))
    copies = salted_join(live, firsts, ["h", "sh", "sh2"], "key", "inner")
    if keep_first:
        copies = copies.where("key <> key1 OR ws <> ws1")
    found = materialize(whole_spans(copies), "slice-copies")

    # anchors with several different slices
    groups = slices.groupBy("h").agg(F.count(F.lit(1)).alias("d")).where("d > 1")
    open_slices = materialize(salted_join(slices, groups, ["h"], "sh", "inner"), "open-slices")
    discard(live, slices)
    steps.end()
    wanted = open_slices.groupBy("key").agg(F.collect_list(F.struct("h", "ws", "n", "d")).alias("cuts"))
    sent = steps.send(key_filter(wanted.select("key")))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(passes(sent.value, batch.column(0).to_numpy())))

    texts = docs.mapInArrow(screen, docs.schema).dropDuplicates(["key"]).join(wanted, "key")

    def slice_rows(batch: pa.RecordBatch, hot: bool) -> Iterator[tuple]:
        for key, doc, text, cuts in zip(*(batch.column(i) for i in range(4))):
            raw = (text.as_py() or "").encode()
            for cut in cuts.as_py():
                if (cut["d"] > group_slices) == hot:
                    at, n = cut["ws"], cut["n"]
                    yield cut["h"], key.as_py(), doc.as_py(), at, n, raw[at : at + n + length - 1]

    def cut(hot: bool) -> DataFrame:
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo in range(0, len(batch), 256):
                    rows = list(zip(*slice_rows(batch.slice(lo, 256), hot)))
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, _SLICE_TYPES)], _SLICE_NAMES)

        return texts.mapInArrow(work, _SLICE_SCHEMA)

    def compare(rows: DataFrame, group: Column) -> DataFrame:
        """Spans from the slices of whole groups, each compared in one task."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: list[tuple] = []
            size = 0
            for batch in batches:
                for row in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    if size > SORT_BYTES and row[0] != held[-1][0]:
                        yield _compared(held, length, keep_first)
                        held, size = [], 0
                    held.append(row)
                    size += len(row[5])
            if held:
                yield _compared(held, length, keep_first)

        grouped = rows.select(group.alias("g"), "key", "doc_id", "ws", "n", "slice")
        return grouped.repartition("g").sortWithinPartitions("g").mapInArrow(work, "key long, start int, end int")

    def blocks(rows: DataFrame, width: int) -> DataFrame:
        """Slices cut into blocks of ``width`` windows by distance to the anchor."""

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for h, key, doc, ws, n, raw in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    for lo, hi, *names_of in _blocks(h, n, raw, length, gram, width):
                        out.append((h, key, doc, ws + lo, hi - lo, raw[lo : hi + length - 1], *names_of))
                if out:
                    types = [*_SLICE_TYPES, pa.int32(), pa.binary(), pa.binary()]
                    names = [*_SLICE_NAMES, "block", "core", "sub"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

        return rows.mapInArrow(work, f"{_SLICE_SCHEMA}, block int, core binary, sub binary")

    found = found.unionByName(materialize(compare(cut(False), F.col("h")), "slice-spans"))
    hot = materialize(cut(True), "hot-slices")
    discard(open_slices)
    steps.end()
    for width in BLOCKS:
        if hot.isEmpty():
            break
        parts = materialize(blocks(hot, width), "blocks")
        group, same = ["h", "block", "core"], ["h", "block", "core", "sub"]
        counted = materialize(
            parts.groupBy(*same)
            .agg(F.count(F.lit(1)).alias("m"), F.min(F.struct("doc_id", "key", "ws", "n", "slice")).alias("rep"))
            .select(*same, "m", "rep.*"),
            "distinct-blocks",
        )
        firsts = counted.where("m > 1").select(*same, F.col("key").alias("key1"), F.col("ws").alias("ws1"))
        copies = salted_join(parts.drop("slice"), firsts, same, "key", "inner")
        if keep_first:
            copies = copies.where("key <> key1 OR ws <> ws1")
        found = found.unionByName(materialize(whole_spans(copies), "block-copies"))
        sizes = counted.groupBy(*group).agg(F.count(F.lit(1)).alias("d")).where("d > 1")
        open_blocks = materialize(salted_join(counted, sizes, group, "sub", "inner"), "open-blocks")
        found = found.unionByName(
            materialize(compare(open_blocks.where(F.col("d") <= group_slices), F.xxhash64(*group)), "block-spans")
        )
        discard(hot, parts, counted)
        hot = materialize(open_blocks.where(F.col("d") > group_slices).select(*_SLICE_NAMES), "hot-blocks")
        discard(open_blocks)
        steps.end()
    return found


_SLICE_NAMES = ["h", "key", "doc_id", "ws", "n", "slice"]
_SLICE_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
_SLICE_SCHEMA = "h long, key long, doc_id long, ws int, n int, slice binary"


def _blocks(h: int, n: int, raw: bytes, length: int, gram: int, width: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """For each block of a slice's windows: its first window and the one after
    its last, its number, and 128-bit hashes of the bytes that all windows of a
    whole such block share and of all its bytes.

    A window's distance to the anchor is the same wherever the window occurs,
    so equal windows are in blocks of one number with equal shared bytes.
    """
    anchor = int(np.argmax(RollingHash(np.frombuffer(raw, np.uint8)).windows(gram).view(np.int64) == h))
    for block in range(max(0, anchor - n + 1) // width, anchor // width + 1):
        lo, hi = max(0, anchor - (block + 1) * width + 1), min(n, anchor - block * width + 1)
        if lo < hi:
            core = raw[anchor - block * width : anchor - (block + 1) * width + 1 + length]
            yield lo, hi, block, *(hashlib.blake2b(x, digest_size=16).digest() for x in (core, raw[lo : hi + length - 1]))


def _compared(held: list[tuple], length: int, keep_first: bool) -> pa.RecordBatch:
    """Spans of the windows of some whole groups of slices that repeat in them."""
    sizes = np.array([len(r[5]) for r in held])
    data = np.frombuffer(b"".join(r[5] for r in held), np.uint8)
    n = np.array([r[4] for r in held])
    at = np.cumsum(sizes) - sizes
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    # places in the order of (document, key, offset); dense, so equal windows compare as integers
    keys = np.array([r[1] for r in held], np.int64)
    key, doc = np.repeat(keys, n), np.repeat(np.array([r[2] for r in held], np.int64), n)
    start = np.repeat([r[3] for r in held], n) + within
    order = np.lexsort((start, key, doc))
    new = np.ones(len(order), bool)
    new[1:] = (doc[order][1:] != doc[order][:-1]) | (key[order][1:] != key[order][:-1]) | (np.diff(start[order]) != 0)
    position = np.empty(len(order), np.int64)
    position[order] = np.cumsum(new)
    earlier, later = factor_matches(data, np.repeat(at, n) + within, position, length)
    gone = (earlier if keep_first else np.maximum(earlier, later)) >= length
    owner = np.repeat(np.arange(len(held)), n)
    edge = np.concatenate([[True], owner[1:] != owner[:-1]])
    begins = np.flatnonzero(gone & (edge | ~np.concatenate([[False], gone[:-1]])))
    stops = np.flatnonzero(gone & np.concatenate([edge[1:] | ~gone[1:], [True]]))
    return pa.RecordBatch.from_arrays(
        [pa.array(keys[owner[begins]]), pa.array(start[begins], pa.int32()), pa.array(start[stops] + length, pa.int32())],
        ["key", "start", "end"],
    )


def _removed(raw: bytes, spans: list[dict]) -> tuple[int, int, bytes]:
    """Bytes removed, maximal removed runs, and what is left."""
    flags = np.zeros(len(raw) + 1, np.int64)
    np.add.at(flags, [s["start"] for s in spans], 1)
    np.add.at(flags, [s["end"] for s in spans], -1)
    gone = np.cumsum(flags[:-1]) > 0
    return int(gone.sum()), len(_runs(gone)[0]), np.frombuffer(raw, np.uint8)[~gone].tobytes()


def merged_spans(docs: DataFrame, length: int = LENGTH, keep_first: bool = False) -> DataFrame:
    """(key, spans): the distinct spans of each text that loses any, sorted. Rows
    that repeat send equal spans, which combine before their shuffle."""
    found = repeated_spans(docs, length, GRAM, keep_first, GROUP_SLICES)
    return found.groupBy("key").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))


def suffix_dedup_report(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row.

    Texts that lose nothing are hashed where they are read; only those that a
    filter of bounded size lets through travel to meet their spans.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "doc_id", "text")
    spans = materialize(merged_spans(keyed, length), "spans")
    sent = docs.sparkSession.sparkContext.broadcast(key_filter(spans.select("key")))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches):
            raw, cuts = data.tobytes(), offsets.tolist()
            more = passes(sent.value, rows.column(0).to_numpy())
            digests = [None if m else hashlib.sha256(raw[a:b]).hexdigest() for a, b, m in zip(cuts, cuts[1:], more)]
            texts = [raw[a:b] if m else None for a, b, m in zip(cuts, cuts[1:], more)]
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), rows.column(1), pa.array(np.diff(offsets)), pa.array(digests, pa.string()), pa.array(texts, pa.binary())],
                ["key", "doc_id", "n_bytes", "sha", "raw"],
            )

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sha, raw, spans in zip(*(batch.column(i) for i in (2, 3, 4))):
                if raw.is_valid:
                    removed, runs, left = _removed(raw.as_py(), spans.as_py() or [])
                    out.append((removed, runs, hashlib.sha256(left).hexdigest()))
                else:
                    out.append((0, 0, sha.as_py()))
            n, runs, digests = zip(*out) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    split = keyed.mapInArrow(first, "key long, doc_id long, n_bytes long, sha string, raw binary")
    split = split.withColumn("place", F.monotonically_increasing_id())  # repeated rows have one key
    joined = salted_join(split, spans, ["key"], "place", "left").select("doc_id", "n_bytes", "sha", "raw", "spans")
    return joined.mapInArrow(second, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
