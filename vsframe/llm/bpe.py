"""Byte-level BPE encoding and decoding, vectorised over whole chunks of text.

Pre-tokenisation uses no regular expression. Every code point becomes a class
(letter, number, white space, ...); classes are symbols of a small automaton
whose states say what kind of token is open. A symbol is a function from state
to state; functions compose associatively, so a scan over stretches of symbols
gives every stretch's state at its start, and one more pass the boundaries.
The slices between boundaries are merged by rank, each distinct slice once
while it stays in a bounded cache; token offsets are kept for decoding.

The automaton is that of the pattern
``'s|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+``.
Null texts count as empty; an empty text has no tokens. Repeated rows are encoded
and returned each, long texts whole (one text longer than a chunk is a chunk of its
own), and an empty table gives no rows. Columns named like those added are replaced.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from vsframe.llm.common import text_chunks

# Classes of code points, and symbols that also know what follows.
LETTER, NUMBER, OTHER, SPACE, WHITE = range(5)
MARK, SHORT, LONG, LAST_SPACE, LAST_WHITE = range(5, 10)  # ' before no suffix, 1-, 2-letter suffix; last white of a run
_SYMBOLS = 10
# States: what token is open when a symbol arrives.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, AFTER_SPACE, IN_WHITE, SUFFIX1, SUFFIX2 = range(8)
#: Unicode's White_Space property.
WHITE_SPACE = (9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
#: Code points that one lane of the scan covers.
LANE = 256
#: Distinct slices whose merges are remembered, and the longest that merge_many gets.
CACHE_SLICES, CACHE_BYTES = 400_000, 64


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and boundary[symbol, state]; symbols from _SYMBOLS
    on are the same at the start of a text, where the state is FRESH."""
    after = np.zeros((_SYMBOLS, 8), np.uint8)
    cut = np.ones((_SYMBOLS, 8), bool)
    own = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, MARK: IN_OTHER, SHORT: IN_OTHER, LONG: IN_OTHER}
    for symbol in range(_SYMBOLS):
        if symbol in own:
            after[symbol] = {SHORT: SUFFIX1, LONG: SUFFIX2}.get(symbol, own[symbol])
            for state in (own[symbol], AFTER_SPACE):  # the open token takes it
                after[symbol, state], cut[symbol, state] = own[symbol], False
        elif symbol in (SPACE, WHITE):
            after[symbol], cut[symbol, IN_WHITE] = IN_WHITE, False
        else:
            after[symbol] = AFTER_SPACE if symbol == LAST_SPACE else FRESH
        after[symbol, SUFFIX2], after[symbol, SUFFIX1] = SUFFIX1, FRESH
        cut[symbol, [SUFFIX1, SUFFIX2]] = False
    first = np.repeat(after[:, :1], 8, 1), np.ones((_SYMBOLS, 8), bool)
    return np.concatenate([after, first[0]]), np.concatenate([cut, first[1]])


_NEXT, _CUT = _automaton()


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    table = np.array([kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    table[list(WHITE_SPACE)] = WHITE
    table[32] = SPACE
    return table


def token_starts(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Boundaries before each code point; ``firsts`` are the texts' first ones."""
    n = len(points)
    symbols = _classes()[points]
    ends = np.zeros(n + 1, bool)  # a text ends before this place
    ends[firsts] = ends[n] = True
    white = symbols >= SPACE
    solid_next = np.zeros(n, bool)
    solid_next[:-1] = ~white[1:]
    symbols[white & solid_next & ~ends[1:]] += LAST_SPACE - SPACE
    at = np.flatnonzero(points == 39)
    if len(at):
        padded = np.concatenate([points, np.zeros(2, np.uint32)])
        one, two = padded[at + 1], padded[at + 2]
        ends = np.concatenate([ends, [True]])
        one[ends[at + 1]] = 0
        two[ends[at + 1] | ends[at + 2]] = 0
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = np.zeros(len(at), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        symbols[at] = np.where(short, SHORT, np.where(long, LONG, MARK))
    symbols[firsts] += _SYMBOLS

    lanes = -(-n // LANE)
    grid = np.full(lanes * LANE, OTHER, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(lanes, LANE).T).astype(np.int64) * 8
    flat = _NEXT.ravel()
    whole = np.repeat(np.arange(8, dtype=np.uint8)[None, :], lanes, 0)  # each lane's function of its first state
    for step in grid:
        whole = flat[step[:, None] + whole]
    reach = 1
    while reach < lanes:  # inclusive scan: whole[i] composes lanes 0..i
        whole[reach:] = np.take_along_axis(whole[reach:], whole[:-reach].astype(np.int64), 1)
        reach *= 2
    state = np.zeros(lanes, np.uint8)
    state[1:] = whole[:-1, FRESH]
    cuts, out = _CUT.ravel(), np.empty((LANE, lanes), bool)
    for i, step in enumerate(grid):
        place = step + state
        out[i] = cuts[place]
        state = flat[place]
    return out.T.ravel()[:n]


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its id."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


class Vocabulary:
    """Ranks of a byte-level BPE, with a bounded cache of merged slices."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        size = max(ranks.values()) + 1
        self.lengths = np.zeros(size, np.int64)
        self.at = np.zeros(size, np.int64)
        blob, place = [], 0
        for token, rank in ranks.items():
            self.at[rank], self.lengths[rank] = place, len(token)
            blob.append(token)
            place += len(token)
        self.bytes = np.frombuffer(b"".join(blob), np.uint8)
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        # every way to write a token as two tokens: (left, right) -> token
        pairs = {
            (ranks[token[:i]], ranks[token[i:]]): rank
            for token, rank in ranks.items()
            for i in range(1, len(token))
            if token[:i] in ranks and token[i:] in ranks
        }
        self.none = size
        self._fill_table(np.array(list(pairs), np.uint64).reshape(-1, 2), np.array(list(pairs.values()), np.int64))
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[bytes, int] = {}  # slice -> entry
        self.entry_at, self.entry_size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.entry_ids = np.zeros(0, np.int64)

    def _fill_table(self, pairs: np.ndarray, merged: np.ndarray) -> None:
        """An open hash table of pairs, at most a quarter full."""
        keys = pairs[:, 0] << np.uint64(32) | pairs[:, 1]
        bits = max(4, int(4 * len(keys)).bit_length())
        self._shift, self._last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, np.uint64(1 << 63), np.uint64)
        self.values = np.full(1 << bits, self.none, np.int64)
        place = self._place(keys)
        while len(keys):
            free = self.keys[place] == np.uint64(1 << 63)
            slot, first = np.unique(np.where(free, place, -1), return_index=True)
            first = first[slot >= 0]
            self.keys[place[first]], self.values[place[first]] = keys[first], merged[first]
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, merged, place = keys[left], merged[left], (place[left] + 1) & self._last

    def _place(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Token that each pair of tokens forms, or ``none``."""
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        place = self._place(keys)
        out = np.full(len(keys), self.none, np.int64)
        todo = np.arange(len(keys))
        while len(todo):
            there = self.keys[place]
            same = there == keys[todo]
            out[todo[same]] = self.values[place[same]]
            on = ~same & (there != np.uint64(1 << 63))
            todo, place = todo[on], (place[on] + 1) & self._last
        return out

    def merge_many(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces and how many each has. In every piece at once the
        pair of least rank, leftmost first, joins, until none can."""
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ids = self.single[np.frombuffer(b"".join(pieces), np.uint8)]
        owner = np.repeat(np.arange(len(pieces)), sizes)

        def ranked(at: np.ndarray) -> np.ndarray:
            """Ranks of the pairs that begin at ``at``."""
            out = np.full(len(at), self.none, np.int64)
            two = at + 1 < len(ids)
            two[two] = owner[at[two]] == owner[at[two] + 1]
            out[two] = self._joined(ids[at[two]], ids[at[two] + 1])
            return out

        rank = ranked(np.arange(len(ids)))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            firsts = np.flatnonzero(np.diff(owner, prepend=-1))
            least = np.minimum.reduceat(rank, firsts)
            each = np.repeat(least, np.diff(firsts, append=len(ids)))
            over = each == self.none
            if over.any():
                done.append((owner[over], ids[over]))
                ids, owner, rank, each = ids[~over], owner[~over], rank[~over], each[~over]
            at = np.flatnonzero(rank == each)
            at = at[np.diff(owner[at], prepend=-1) != 0]
            if not len(at):
                break
            ids[at] = rank[at]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, owner, rank = ids[keep], owner[keep], rank[keep]
            at -= np.arange(len(at))
            rank[at] = ranked(at)
            left = at[at > 0] - 1
            rank[left] = ranked(left)
        owners = np.concatenate([o for o, _ in done]) if done else owner
        found = np.concatenate([i for _, i in done]) if done else ids
        order = np.argsort(owners, kind="stable")
        return found[order], np.bincount(owners, minlength=len(pieces))

    def _entries(self, pieces: list[bytes]) -> np.ndarray:
        """Cache entries of the pieces, merging those that it lacks."""
        new = set(pieces).difference(self.cache)
        if new and len(self.cache) + len(new) > CACHE_SLICES:
            self._forget()
            new = set(pieces)
        if new:
            short = [p for p in new if len(p) <= CACHE_BYTES]
            ids, sizes = self.merge_many(short)
            long = [p for p in new if len(p) > CACHE_BYTES]
            more = [self._merge_long(p) for p in long]
            sizes = np.concatenate([sizes, np.array([len(m) for m in more], np.int64)])
            at = len(self.entry_ids) + np.cumsum(sizes) - sizes
            self.cache.update(zip([*short, *long], range(len(self.entry_at), len(self.entry_at) + len(new))))
            self.entry_ids = np.concatenate([self.entry_ids, ids, *(np.array(m, np.int64) for m in more)])
            self.entry_at = np.concatenate([self.entry_at, at])
            self.entry_size = np.concatenate([self.entry_size, sizes])
        return np.fromiter(map(self.cache.__getitem__, pieces), np.int64, len(pieces))

    def _merge_long(self, piece: bytes) -> list[int]:
        """Ids of one long piece, with a heap and linked neighbours: n log n."""
        ranks, n = self.ranks, len(piece)
        ends, left, right = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))

        def pair(i: int) -> int | None:
            return ranks.get(piece[i : ends[right[i]]]) if right[i] < n else None

        heap = [(r, i) for i in range(n) if (r := pair(i)) is not None]
        heapq.heapify(heap)
        gone = bytearray(n)
        while heap:
            rank, i = heapq.heappop(heap)
            if gone[i] or pair(i) != rank:
                continue
            j = right[i]
            gone[j], ends[i], right[i] = 1, ends[j], right[j]
            if right[i] < n:
                left[right[i]] = i
            for k in (left[i], i):
                if k >= 0 and (r := pair(k)) is not None:
                    heapq.heappush(heap, (r, k))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : ends[i]]])
            i = right[i]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and n + 1 offsets of each text's ids."""
        raw = data.tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        if not len(points):
            return np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
        lead = np.flatnonzero((data & 0xC0) != 0x80)
        full = offsets[:-1][np.diff(offsets) > 0]
        starts = lead[token_starts(points, np.searchsorted(lead, full))]
        cuts = starts.tolist()
        cuts.append(len(raw))
        entries = self._entries(list(map(raw.__getitem__, map(slice, cuts, cuts[1:]))))
        counts = self.entry_size[entries]
        source = np.repeat(self.entry_at[entries] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        ids = self.entry_ids[source]
        if len(self.cache) > CACHE_SLICES or len(self.entry_ids) > 16 * CACHE_SLICES:
            self._forget()  # one chunk had more than the cache may keep
        before = np.concatenate([[0], np.cumsum(counts)])
        return ids, before[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of the ids, and len(ids) + 1 byte offsets of the tokens."""
        sizes = self.lengths[ids]
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        source = np.repeat(self.at[ids] - offsets[:-1], sizes) + np.arange(offsets[-1])
        return self.bytes[source], offsets


@functools.cache
def _vocabulary(path: str) -> Vocabulary:
    return Vocabulary(load_ranks(path))


def encode(docs: DataFrame, ranks_path: str, text_col: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with a column of token ids (array<int>), replacing one of that name."""
    kept = docs.drop(out)
    schema = T.StructType([*kept.schema, T.StructField(out, T.ArrayType(T.IntegerType()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks_path)
        for rows, data, offsets in text_chunks(batches, text_col):
            ids, cuts = vocabulary.encode(data, offsets)
            tokens = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*rows.columns, tokens], schema.names)

    return kept.mapInArrow(work, schema)


def decode(tokens: DataFrame, ranks_path: str, ids_col: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``tokens`` with the decoded bytes of its ids (binary); null ids give no bytes."""
    kept = tokens.drop(out)
    schema = T.StructType([*kept.schema, T.StructField(out, T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks_path)
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids_col))
            ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            sizes = pc.fill_null(lists.value_lengths(), 0).to_numpy()
            data, offsets = vocabulary.decode(ids)
            raw, at = data.tobytes(), offsets[np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])].tolist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([raw[a:b] for a, b in zip(at, at[1:])], pa.binary())], schema.names
            )

    return kept.mapInArrow(work, schema)


def round_trip(docs: DataFrame, ranks_path: str, text_col: str = "text", packed: str | None = None) -> DataFrame:
    """Every row of ``docs`` without its text, plus n_tokens, ids_sha256 and
    decoded_sha256 (columns of these names are replaced).

    Encodes, then decodes the ids, a bounded chunk at a time. Decoded bytes do
    not travel; ids do where ``packed`` names a column for them, 32-bit
    little-endian integers in one binary value.
    """
    out = {"n_tokens": T.LongType(), "ids_sha256": T.StringType(), "decoded_sha256": T.StringType()}
    if packed:
        out[packed] = T.BinaryType()
    kept = docs.drop(*out)
    fields = [f for f in kept.schema if f.name != text_col]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in out.items())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(ranks_path)
        names = [str(i) for i in range(len(vocabulary.lengths))]
        for rows, data, offsets in text_chunks(batches, text_col):
            ids, cuts = vocabulary.encode(data, offsets)
            back, places = vocabulary.decode(ids)
            words, raw = list(map(names.__getitem__, ids.tolist())), back.tobytes()
            at, where = cuts.tolist(), places[cuts].tolist()
            more = []
            if packed:
                flat = ids.astype("<u4").tobytes()
                more = [pa.array([flat[4 * a : 4 * b] for a, b in zip(at, at[1:])], pa.binary())]
            yield pa.RecordBatch.from_arrays(
                [
                    *(rows.column(rows.schema.get_field_index(f.name)) for f in fields),
                    pa.array(np.diff(cuts)),
                    pa.array([hashlib.sha256(" ".join(words[a:b]).encode()).hexdigest() for a, b in zip(at, at[1:])]),
                    pa.array([hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(where, where[1:])]),
                    *more,
                ],
                schema.names,
            )

    return kept.mapInArrow(work, schema)
