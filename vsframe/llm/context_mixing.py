"""Language-model scoring by online logistic context mixing.

A text, A-Z lower-cased, is coded byte by byte and each byte bit by bit, most
significant first, with an end byte after the last. Five predictors see the bits
so far of the byte and its 0 to 4 bytes before, and have exact counts of the zeros
and ones that followed; their probabilities are mixed in the logistic domain by weights. Which
weight vector is used is gated by the longest context seen before, by how often
it was seen, and by the bit. A last table, by the bits so far and the mixed value,
refines the mixed probability, and adapts: after each step its cells move to the
bits that came, before the next bit is seen. The sum of log10 probabilities is a
proper score of the whole text, and gives its total bits per byte.

Predictors depend on five bytes at most, so everything is counted by distinct
five-byte grams: a shuffle sums grams over all training texts, predictors' counts
are sums over grams; weights and refining table are learned online over grams
weighted by their counts, in parallel parts whose weights and cells are averaged,
in several rounds. A gram trains with its own occurrence left out of the counts,
or long contexts would predict themselves. Counts are totals over the whole
training corpus. While scoring, nothing is learned, so that a text's score
depends on no other text to be scored.

The counts are a table of gram blocks that grows with the corpus: a block holds
all grams of some contexts of three bytes, so orders 3 and 4 are counted within
it. Orders 0 to 2 depend on three bytes, and their table, at most one row a byte
trigram, goes to every task. No two contexts ever share a count.

The base score is an add-one word model. Words counted often enough that there
can be only ``2 ** HEAVY_BITS`` of them go to every task; the others meet their
texts in a join. So it is with grams: log probabilities of the most frequent, at
most ``2 ** HEAVY_GRAM_BITS``, go to every task; other grams of the texts to be scored,
never seen ones too, meet the blocks, and what comes out joins the texts.

Rows with a null id are trained on and not held out; null texts are empty. With
no training text, counts are zero and every bit costs its untrained guess. Long
texts are scored whole, a bounded chunk or one longer text at a time; repeated
rows score alike; an empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vsframe.llm.common import RollingHash, lower_bytes, materialize, mix64, salted_join, text_chunks, word_spans

ORDERS = 5  # contexts of 0 to 4 bytes
#: Slots an order of ``SlotCounts``, for counts held in memory only.
SLOT_BITS = 20
#: Grams of a block at least, but for the last ones of a task; contexts are not
#: cut, so a block has at most 2**16 more.
BLOCK_GRAMS = 1 << 15
LOW = 3  # bytes of the grams of orders 0 to 2
#: Words with at least N / 2**HEAVY_BITS of the N training tokens go to every
#: task, so at most 2**HEAVY_BITS words, 64 MiB.
HEAVY_BITS = 22
#: Log probabilities of at most 2**HEAVY_GRAM_BITS grams go to every task, 32 MiB.
HEAVY_GRAM_BITS = 21
END, PAD = 255, 254  # bytes that UTF-8 never has
ROUNDS = 3
RATE = 0.1
BATCH = 4096
DELTA = 0.4
CONFIDENCE = 4
GATES = ORDERS * CONFIDENCE * 8
BUCKETS = 24
#: Weight that a cell of the refining table remembers: how slowly it adapts.
MEMORY = 1 << 16
#: Weight from which a cell counts.
TRUSTED = 32
#: Distinct words or grams that a counting task holds before it sends them on.
HELD = 1 << 22
#: Cached gram probabilities of a task.
CACHE_BITS = 20


def _stretch(p: np.ndarray) -> np.ndarray:
    return np.log(p / (1 - p))


def _squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def slots(grams: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """For bit ``bit`` of the grams' last byte: slots (ORDERS, n), and the bit."""
    byte = grams & np.uint64(255)
    node = (byte | np.uint64(256)) >> np.uint64(8 - bit)  # 1, then the bits so far
    out = np.empty((ORDERS, len(grams)), np.int64)
    for order in range(ORDERS):
        context = (grams >> np.uint64(8)) & np.uint64((1 << 8 * order) - 1)
        hashed = mix64((context * np.uint64(512) + node) * np.uint64(8) + np.uint64(order))
        out[order] = (order << SLOT_BITS) + (hashed >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
    return out, ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)


def _inputs(zeros: np.ndarray, ones: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretched predictions (ORDERS, n) and the gate of each."""
    n = zeros + ones
    x = _stretch((ones + DELTA) / (n + 2 * DELTA))
    seen = n > 0.5
    longest = ORDERS - 1 - np.argmax(seen[::-1], axis=0)
    longest[~seen.any(0)] = 0
    many = n[longest, np.arange(n.shape[1])]
    level = np.searchsorted([1.5, 4, 16], many)
    return x, (longest * CONFIDENCE + level) * 8 + bit


def _bucket(x: np.ndarray) -> np.ndarray:
    return np.clip(((x + 8) * (BUCKETS / 16)).astype(np.int64), 0, BUCKETS - 1)


class SlotCounts:
    """Counts hashed to a fixed number of slots; for few grams, in memory."""

    def __init__(self, zeros: np.ndarray, ones: np.ndarray):
        self.zeros, self.ones = zeros, ones

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.stack([slots(grams, bit)[0] for bit in range(8)])
        return self.zeros[at].astype(np.float64), self.ones[at].astype(np.float64)


def _sorted_sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys in order and how many occurrences lie before each and after all."""
    order = np.argsort(keys, kind="stable")
    return keys[order], np.concatenate([[0], np.cumsum(n[order])])


class ExactCounts:
    """Zeros and ones (8, ORDERS, n) that followed each bit's contexts: orders 0
    to 2 from sorted trigrams, the others from grams that hold all those with
    the contexts asked for."""

    def __init__(self, low: tuple[np.ndarray, np.ndarray], keys: np.ndarray, n: np.ndarray):
        rest = [_sorted_sums(keys & np.uint64((1 << 8 * size) - 1), n) for size in range(LOW + 1, ORDERS + 1)]
        self.low, self.rest = low, rest

    def __call__(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = np.zeros((2, 8, ORDERS, len(grams)))
        for order in range(ORDERS):
            if order >= LOW - 1:
                keys, sums = self.low if order < LOW else self.rest[order - LOW]
            else:  # short contexts: trigrams by their last bytes
                keys, n = self.low[0] & np.uint64((1 << 8 * (order + 1)) - 1), np.diff(self.low[1])
                keys, index = np.unique(keys, return_inverse=True)
                sums = np.concatenate([[0], np.cumsum(np.bincount(index, n, len(keys)))]).astype(np.int64)
            own, index = np.unique(grams & np.uint64((1 << 8 * (order + 1)) - 1), return_inverse=True)
            first = own & ~np.uint64(255)
            before = sums[np.searchsorted(keys, first)]
            after = sums[np.searchsorted(keys, first + np.uint64(256))]
            for bit in range(8):  # the range of last bytes halves with each bit
                half = np.uint64(128 >> bit)
                middle = sums[np.searchsorted(keys, first + half)]
                out[0, bit, order], out[1, bit, order] = (middle - before)[index], (after - middle)[index]
                one = (own & half) != 0
                first = np.where(one, first + half, first)
                before, after = np.where(one, middle, before), np.where(one, after, middle)
        return out[0], out[1]


def _nodes(grams: np.ndarray, bit: int) -> tuple[np.ndarray, np.ndarray]:
    """The bits before ``bit`` of the last byte, after a 1, and the bit."""
    byte = grams & np.uint64(255)
    node = ((byte | np.uint64(256)) >> np.uint64(8 - bit)).astype(np.int64)
    return node, ((byte >> np.uint64(7 - bit)) & np.uint64(1)).astype(np.int64)


def _left_out(zeros: np.ndarray, ones: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(zeros - (y == 0), 0), np.maximum(ones - (y == 1), 0)


class Model:
    """Gated weights and the refining table, over counts: slots of zeros and
    ones, or those that ``over`` puts in their place. ``seen`` is the weight that
    each cell of the table has met."""

    def __init__(self, zeros: np.ndarray | None = None, ones: np.ndarray | None = None):
        self.counts = None if zeros is None else SlotCounts(zeros, ones)
        self.weights = np.full((GATES, ORDERS), 1 / ORDERS)
        self.refine = np.full((256, BUCKETS), 0.5)
        self.seen = np.zeros((256, BUCKETS))

    def over(self, counts: ExactCounts) -> Model:
        """This model, sharing its weights and table, with other counts."""
        out = Model()
        out.counts, out.weights, out.refine, out.seen = counts, self.weights, self.refine, self.seen
        return out

    def copy(self) -> Model:
        out = Model()
        out.weights, out.refine, out.seen = self.weights.copy(), self.refine.copy(), self.seen.copy()
        return out

    def learn(self, grams: np.ndarray, counts: np.ndarray) -> None:
        """One online pass: for each batch and bit, a step of the weights down
        the coding cost's gradient, then one of the refining table."""
        every_zero, every_one = self.counts(grams)
        for lo in range(0, len(grams), BATCH):
            here = slice(lo, lo + BATCH)
            part, weight = grams[here], counts[here].astype(np.float64)
            for bit in range(8):
                node, y = _nodes(part, bit)
                x, gate = _inputs(*_left_out(every_zero[bit][:, here], every_one[bit][:, here], y), bit)
                mixed = (self.weights[gate].T * x).sum(0)
                error = (y - _squash(mixed)) * weight
                total = np.bincount(gate, weight, GATES)
                for k in range(ORDERS):
                    slope = np.bincount(gate, error * x[k], GATES) / np.maximum(total, 1)
                    self.weights[:, k] += RATE * slope
                self._adapt(node * BUCKETS + _bucket(np.clip(mixed, -12, 12)), y, weight)

    def _adapt(self, cell: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Cells move to the bits that came, by their weight against what the cells remember."""
        cells, index = np.unique(cell, return_inverse=True)
        came, ones = np.bincount(index, weight), np.bincount(index, weight * y)
        known = np.minimum(self.seen.flat[cells], MEMORY) + 1.0
        self.refine.flat[cells] = (self.refine.flat[cells] * known + ones) / (known + came)
        self.seen.flat[cells] += came

    def mixed(self, zeros: np.ndarray, ones: np.ndarray, bit: int) -> np.ndarray:
        x, gate = _inputs(zeros, ones, bit)
        return np.clip((self.weights[gate].T * x).sum(0), -12, 12)

    def log10(self, grams: np.ndarray) -> np.ndarray:
        """log10 probability of each gram's last byte after the others."""
        out = np.zeros(len(grams))
        zeros, ones = self.counts(grams)
        for bit in range(8):
            node, y = _nodes(grams, bit)
            x = self.mixed(zeros[bit], ones[bit], bit)
            bucket = _bucket(x)
            p = _squash(x)
            p = np.where(self.seen[node, bucket] >= TRUSTED, (p + self.refine[node, bucket]) / 2, p)
            out += np.log10(np.where(y == 1, p, 1 - p))
        return out


def text_grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The five-byte gram of each byte and each text's end, and n + 1 offsets."""
    pads = ORDERS - 1
    rows = len(offsets) - 1
    with_ends = np.insert(data, offsets[1:], END)
    bounds = offsets + np.arange(rows + 1)
    padded = np.insert(with_ends, np.repeat(bounds[:-1], pads), PAD).astype(np.uint64)
    grams = padded[:-pads].copy()
    for j in range(1, pads + 1):
        grams = grams << np.uint64(8) | padded[j : len(padded) - pads + j]
    keep = np.ones(len(grams), bool)  # a gram that ends in a pad predicts nothing
    begin = bounds[1:-1] + pads * np.arange(1, rows)
    for j in range(pads):
        keep[begin - pads + j] = False
    return grams[keep], bounds


def _tally(values: list[np.ndarray], weights: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    distinct, index = np.unique(np.concatenate(values), return_inverse=True)
    return distinct, np.bincount(index, np.concatenate(weights), len(distinct)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, key, n): 0 words, 1 grams, 2 texts, summed for some chunks at a
    time; no more than about ``HELD`` of a kind are held."""
    held: dict[int, tuple[list, list]] = {0: ([], []), 1: ([], [])}
    texts = 0

    def flush(least: int) -> Iterator[pa.RecordBatch]:
        for kind, (values, weights) in held.items():
            if values and sum(map(len, values)) > least:
                keys, n = _tally(values, weights)
                values[:], weights[:] = [keys], [n]
                if len(keys) > least // 2:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(n)], ["kind", "key", "n"]
                    )
                    values.clear()
                    weights.clear()

    for _, data, offsets in text_chunks(batches):
        data = lower_bytes(data)
        starts, ends, _ = word_spans(data, offsets)
        for kind, all_keys in ((0, RollingHash(data).slices(starts, ends)), (1, text_grams(data, offsets)[0])):
            keys, n = np.unique(all_keys, return_counts=True)
            held[kind][0].append(keys)
            held[kind][1].append(n)
        texts += len(offsets) - 1
        yield from flush(HELD)
    yield from flush(0)
    yield pa.RecordBatch.from_arrays(
        [pa.array([2], pa.int32()), pa.array([0], pa.int64()), pa.array([texts], pa.int64())], ["kind", "key", "n"]
    )


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, key, n) of all words, grams and texts of ``texts`` (text)."""
    parts = texts.select("text").mapInArrow(_count, "kind int, key long, n long")
    return materialize(parts.groupBy("kind", "key").agg(F.sum("n").alias("n")), "corpus-counts")


_BLOCK = "keys binary, n binary"


def gram_blocks(grams: DataFrame) -> DataFrame:
    """Blocks (keys, n) of the rows of ``grams`` (key, n), as bytes of int64; all
    rows of one context of three bytes are in one block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def block(keys: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([keys.tobytes()]), pa.array([n.tobytes()])], ["keys", "n"])

        size = 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += len(batch)
            if size >= BLOCK_GRAMS:
                keys, n = (np.concatenate(x) for x in zip(*held))
                context = keys & 0xFFFFFF00
                cut = int(np.argmax(context == context[-1]))  # the last context may go on; rows are sorted by it
                if cut:
                    yield block(keys[:cut], n[:cut])
                held, size = [(keys[cut:], n[cut:])], len(keys) - cut
        if size:
            yield block(*(np.concatenate(x) for x in zip(*held)))

    context = F.col("key").bitwiseAND(F.lit(0xFFFFFF00).cast("long"))
    dealt = grams.select("key", "n", context.alias("c")).repartition("c").sortWithinPartitions("c")
    return dealt.select("key", "n").mapInArrow(work, _BLOCK)


def _blocks_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    for batch in batches:
        for keys, n in zip(batch.column(0), batch.column(1)):
            yield np.frombuffer(keys.as_py(), np.uint64), np.frombuffer(n.as_py(), np.int64)


def low_counts(grams: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted trigrams and sums for orders 0 to 2: at most 2**24, a few million in UTF-8."""
    found = grams.groupBy(F.col("key").bitwiseAND(F.lit((1 << 8 * LOW) - 1)).alias("key")).agg(F.sum("n").alias("n")).toArrow()
    return _sorted_sums(found.column(0).to_numpy().view(np.uint64), found.column(1).to_numpy())


class Trained:
    """The fitted model, with the grams it counts: their blocks, a table; and the
    trigrams, a broadcast of bounded size."""

    def __init__(self, model: Model, blocks: DataFrame, low):
        self.model, self.blocks, self.low = model, blocks, low

    def log10(self, blocks: DataFrame, least: int) -> DataFrame:
        """(key, logp) of the grams in ``blocks`` with n of at least ``least``,
        or, where that is 0, of those with n of 0."""
        model, low = self.model, self.low

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for keys, n in _blocks_of(batches):
                wanted = keys[n >= least] if least else keys[n == 0]
                if len(wanted):
                    found = model.over(ExactCounts(low.value, keys, n)).log10(wanted)
                    yield pa.RecordBatch.from_arrays([pa.array(wanted.view(np.int64)), pa.array(found)], ["key", "logp"])

        return blocks.mapInArrow(work, "key long, logp double")


def train(counts: DataFrame) -> Trained:
    """Fit the mixing model to the grams in ``counts`` (corpus_counts)."""
    grams = counts.where("kind = 1").select("key", "n")
    blocks = materialize(gram_blocks(grams), "gram-blocks")
    low = counts.sparkSession.sparkContext.broadcast(low_counts(grams))
    model = Model()

    for _ in range(ROUNDS):

        def work(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            own, bits = model.copy(), 0
            for keys, n in _blocks_of(batches):
                own.counts = ExactCounts(low.value, keys, n)
                order = np.argsort(mix64(keys), kind="stable")  # a fixed shuffle
                own.learn(keys[order], n[order])
                bits += len(keys)
            if bits:
                gained = (own.seen - model.seen).ravel()  # by which cells are averaged
                met = np.flatnonzero(gained)
                values = np.concatenate([own.weights.ravel(), own.refine.ravel()[met]])
                share = np.concatenate([np.full(own.weights.size, float(bits)), gained[met]])
                at = np.concatenate([np.arange(own.weights.size), own.weights.size + met])
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(values * share), pa.array(share)], ["at", "w", "n"])

        means = blocks.mapInArrow(work, "at int, w double, n double").groupBy("at").agg(F.sum("w").alias("w"), F.sum("n").alias("n"))
        model = model.copy()
        for row in means.collect():  # GATES * ORDERS weights, 256 * BUCKETS cells
            at = row["at"] - model.weights.size
            if at < 0:
                model.weights.flat[row["at"]] = row["w"] / row["n"]
            else:
                model.refine.flat[at], model.seen.flat[at] = row["w"] / row["n"], row["n"]
    return Trained(model, blocks, low)


def heavy_least(grams: DataFrame) -> int:
    """A count that at most 2**HEAVY_GRAM_BITS grams reach: the least power of two, or 1."""
    by_size = grams.groupBy(F.length(F.bin("n")).alias("bits")).agg(F.count(F.lit(1)).alias("c")).collect()
    least, total = 63, 0
    sizes = {r.bits: r.c for r in by_size}
    while least and total + sizes.get(least, 0) <= 1 << HEAVY_GRAM_BITS:
        total += sizes.get(least, 0)
        least -= 1
    return 1 << least


class _Scorer:
    """Log probabilities of known grams, with a direct-mapped cache; NaN for others."""

    def __init__(self, known: np.ndarray, logs: np.ndarray):
        self.known, self.logs = known, logs
        self.keys = np.full(1 << CACHE_BITS, np.uint64(2**64 - 1), np.uint64)
        self.values = np.zeros(1 << CACHE_BITS)

    def score(self, grams: np.ndarray) -> np.ndarray:
        """In slices, which bound the temporaries."""
        return np.concatenate([self._score(grams[i : i + (1 << 18)]) for i in range(0, max(1, len(grams)), 1 << 18)])

    def _score(self, grams: np.ndarray) -> np.ndarray:
        place = (mix64(grams) >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        out = self.values[place]
        miss = np.flatnonzero(self.keys[place] != grams)
        if len(miss):
            distinct, first, index = np.unique(grams[miss], return_index=True, return_inverse=True)
            found = np.full(len(distinct), np.nan)
            if len(self.known):
                at = np.minimum(np.searchsorted(self.known, distinct), len(self.known) - 1)
                found = np.where(self.known[at] == distinct, self.logs[at], np.nan)
            out[miss] = found[index]
            self.keys[place[miss][first]] = distinct
            self.values[place[miss][first]] = found
        return out


_PART = "kind int, word long, rid long, tf long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, coded long"


def score_texts(docs: DataFrame, counts: DataFrame, model: Trained) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score,
    bits_per_byte (the end byte is one of them) for each row of ``docs`` (doc_id,
    text, held_out)."""
    spark = docs.sparkSession
    words = counts.where("kind = 0")
    stats = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    texts = counts.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tokens, distinct = stats.n + texts, stats.v + (1 if texts else 0)
    least = max(1, -(-tokens // (1 << HEAVY_BITS)))
    heavy = words.where(F.col("n") >= least).select("key", "n").toArrow()
    keys = heavy.column(0).to_numpy()
    order = np.argsort(keys)
    grams = counts.where("kind = 1").select("key", "n")
    frequent = model.log10(model.blocks, heavy_least(grams)).toArrow()
    logs = frequent.column(0).to_numpy().view(np.uint64), frequent.column(1).to_numpy()
    by_key = np.argsort(logs[0])
    sent = spark.sparkContext.broadcast((keys[order], heavy.column(1).to_numpy()[order], logs[0][by_key], logs[1][by_key]))
    lowest = float(np.log10(float(tokens + 1 * (distinct + 1))))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, *logs = sent.value
        scorer = _Scorer(*logs)
        names = [f.split()[0] for f in _PART.split(", ")]
        for rows, data, offsets in text_chunks(batches):
            data = lower_bytes(data)
            starts, ends, counts = word_spans(data, offsets)
            hashes = RollingHash(data).slices(starts, ends).view(np.int64)
            word, index = np.unique(hashes, return_inverse=True)
            at = np.minimum(np.searchsorted(known, word), max(0, len(known) - 1))
            hit = known[at] == word if len(known) else np.zeros(len(word), bool)
            c = np.where(hit, n[at], 0) if len(known) else np.zeros(len(word), np.int64)
            row = np.repeat(np.arange(len(counts)), counts)
            heavy_here = hit[index]
            size = len(counts)
            base = np.bincount(row[heavy_here], np.log10(c[index][heavy_here] + 1.0), size) + np.log10(texts + 1.0)
            n_known = np.bincount(row[heavy_here], minlength=size) + (1 if texts else 0)
            grams, bounds = text_grams(data, offsets)
            found = scorer.score(grams)
            rare = np.flatnonzero(np.isnan(found))
            found[rare] = 0
            sums = np.concatenate([[0], np.cumsum(found)])
            rid = rows.column(0).to_numpy()
            none = np.zeros(size, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.zeros(size, np.int32)),
                    pa.array(mix64(rid.view(np.uint64)).view(np.int64)),  # spreads rows; their tf of 0 counts nothing
                    rows.column(0),
                    pa.array(none),
                    rows.column(1),
                    rows.column(3),
                    pa.array(counts + 1),
                    pa.array(n_known),
                    pa.array(base),
                    pa.array(np.diff(sums[bounds])),
                    pa.array(np.diff(bounds)),
                ],
                names,
            )
            other, index_of = np.unique(grams[rare], return_inverse=True)
            owner = np.searchsorted(bounds, rare, "right") - 1
            for kind, of, which, names_of in ((0, row[~heavy_here], index[~heavy_here], word), (1, owner, index_of, other.view(np.int64))):
                pair, tf = np.unique(of * max(1, len(names_of)) + which, return_counts=True)
                if len(pair):
                    of, which = np.divmod(pair, max(1, len(names_of)))
                    nulls = [pa.nulls(len(pair), t) for t in (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64())]
                    kinds = pa.array(np.full(len(pair), kind, np.int32))
                    yield pa.RecordBatch.from_arrays([kinds, pa.array(names_of[which]), pa.array(rid[of]), pa.array(tf), *nulls], names)

    ordered = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "held_out")
    parts = materialize(ordered.mapInArrow(work, _PART), "score-parts")
    wanted = parts.where("kind = 1").select(F.col("word").alias("key")).distinct().withColumn("n", F.lit(0).cast("long"))
    # written in between, or each task would keep two Python workers
    scored = model.log10(materialize(gram_blocks(grams.unionByName(wanted)), "wanted-blocks"), 0)
    of_grams = salted_join(parts.where("kind = 1").withColumnRenamed("word", "key"), scored, ["key"], "rid", "inner")
    rare = words.where(F.col("n") < least).select(F.col("key").alias("word"), F.col("n").alias("c"))
    joined = parts.where("kind = 0").join(rare, "word", "left")
    c = F.coalesce("c", F.lit(0))
    columns = ["rid", "doc_id", "held_out", "n_tokens", "coded"]
    of_words = joined.select(
        *columns,
        (F.coalesce("n_known", F.lit(0)) + F.when(c > 0, F.col("tf")).otherwise(0)).alias("n_known"),
        (F.coalesce("base", F.lit(0.0)) + F.col("tf") * F.log10(c + 1.0)).alias("base"),
        "score",
    )
    of_grams = of_grams.select(*columns, "n_known", "base", (F.col("tf") * F.col("logp")).alias("score"))
    rows = of_words.unionByName(of_grams).groupBy("rid").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.max("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.sum("base").alias("base"),
        F.sum("score").alias("score"),
        F.max("coded").alias("coded"),
    )
    return rows.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * F.lit(lowest)).alias("base_score"),
        "score",
        (F.col("score") * F.lit(float(-np.log2(10))) / F.col("coded")).alias("bits_per_byte"),
    )


def scoring_report(docs: DataFrame) -> DataFrame:
    """Scores of all rows; learns from those whose crc32(doc_id) mod 7 is not 2."""
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", held.alias("held_out"))
    counts = corpus_counts(docs.where(~F.col("held_out")))
    return score_texts(docs, counts, train(counts))
