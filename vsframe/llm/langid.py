"""Language identification with hyperdimensional profiles.

Every letter has a random +-1 vector, made from its code point, so no alphabet
is stored. A trigram binds its letters by multiplying their vectors, permuted
(rolled) by place; a text bundles (sums) its trigram vectors; a language's
prototype is the bundle of its training texts. A text gets the language whose
prototype has the largest cosine.

Upper-case letters count as lower-case ones, each run of other characters as
one gap symbol, as does either end of the text. A null or letterless text, and
any text when there is nothing to learn from, is ``und`` with score 0. Ties go
to the smallest language value. Rows with a null id are never learned from by
the query, whose folds need one. Repeated rows are learned from and returned each;
long texts count whole, whatever their alphabet; an empty table gives no rows.
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vsframe.llm.common import mix64, text_chunks

#: Components of every vector.
DIMENSIONS = 1024
#: Bound on learned languages: the prototypes, 8 KiB each, go to every task.
MAX_LANGUAGES = 10_000
#: Trigrams whose vectors are held at once; bounds memory for any alphabet.
GRAM_BLOCK = 4096
UNKNOWN = "und"
#: A text is implausible in any learned language from this many times the usual
#: noise on, less a slack of so many deviations of two random vectors' cosine.
WIDE, SLACK = 8.0, 3.0
#: Trigrams that a text must have to be judged; shorter ones score as low as junk.
MIN_TRIGRAMS = 64


@functools.cache
def _letters() -> np.ndarray:
    """For each code point its lower-cased letter, or 0 if it is no letter."""
    table = np.zeros(sys.maxunicode + 1, np.uint32)
    for c in range(sys.maxunicode + 1):
        if unicodedata.category(char := chr(c))[0] == "L":
            lowered = char.lower()
            table[c] = ord(lowered) if len(lowered) == 1 else c
    return table


def letter_vectors(symbols: np.ndarray) -> np.ndarray:
    """(len(symbols), DIMENSIONS) random signs, a function of the symbol alone."""
    words = mix64(
        symbols.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15)
        + mix64(np.arange(1, DIMENSIONS // 64 + 1, dtype=np.uint64))[None, :]
    )
    bits = np.unpackbits(words.view(np.uint8), axis=1)
    return bits.astype(np.int8) * 2 - 1


class Trigrams:
    """Counts of the distinct trigrams of each row of a chunk of texts."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
        ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        letters = _letters()[points]
        rows = len(offsets) - 1
        # a gap before and after every row, then one gap for each run of gaps
        symbols = np.insert(letters, np.repeat(ends, 2)[1:-1], 0)
        owner = np.repeat(np.arange(rows), np.diff(ends) + 2)
        keep = np.ones(len(symbols), bool)
        keep[1:] = (symbols[1:] != 0) | (symbols[:-1] != 0) | (owner[1:] != owner[:-1])
        symbols, owner = symbols[keep], owner[keep]
        self.symbols, index = np.unique(symbols, return_inverse=True)
        self.base = len(self.symbols)
        inside = owner[2:] == owner[:-2]
        grams = ((index[:-2] * self.base + index[1:-1]) * self.base + index[2:])[inside]
        # (row, gram) as one number; where that would pass 64 bits, grams are numbered first
        known, width = None, self.base**3
        if rows * width >= 1 << 63:
            known, grams = np.unique(grams, return_inverse=True)
            width = len(known)
        pairs, self.counts = np.unique(owner[:-2][inside] * width + grams, return_counts=True)
        self.rows, self.grams = np.divmod(pairs, max(1, width))
        if known is not None:
            self.grams = known[self.grams]
        self.cuts = np.searchsorted(self.rows, np.arange(rows + 1))

    def vectors(self, grams: np.ndarray, letters: np.ndarray) -> np.ndarray:
        ab, c = np.divmod(grams, self.base)
        a, b = np.divmod(ab, self.base)
        return np.roll(letters, 2, 1)[a] * np.roll(letters, 1, 1)[b] * letters[c]

    def bundle(self, groups: list[np.ndarray]) -> np.ndarray:
        """One summed vector for each group of entries (index arrays)."""
        letters = letter_vectors(self.symbols)
        out = np.zeros((len(groups), DIMENSIONS), np.float32)
        distinct, index = np.unique(self.grams, return_inverse=True)
        weights = self.counts.astype(np.float32)
        small = len(distinct) <= 2 * GRAM_BLOCK
        table = self.vectors(distinct, letters).astype(np.float32) if small else None
        for k, entries in enumerate(groups):
            for lo in range(0, len(entries), GRAM_BLOCK):
                part = entries[lo : lo + GRAM_BLOCK]
                rows = table[index[part]] if small else self.vectors(self.grams[part], letters).astype(np.float32)
                out[k] += weights[part] @ rows
        return out


def train_prototypes(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and their bundled vectors, learned from all of ``docs``.

    Each task sends one vector a language; the sums combine before the shuffle.
    """

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for rows, data, offsets in text_chunks(batches, "text"):
            grams = Trigrams(data, offsets)
            langs, owner = np.unique(np.array(rows.column(1).to_pylist(), object).astype(str), return_inverse=True)
            order = np.argsort(owner[grams.rows], kind="stable")
            cuts = np.searchsorted(owner[grams.rows][order], np.arange(len(langs) + 1))
            # one entry for each (language, trigram) of the chunk
            for lang, vector in zip(langs, grams.bundle([order[a:b] for a, b in zip(cuts, cuts[1:])])):
                sums[lang] = sums.get(lang, 0) + np.rint(vector).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(sums)), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))], ["lang", "v"]
            )

    parts = (
        docs.select(F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
        .where("lang IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(partial, "lang string, v array<long>")
    )
    sums = (
        parts.select("lang", F.posexplode("v").alias("at", "x"))
        .groupBy("lang", "at")
        .agg(F.sum("x").alias("x"))
        .groupBy("lang")
        .agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("v"))
        .select("lang", F.col("v.x").alias("v"))
    )
    found = sorted((r.lang, r.v) for r in sums.limit(MAX_LANGUAGES + 1).collect())
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages: {lang_col} is no language column")
    vectors = np.array([v for _, v in found], np.float64).reshape(len(found), DIMENSIONS)
    return [lang for lang, _ in found], vectors


def classify(
    docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text", out: tuple[str, ...] = ("lang_pred", "score")
) -> DataFrame:
    """``docs`` with the predicted language and its score, the cosine cut to
    0..1, in two columns named by ``out`` (columns of that name are replaced); a
    third name is for the number of the text's trigrams.
    """
    langs, vectors = model
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    prototypes = (vectors / np.where(norms > 0, norms, 1)).astype(np.float32)
    kept = docs.drop(*out)
    types = (T.StringType(), T.DoubleType(), T.LongType())
    schema = T.StructType([*kept.schema, *(T.StructField(name, kind) for name, kind in zip(out, types))])
    names = schema.names

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in text_chunks(batches, text_col):
            grams = Trigrams(data, offsets)
            n = len(offsets) - 1
            bundles = grams.bundle([np.arange(a, b) for a, b in zip(grams.cuts, grams.cuts[1:])])
            found = (np.diff(grams.cuts) > 0) & (len(langs) > 0)
            pred, best = np.full(n, UNKNOWN, object), np.zeros(n)
            if langs:
                lengths = np.linalg.norm(bundles, axis=1)
                cosines = (bundles @ prototypes.T) / np.where(lengths > 0, lengths, 1)[:, None]
                top = cosines.argmax(1)
                pred[found] = np.array(langs, object)[top[found]]
                best[found] = np.clip(cosines[np.arange(n), top][found], 0, 1)
            sizes = np.concatenate([[0], np.cumsum(grams.counts)])[grams.cuts]
            found = [pa.array(pred, pa.string()), pa.array(best), pa.array(np.diff(sizes), pa.int64())]
            yield pa.RecordBatch.from_arrays([*rows.columns, *found[: len(out)]], names)

    return kept.mapInArrow(score, schema)


def _noise(score: Column, size: Column) -> Column:
    """A text of n trigrams in a language scores about sqrt(n / (n + c)): its own
    sample of trigrams, besides what all texts share. This is its c."""
    return size * (1 / (score * score) - 1)


def usual_noise(scored: DataFrame, lang: str, pred: str, score: str, size: str) -> float | None:
    """The median noise of all labelled texts that were recognised and are long
    enough to be judged; None without any."""
    known = (F.col(lang) == F.col(pred)) & (F.col(size) >= MIN_TRIGRAMS) & (F.col(score) > 0)
    return scored.where(known).agg(F.percentile_approx(_noise(F.col(score), F.col(size)), 0.5, 10_000)).first()[0]


def plausible(score: Column, size: Column, noise: float | None) -> Column:
    """Whether a text scores as texts of its length do, in any language. Repeated
    words and random letters do not, the less the longer they are."""
    if noise is None:
        return F.lit(True)
    floor = F.sqrt(size / (size + F.lit(WIDE * noise))) - F.lit(SLACK / DIMENSIONS**0.5)
    return (size < MIN_TRIGRAMS) | (score >= floor)


def fold(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; null for a null id."""
    return F.crc32(id_col.cast("string")) % folds


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; every fifth fold is not learned from."""
    docs = docs.select("doc_id", "text", "lang")
    model = train_prototypes(docs.where(fold(F.col("doc_id"), 5) != 0))
    return classify(docs.drop("lang"), model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score"
    )
