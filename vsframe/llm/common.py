"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vsframe.session import shared_dir

#: The white space of the contracts, ``[\x20\x09-\x0D]``.
ASCII_SPACE = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of text that one numpy step works on; bounds a Python worker's memory.
CHUNK_BYTES = 1 << 21


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage.

    Lost executors then cost a re-read, not a recomputation, and a plan used
    twice is computed once.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Remove tables that ``materialize`` wrote and that nothing reads any more:
    whatever was made of them is written itself."""
    for table in tables:
        path = getattr(table, "_written", None)
        if path:
            spark = table.sparkSession
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def settle(spark: SparkSession) -> None:
    """Have Spark drop the shuffle files of steps that are written.

    It does so once the driver has collected their frames, which on a driver
    with heap to spare would be long after they have filled the executors' disks.
    Right after a write, Spark's listeners may still hold its frame: a second
    collection finds it free.
    """
    gc.collect()
    for _ in range(2):
        spark._jvm.System.gc()


class Steps:
    """Broadcasts of an operator's steps; ``end`` destroys those sent so far, once
    what reads them is written, and drops the steps' shuffle files."""

    def __init__(self, spark: SparkSession) -> None:
        self._spark, self._sent = spark, []

    def send(self, value: object) -> Broadcast:
        self._sent.append(self._spark.sparkContext.broadcast(value))
        return self._sent[-1]

    def end(self) -> None:
        for sent in self._sent:
            sent.destroy()
        self._sent.clear()
        settle(self._spark)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores as keep it apart from df's columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(col, UPPER, LOWER)


#: Salts of a hot key in a salted join.
SALTS = 8


def _salt(spread: str, salts: int) -> Column:
    return F.pmod(F.xxhash64(F.col(spread), F.lit(7)), F.lit(salts)).cast("int")


def salts_met(spread: str, salts: int = SALTS) -> Column:
    """Aggregate: the salts that a group's rows take in ``salted_join``, as bits."""
    return F.bit_or(F.call_function("shiftleft", F.lit(1), _salt(spread, salts)))


def salted_right(right: DataFrame, salts: int = SALTS, met: str | None = None) -> DataFrame:
    """``right`` once per salt, or once per salt among the bits of column ``met``."""
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    if met is None:
        return right.withColumn("_salt", F.explode(every))
    return right.withColumn("_salt", F.explode(F.filter(every, lambda s: F.getbit(met, s) == 1))).drop(met)


def salted_join(
    left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str, salts: int = SALTS, met: str | None = None
) -> DataFrame:
    """Equi-join a table with hot keys to a table with at most one row a key.

    ``left`` takes a salt from ``spread`` (any column that varies within a hot
    key), ``right`` is repeated once per salt. The salt also keeps the join
    from reusing the partitioning of the aggregate that made ``right``, so
    both sides are plain exchanges and AQE can split what is still uneven.
    Where most keys have few rows, ``right`` names in ``met`` its column of
    ``salts_met`` over ``left``'s rows, and is repeated for those salts only.
    """
    return left.withColumn("_salt", _salt(spread, salts)).join(salted_right(right, salts, met), [*keys, "_salt"], how).drop("_salt")


#: Bits of a key filter, 8 MiB whatever the number of keys.
FILTER_BITS = 26


def key_filter(keys: DataFrame) -> np.ndarray:
    """Bits of a frame's one column of (well mixed) long keys.

    A fixed-size filter that only spares work: what passes it in excess, more
    as keys grow, must find no partner in the join that follows.
    """
    place = F.col(keys.columns[0]).bitwiseAND(F.lit((1 << FILTER_BITS) - 1)) + 1  # bit 0 of bucket 1 stands for 1
    rows = (
        keys.select(place.alias("p"))
        .groupBy(F.bitmap_bucket_number("p").alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
        .collect()
    )
    out = np.zeros((1 << FILTER_BITS - 15, 4096), np.uint8)
    for r in rows:
        out[r.bucket - 1] = np.frombuffer(r.bits, np.uint8)
    return out.ravel()


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys may be in the filter."""
    place = keys & ((1 << FILTER_BITS) - 1)
    return ((bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1).astype(bool)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A string column as its UTF-8 bytes and n + 1 offsets; null as empty."""
    arr = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(arr.buffers()[1], np.int64, len(arr) + 1, arr.offset * 8)
    data = arr.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def row_chunks(offsets: np.ndarray, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Consecutive row ranges of at most ``most`` bytes, or of one longer row."""
    lo, n = 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        yield lo, min(hi, n)
        lo = min(hi, n)


def text_chunks(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) for row ranges of bounded text size."""
    for batch in batches:
        data, offsets = utf8(batch.column(batch.schema.get_field_index(column)))
        for lo, hi in row_chunks(offsets, most):
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (murmur3's constants)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


_BYTE_CODES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers_to(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, at least ``n`` of each."""
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        _powers.clear()
        both = []
        for base in (_BASE, _INVERSE):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            both.append(np.cumprod(p))
        _powers[size] = tuple(both)
    return _powers[size]


class RollingHash:
    """64-bit hashes of any slices of a byte array, from one prefix sum."""

    def __init__(self, data: np.ndarray):
        up, self._down = _powers_to(len(data) + 1)
        self._sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE_CODES[data] * up[: len(data)], out=self._sums[1:])

    def slices(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Hash of ``data[starts[i]:ends[i]]``; equal slices get equal hashes."""
        raw = (self._sums[ends] - self._sums[starts]) * self._down[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def windows(self, width: int) -> np.ndarray:
        """Hash of the ``width`` bytes from every start that has so many."""
        n = len(self._sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix64((self._sums[width:] - self._sums[:n]) * self._down[:n])


_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def lower_bytes(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z lower-cased."""
    return _LOWER[data]


def word_spans(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray = ~_IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of maximal word runs within rows, and words per row.

    ``is_word`` says for each byte value whether it belongs to a word.
    """
    inside = is_word[data]
    n = len(data)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets) - 1, np.int64)
    first = np.zeros(n + 1, bool)
    first[offsets] = True  # a row's first byte begins a new run
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    counts = np.diff(np.searchsorted(starts, offsets))
    return starts, ends, counts


def let_workers_import(spark: SparkSession) -> None:
    """Python workers find this package where the driver found it, if they see
    that folder; elsewhere it is installed on them, or sent with --py-files."""
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in known:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, known)])


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    let_workers_import(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
