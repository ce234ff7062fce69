"""Exact dedup by progressive refinement.

Rows are grouped by text length, then by a hash of a prefix, then by a hash of
the whole text; each step keeps only groups of two rows or more, so whole texts
are hashed for the survivors of the cheap keys alone.

Texts are equal when identical after lower-casing A-Z (a step that never
changes the length in bytes). Null texts count as empty. Ties cannot occur:
of rows with the same largest id all are one group's, and the group has one
``keep_id``. A null id is a row like others but never the one that stays
unless its whole group has null ids.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vsframe.llm.common import ascii_lower, materialize, salted_join, text_chunks

#: Code points of the prefix that the second step hashes.
PREFIX_CHARS = 64


def _hash_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, data, offsets in text_chunks(batches, "text"):
        lowered = data.tobytes().lower()  # bytes.lower() touches A-Z only
        cuts = offsets.tolist()
        digests = [hashlib.sha256(lowered[a:b]).hexdigest() for a, b in zip(cuts, cuts[1:])]
        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(digests, pa.string())], ["doc_id", "text_sha256"])


def text_digests(docs: DataFrame) -> DataFrame:
    """(doc_id, text_sha256): SHA-256 of each text, A-Z lower-cased."""
    return docs.select("doc_id", "text").mapInArrow(_hash_rows, "doc_id long, text_sha256 string")


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Groups of at least two equal texts: one row (doc_id, text_sha256,
    keep_id, group_size) for each of their members.

    Reads (id, text) of every row once for lengths and prefix hashes; the text
    is read again, whole, only for rows whose (length, prefix) another row has.
    The counts of every step combine before their shuffle, and the joins that
    bring them back are salted, so a third of all rows may share one text.
    """
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    heads = materialize(
        docs.select(
            "doc_id",
            F.octet_length("text").alias("n_bytes"),
            F.xxhash64(ascii_lower(F.substring("text", 1, PREFIX_CHARS))).alias("prefix"),
        ),
        "exact-heads",
    )
    alive = heads
    for keys in (["n_bytes"], ["n_bytes", "prefix"]):
        shared = alive.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
        alive = salted_join(alive, shared, keys, "doc_id", "left_semi")
    alive = alive.select("doc_id").distinct()
    texts = docs.withColumn("_id", F.coalesce("doc_id", F.lit(0)))
    ids = alive.select(F.coalesce("doc_id", F.lit(0)).alias("_id")).distinct()
    survivors = materialize(text_digests(texts.join(ids, "_id", "left_semi")), "exact-survivors")
    groups = (
        survivors.groupBy("text_sha256")
        .agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
    )
    return salted_join(survivors, groups, ["text_sha256"], "doc_id", "inner").select(
        "doc_id", "text_sha256", "keep_id", "group_size"
    )


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per document, dropped ones too: doc_id, keep_id, group_size,
    kept, text_sha256. Documents outside every group keep themselves; the
    digest column is theirs to compute, so their text is hashed as well.
    """
    digests = text_digests(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    groups = duplicate_groups(docs).select("text_sha256", "keep_id", "group_size").distinct()
    joined = salted_join(digests, groups, ["text_sha256"], "doc_id", "left")
    size = F.coalesce("group_size", F.lit(1).cast("long"))
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id",
        keep.alias("keep_id"),
        size.alias("group_size"),
        keep.eqNullSafe(F.col("doc_id")).alias("kept"),
        "text_sha256",
    )
