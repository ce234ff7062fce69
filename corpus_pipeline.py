"""The corpus pipeline: stages over ``documents``, each one operator of vsframe.llm.

Every stage gets what its predecessor kept, written to the shared folder as
Parquet and read again, and is decided on that alone. All stages but the last
return the columns of their input; ``n_chars``, where there is one, follows the
text. Rows with a null id or text pass like others: no letter means no
language, so null and empty texts go in the first stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vsframe.llm import bpe
from vsframe.llm.common import fresh, let_workers_import, materialize, read_table, salted_join
from vsframe.llm.decontamination import mark_contamination
from vsframe.llm.langid import UNKNOWN, classify, plausible, train_prototypes, usual_noise
from vsframe.llm.line_dedup import drop_lines
from vsframe.llm.ngram_join import link_components, row_key


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language: those that have letters, and whose score is not
    below what texts of their length have. Prototypes and that floor are learned
    from all labelled documents."""
    let_workers_import(spark)
    pred, score, size = fresh(docs, "_lang", "_score", "_size")
    found = materialize(classify(docs, train_prototypes(docs), out=(pred, score, size)), "languages")
    noise = usual_noise(found, "lang", pred, score, size)
    known = (F.col(pred) != UNKNOWN) & plausible(F.col(score), F.col(size), noise)
    return found.where(known).drop(pred, score, size)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that many others hold."""
    lines, kept = fresh(docs, "_lines", "_kept")
    cut = drop_lines(docs, (lines, kept))
    changed = F.size(lines) != F.size(kept)
    text = F.when(changed, F.array_join(kept, "\n")).otherwise(F.col("text"))
    out = cut.withColumn("text", text)
    if "n_chars" in docs.columns:
        size = F.char_length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(changed, size).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: the one with the smallest id,
    null last, then row key, and of identical rows the first of the input. Rows
    without words link with nothing and stay."""
    let_workers_import(spark)
    key, spread, place, row = fresh(docs, "_key", "_spread", "_place", "_row")
    linked = link_components(docs.select("doc_id", "text"), component="group").where("group IS NOT NULL")
    found = materialize(linked.groupBy("group", "key").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("n")), "linked-rows")
    first = found.groupBy("group").agg(F.min(F.struct(F.col("id").isNull(), "id", "key")).alias("first")).select("group", F.col("first.key").alias("first"))
    marked = salted_join(found, first, ["group"], "key", "inner")
    gone = marked.where("key <> first OR n > 1").select(F.col("key").alias(key))
    keyed = docs.withColumn(key, row_key()).withColumn(spread, F.col(key))
    out = salted_join(keyed, gone, [key], spread, "left_anti").select(*docs.columns)
    repeated = materialize(marked.where("key = first AND n > 1").select(F.col("key").alias(key)), "repeated-rows")
    if repeated.isEmpty():
        return out
    # counted before the shuffle, and combined there too
    numbered = keyed.withColumn(place, F.monotonically_increasing_id())
    copies = salted_join(numbered, repeated, [key], spread, "left_semi")
    one = copies.groupBy(key).agg(F.min_by(F.struct(*docs.columns), place).alias(row))
    return out.unionByName(one.select(*(F.col(row)[c].alias(c) for c in docs.columns)))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    words, spans, items = fresh(docs, "_words", "_spans", "_items")
    marked = mark_contamination(docs, read_table(spark, sf_dir, "benchmark"), out=(words, spans, items))
    return marked.where(F.size(spans) == 0).drop(words, spans, items)


def byte_level_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token ids, packed, with digests of ids and decoded
    bytes, in place of its text."""
    let_workers_import(spark)
    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), packed="token_ids")


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_level_bpe", byte_level_bpe),
]

#: No SQL: language ID by hypervectors and BPE ids are not expressible.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
