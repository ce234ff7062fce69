"""Line dedup across documents, with DataFrame functions only.

Each line is replaced by a 128-bit hash of its key (the line without leading
and trailing ASCII white space, A-Z lower-cased). The hashes are
range-partitioned with a secondary sort by document (largest first) and
position, and written: a hot line fills as many ranges as its occurrences need.
Each range is then one ordered stream, read with ``lag``: a hash other than the
row's before begins a run, whose first row is the occurrence that stays, and
another document than the row's before counts. What a run at a range's border holds,
one row for each range that it reaches, is handed on: its first document comes
from the earliest of these ranges, its documents are added up, and one that goes
on across a border counts once. What comes back is no text but one sparse bitmap a
document: words of 64 lines, bit set where the line goes, words without a set
bit left out.

A null or empty text is one empty line, whose key is too short to go. Repeated
rows (same id and text) decide alike; rows that share an id count as one
document; null ids count together as one document below all others. Long texts
are split where they are read; a line is one value. Without documents nothing
returns. Columns with clashing names pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vsframe.llm.common import ASCII_SPACE, ascii_lower, fresh, materialize

#: Shorter keys never go, and keys in fewer documents.
MIN_CHARS = 20
MIN_DOCS = 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(text: Column) -> Column:
    """Tells rows with one id but several texts apart."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def line_occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(doc_id, row, pos, h1, h2) of every line whose key is long enough."""
    key = F.trim(F.col("line"), F.lit(ASCII_SPACE))
    return (
        docs.select("doc_id", _row(F.col("text")).alias("row"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
        .where(F.char_length(key) >= min_chars)
        .select("doc_id", "row", "pos", ascii_lower(key).alias("key"))
        .select("doc_id", "row", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))
    )


def ordered_ranges(seen: DataFrame) -> DataFrame:
    """The occurrences in ranges of (hash, document falling, position), written
    to the shared folder so that every reader meets the same ranges."""
    by = ["h1", "h2", F.col("doc_id").desc(), "row", "pos"]
    return materialize(seen.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "line-ranges")


def _streams(ranges: DataFrame) -> DataFrame:
    """Every occurrence with what its range's ordered stream tells of its run:
    the first document, how many, the last, and whether the run lies at a border.

    Windows are per range, or per run within one, so no task holds more than a
    range, however often a line occurs.
    """
    order = ["h1", "h2", F.col("doc_id").desc(), "row", "pos"]
    stream = Window.partitionBy("range").orderBy(*order)
    run = Window.partitionBy("range", "h1", "h2").orderBy(*order[2:])
    so_far = run.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.lag(F.struct("h1", "h2", "doc_id")).over(stream)
    begins = before.isNull() | (before["h1"] != F.col("h1")) | (before["h2"] != F.col("h2"))
    new = begins | ~before["doc_id"].eqNullSafe(F.col("doc_id"))
    marked = ranges.withColumns(
        {"new": new.cast("int"), "edge": F.lag(F.lit(1)).over(stream).isNull() | F.lead(F.lit(1)).over(stream).isNull()}
    )
    return marked.withColumns(
        {"first": F.first("doc_id").over(so_far), "docs": F.sum("new").over(whole), "last": F.last("doc_id").over(whole)}
    ).drop("new")


def repeated_occurrences(ranges: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, pos) of ``ranges`` whose line goes: its hash has
    ``min_docs`` documents or more, and this is not the first of them."""
    read = materialize(_streams(ranges), "line-runs")

    # the first and the last run of every range, and what they make together
    edge = read.where("edge").select("h1", "h2", "range", "first", "docs", "last").distinct()
    along = Window.partitionBy("h1", "h2").orderBy("range")
    whole_line = Window.partitionBy("h1", "h2").orderBy("range").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    earlier = F.lag(F.struct("last")).over(along)
    goes_on = F.when(earlier.isNotNull() & earlier["last"].eqNullSafe(F.col("first")), 1).otherwise(0)
    handed = edge.withColumn("own", F.col("docs") - goes_on).select(
        "range",
        "h1",
        "h2",
        F.first(F.struct(F.col("first").alias("doc"))).over(whole_line).alias("keep"),
        F.sum("own").over(whole_line).alias("all"),
    )
    handed = materialize(handed, "line-hand-offs")
    met = read.join(handed, ["range", "h1", "h2"], "left")
    keep = F.when(F.col("keep").isNotNull(), F.col("keep.doc")).otherwise(F.col("first"))
    total = F.coalesce("all", "docs")
    return met.where((total >= min_docs) & ~F.col("doc_id").eqNullSafe(keep)).select("doc_id", "row", "pos")


def drop_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """(doc_id, row, dropped) for each document that loses a line; ``dropped``
    is an array of (word, bits), sorted by word. ``docs`` has doc_id and text."""
    gone = repeated_occurrences(ordered_ranges(line_occurrences(docs, min_chars)), min_docs)
    return (
        gone.groupBy("doc_id", "row", F.expr("pos div 64").alias("word"))
        .agg(F.bit_or(F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")).alias("bits"))
        .groupBy("doc_id", "row")
        .agg(F.array_sort(F.collect_list(F.struct("word", "bits"))).alias("dropped"))
    )


#: A byte a line up to the last word, '1' where the line goes.
_FLAGS = """CAST(array_join(transform(dropped, (x, i) -> concat(
    repeat('0', CAST(64 * (x.word - CASE WHEN i = 0 THEN -1 ELSE dropped[i - 1].word END - 1) AS INT)),
    reverse(lpad(bin(x.bits), 64, '0')))), '') AS BINARY)"""


def drop_lines(docs: DataFrame, out: tuple[str, str], min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with two more columns named by ``out``: arrays of all lines of
    the text and of those that stay.

    Bitmaps are unpacked on their own side of the join, once a document.
    """
    lines, kept = out
    id_, row, flags = fresh(docs, "_id", "_row", "_flags")
    found = drop_bitmaps(docs.select("doc_id", "text"), min_chars, min_docs).select(
        F.col("doc_id").alias(id_), F.col("row").alias(row), F.expr(_FLAGS).alias(flags)
    )
    joined = docs.join(found, docs["doc_id"].eqNullSafe(F.col(id_)) & (_row(docs["text"]) == F.col(row)), "left")
    stays = F.filter(
        lines,
        lambda line, i: F.col(flags).isNull()
        | (i >= F.octet_length(flags))
        | (F.substring(F.col(flags), i + 1, F.lit(1)) == F.lit(b"0")),
    )
    return joined.drop(id_, row).withColumn(lines, _lines(F.col("text"))).withColumn(kept, stays).drop(flags)


def line_dedup_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    cut = drop_lines(docs.select("doc_id", "text"), ("_lines", "_kept"))
    return cut.select(
        "doc_id",
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size("_kept")).cast("long").alias("n_dropped"),
        F.sha2(F.array_join("_kept", "\n"), 256).alias("kept_sha256"),
    )
