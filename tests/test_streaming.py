"""The aggregate-only operators accept a streaming DataFrame unchanged.

A file stream over Parquet, the in-process memory sink, complete mode, one
available-now trigger; the checkpoint lives in the shared folder.
"""

from vsframe import net_by_counterparty, repeated_in_group, shared_dir, two_sided_to_long

MATCH = "a string, b string, sa int, sb int"
ROWS = [("S", "X", 3, 1), ("X", "S", 0, 1), ("S", "Y", 2, 2), ("Y", "Z", 1, 0), ("S", "X", 1, 4)]


def _run(spark, df, name):
    q = (
        df.writeStream.format("memory").queryName(name).outputMode("complete")
        .option("checkpointLocation", shared_dir(spark, f"stream-{name}"))
        .trigger(availableNow=True).start()
    )
    q.awaitTermination(120)
    try:
        return sorted(tuple(r) for r in spark.table(name).collect())
    finally:
        q.stop()


def test_balance_and_repeats_on_a_stream(spark):
    src = shared_dir(spark, "stream-src")
    spark.createDataFrame(ROWS, MATCH).write.parquet(src)
    stream = spark.readStream.schema(MATCH).parquet(src)
    batch = spark.read.parquet(src)

    got = _run(spark, net_by_counterparty(stream, "S", "a", "b", "sa", "sb"), "vs_balance")
    assert got == sorted(tuple(r) for r in net_by_counterparty(batch, "S", "a", "b", "sa", "sb").collect())

    long = two_sided_to_long(stream, [], {"team": "a", "gf": "sa"}, {"team": "b", "gf": "sb"})
    got = _run(spark, repeated_in_group(long, ["team"], min_count=3), "vs_repeats")
    assert got == [("S", 4), ("X", 3)]
