"""Failed tasks are retried to the same answer.

Runs in its own Spark process (local mode retries tasks only with
``local[N,F]``): the first attempt of some tasks fails, once before the
shuffles of the gap operator and once in the stage that computes the lag, and
the result must equal a failure-free run. The salted membership queries
(whose salt hashes the partition id) are checked the same way.
"""

import os
import subprocess
import sys
import textwrap

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = textwrap.dedent(
    """
    import sys
    sys.path.insert(0, {repo!r})
    from pyspark import TaskContext
    from pyspark.sql import SparkSession
    from vsframe.operators import member_set, restrict_to_members
    from vsframe.plans import supplied

    spark = (SparkSession.builder.master("local[4,4]").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", "8").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")

    def flaky(batches):
        ctx = TaskContext.get()
        for i, b in enumerate(batches):
            if ctx.attemptNumber() == 0 and ctx.partitionId() % 2 == 0:
                raise RuntimeError("injected task failure")
            yield b

    d = "/root/testdata/sf0.01"
    clean = sorted(map(tuple, supplied.event_gaps_query(spark, d).collect()))
    def many_salts(spark, d):
        ev = spark.read.parquet(d + "/events.parquet").select("user_id", "event_id", "event_type")
        members = member_set(ev, ["user_id"], name="user_id", where=ev.event_type == "purchase")
        return restrict_to_members(ev, members, "user_id", rows_per_salt=20)

    queries = (supplied.restrict_members, supplied.longest_gaps_top20, many_salts)
    salted = [sorted(map(tuple, q(spark, d).collect())) for q in queries]

    # failing before the shuffles: the events scan is wrapped
    original = spark.read.parquet
    def flaky_read(path):
        df = original(path)
        return df.mapInArrow(flaky, df.schema) if path.endswith("events.parquet") else df
    spark.read.parquet = flaky_read
    before = sorted(map(tuple, supplied.event_gaps_query(spark, d).collect()))
    salted_retry = [sorted(map(tuple, q(spark, d).collect())) for q in queries]
    spark.read.parquet = original

    # failing in the lag's own stage (after the shuffles)
    out = supplied.event_gaps_query(spark, d)
    after = sorted(map(tuple, out.mapInArrow(flaky, out.schema).collect()))
    same = clean == before == after and len(clean) > 0 and salted == salted_retry
    print("SAME" if same else "DIFFERENT")
    """
)


def test_retried_tasks_give_the_same_gaps():
    proc = subprocess.run(
        [sys.executable, "-c", SCRIPT.format(repo=REPO)], capture_output=True, text=True, timeout=600
    )
    assert proc.stdout.strip().splitlines()[-1] == "SAME", proc.stderr[-2000:]
