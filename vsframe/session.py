"""Session-level helpers: the shared scratch folder and recommended settings."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

# Settings a caller may pass to SparkSession.builder. AQE re-plans joins from
# runtime sizes (the size check behind every broadcast we do not hint) and
# splits skewed join partitions; coalescing aims at the advisory partition
# size rather than at maximal parallelism (Spark's advice for shared, busy
# clusters); the time zone matches the reference's UTC.
RECOMMENDED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
}


def _is_local_path(path: str) -> bool:
    return path.startswith("file:") or "://" not in path


def checkpoint_root(spark: SparkSession) -> str:
    """The folder shared by the driver and all executors.

    Taken from ``spark.checkpoint.dir``; where that is unset, from the
    context's checkpoint dir, else from ``spark.sql.warehouse.dir``. A fallback
    that is a local path is refused on a non-local master: each executor would
    write to its own disk there. Nothing below it is removed by this library;
    whoever owns the folder cleans it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    try:  # a classic session; a Spark Connect session has no SparkContext
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001
        sc = None
    root = sc.getCheckpointDir() if sc is not None else None
    if not root:
        root = spark.conf.get("spark.sql.warehouse.dir")
    master = sc.master if sc is not None else spark.conf.get("spark.master", "")
    if _is_local_path(root) and not master.startswith("local"):
        raise ValueError(f"{root} is local to one machine; set spark.checkpoint.dir to a folder all executors share")
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A fresh, never reused folder below the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/vsframe/{name}-{uuid.uuid4().hex}"
