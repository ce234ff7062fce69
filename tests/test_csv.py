"""CSV sink and source: RFC 4180 round trip (T25) in the shared folder."""

import datetime as dt

from vsframe import read_typed_csv, shared_dir, write_csv


def test_round_trip_keeps_text(spark):
    src = spark.createDataFrame(
        [(1, 'He said "hi", then left', dt.date(2020, 1, 2), "multi\nline"),
         (2, "", None, None),
         (3, 'ends with quote"', dt.date(1999, 12, 31), "a,b")],
        "id bigint, text string, d date, note string",
    )
    path = shared_dir(spark, "test-csv")
    write_csv(src, path)
    back = read_typed_csv(spark, path, {"id": "bigint", "d": "date"}, multi_line=True).orderBy("id")
    assert back.dtypes == [("id", "bigint"), ("text", "string"), ("d", "date"), ("note", "string")]
    got = [tuple(r) for r in back.collect()]
    assert got[0] == (1, 'He said "hi", then left', dt.date(2020, 1, 2), "multi\nline")
    assert got[2] == (3, 'ends with quote"', dt.date(1999, 12, 31), "a,b")
    # documented: an empty string is written as "" and read back as empty or null
    assert got[1][0] == 2 and got[1][1] in ("", None) and got[1][2] is None and got[1][3] is None


def test_single_file_and_declared_columns(spark):
    src = spark.range(50).selectExpr("id", "cast(id * 2 as string) as v")
    path = shared_dir(spark, "test-csv-single")
    write_csv(src, path, single_file=True)
    back = read_typed_csv(spark, path, {"id": "int", "v": "int"}, columns=["id", "v"])
    assert back.count() == 50 and back.where("v != id * 2").count() == 0
    import glob
    import os
    local = path.replace("file:", "")
    if os.path.isdir(local):
        assert len(glob.glob(os.path.join(local, "part-*.csv"))) == 1


def test_shared_dir_is_fresh_and_under_checkpoint_root(spark):
    a, b = shared_dir(spark, "x"), shared_dir(spark, "x")
    assert a != b
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert a.startswith(root.rstrip("/"))


def test_null_value_token_applies_to_text_columns(spark):
    path = shared_dir(spark, "test-csv-na")
    spark.createDataFrame([("a", "NA", "1"), ("NA", "x", "NA")], "s string, t string, n string").write.option(
        "header", True
    ).csv(path)
    plain = read_typed_csv(spark, path, {"n": "int"}, columns=["s", "t", "n"])
    # by default only typed columns turn NA into null; text keeps it (the reference's behaviour)
    assert sorted(tuple(r) for r in plain.collect()) == [("NA", "x", None), ("a", "NA", 1)]
    na = read_typed_csv(spark, path, {"n": "int"}, columns=["s", "t", "n"], null_value="NA")
    assert sorted((tuple(r) for r in na.collect()), key=repr) == sorted([(None, "x", None), ("a", None, 1)], key=repr)


class _Session:
    """What checkpoint_root reads of a session."""

    def __init__(self, conf, checkpoint=None, master="local[2]"):
        self._values = conf
        self.conf = self
        self.sparkContext = type("Context", (), {"getCheckpointDir": lambda _: checkpoint, "master": master})()

    def get(self, key, *default):
        return self._values.get(key, *default) if default else self._values[key]


def test_checkpoint_root_branches():
    import pytest

    from vsframe.session import checkpoint_root

    warehouse = {"spark.sql.warehouse.dir": "file:/wh"}
    assert checkpoint_root(_Session({"spark.checkpoint.dir": "file:///shared/"} | warehouse, "hdfs://n/c")) == "file:///shared"
    assert checkpoint_root(_Session(warehouse, "hdfs://n/c/")) == "hdfs://n/c"
    assert checkpoint_root(_Session(warehouse)) == "file:/wh"
    for found in (None, "file:///c", "/c"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            checkpoint_root(_Session(warehouse, found, "spark://host:7077"))
    assert checkpoint_root(_Session({"spark.sql.warehouse.dir": "s3a://b/wh"}, None, "yarn")) == "s3a://b/wh"
