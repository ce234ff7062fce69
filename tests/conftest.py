import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

FIXTURES = os.path.join(os.path.dirname(os.path.abspath(__file__)), "fixtures")
SF001 = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    builder = (
        SparkSession.builder.master("local[4]")
        .appName("vsframe-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
    )
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    # tests set their own shared folder only where the session names none
    if not session.conf.get("spark.checkpoint.dir", None) and not session.sparkContext.getCheckpointDir():
        session.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="vsframe-test-ckpt-"))
    yield session
    session.stop()


@pytest.fixture(scope="session")
def results(spark):
    from vsframe.plans.football import load_results

    return load_results(spark, os.path.join(FIXTURES, "results.csv"))


@pytest.fixture(scope="session")
def goals(spark):
    from vsframe.plans.football import load_goalscorers

    return load_goalscorers(spark, os.path.join(FIXTURES, "goalscorers.csv"))
