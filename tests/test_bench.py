"""bench.py prints one JSON line with the fields the driver records."""

import json
import os
import subprocess
import sys

import __spark_entry__ as entry
from vsframe.plans.supplied import QUERIES

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_bench_prints_one_json_line():
    env = dict(os.environ, BENCH_SF_DIR="/root/testdata/sf0.001", BENCH_CPUS="2", BENCH_RUNS="1")
    proc = subprocess.run(
        [sys.executable, os.path.join(REPO, "bench.py")], capture_output=True, text=True, timeout=900, env=env
    )
    assert proc.returncode == 0, proc.stderr[-2000:]
    lines = [line for line in proc.stdout.splitlines() if line.strip()]
    assert len(lines) == 1
    out = json.loads(lines[0])
    assert out["unit"] == "sec" and out["sf"] == 0.001 and out["failed"] == {}
    assert set(out["queries"]) == set(entry.queries())
    assert abs(out["value"] - sum(out["queries"].values())) < 0.01


def test_plans_report_covers_every_query():
    proc = subprocess.run(
        [sys.executable, os.path.join(REPO, "plans_report.py"), "/root/testdata/sf0.001"],
        capture_output=True, text=True, timeout=900,
    )
    assert proc.returncode == 0, proc.stderr[-2000:]
    sections = [line[3:] for line in proc.stdout.splitlines() if line.startswith("## ")]
    assert sections == list(QUERIES)
    assert "joins with broadcasts off" in proc.stdout
