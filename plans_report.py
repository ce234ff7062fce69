"""Summarise the physical plan of every registered query into PLANS.md.

For each query: the Parquet scans (columns read, filters pushed), the
shuffles and the notable operators of the final adaptive plan at one scale
factor, and the join strategies again with broadcasts switched off (how the
joins plan once tables are too large to broadcast).

    python plans_report.py [sf_dir] > PLANS.md
"""

from __future__ import annotations

import os
import re
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

NOTABLE = (
    "WindowGroupLimit",
    "TakeOrderedAndProject",
    "MapInArrow",
    "Generate",
    "ReusedExchange",
    "Window [",
    "SortAggregate",
    "ObjectHashAggregate",
)
JOINS = ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin", "BroadcastNestedLoopJoin", "CartesianProduct")


def _final(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def _clean(text: str) -> str:
    return re.sub(r"#\d+L?", "", text)


def _summary(text: str) -> dict:
    text = _clean(text)
    scans = []
    for line in text.splitlines():
        m = re.search(r"FileScan (\w+) \[([^\]]*)\].*?Location: \w+\(\d+ paths\)\[([^\]]*)\]", line)
        if m:
            table = os.path.basename(m.group(3)).replace(".parquet", "")
            pushed = re.search(r"PushedFilters: \[([^\]]*)\]", line)
            scans.append((table, m.group(2), pushed.group(1) if pushed else ""))
    own = "\n".join(line for line in text.splitlines() if "ReusedExchange" not in line)
    shuffles = Counter(re.findall(r"Exchange (\w+partitioning\([^)]*\)|SinglePartition)", own))
    joins = Counter(j for j in JOINS for _ in re.finditer(rf"\b{j}\b", text))
    notable = sorted(n.strip(" [") for n in NOTABLE if n in text)
    return {"scans": scans, "shuffles": shuffles, "joins": joins, "notable": notable}


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    from pyspark.sql import SparkSession

    from vsframe.session import RECOMMENDED_CONF

    builder = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "16")
    for key, value in RECOMMENDED_CONF.items():
        builder = builder.config(key, value)
    spark = builder.config("spark.sql.maxMetadataStringLength", "10000").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from vsframe.plans.supplied import QUERIES

    out = [
        "# Physical plans of the registered queries",
        "",
        f"Generated by `python plans_report.py {sf_dir}` (local[8], 16 shuffle partitions, AQE on).",
        "Shuffles and operators are from the final adaptive plan; the last two lines",
        "repeat joins and shuffles with broadcasts switched off, as at 100 TB (the",
        "broadcasts left then are the ones bounded by construction).",
        "",
    ]
    for name, fn in QUERIES.items():
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
        s = _summary(_final(fn(spark, sf_dir)))
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
        big = _summary(_final(fn(spark, sf_dir)))
        out.append(f"## {name}")
        out.append("")
        for table, cols, pushed in s["scans"]:
            out.append(f"- scan `{table}` [{cols}]" + (f", pushed: {pushed}" if pushed else ""))
        shuffles = ", ".join(f"{k}" + (f" x{v}" if v > 1 else "") for k, v in s["shuffles"].items()) or "none"
        out.append(f"- shuffles: {shuffles}")
        out.append("- joins: " + (", ".join(f"{k} x{v}" for k, v in s["joins"].items()) or "none"))
        out.append("- operators: " + (", ".join(s["notable"]) or "-"))
        out.append("- joins with broadcasts off: " + (", ".join(f"{k} x{v}" for k, v in big["joins"].items()) or "none"))
        big_shuffles = ", ".join(f"{k}" + (f" x{v}" if v > 1 else "") for k, v in big["shuffles"].items()) or "none"
        out.append(f"- shuffles with broadcasts off: {big_shuffles}")
        out.append("")
    print("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main()
