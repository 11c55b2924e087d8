"""Times of the headline queries over $BENCH_SF_DIR, as one line of JSON."""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.operators import diff, profile, rows, sqlconsole, views
from stratalens.operators.viewspec import Filter, Search, Sort, ViewSpec
from stratalens.sources import ingest

RUNS = 3


def spent(f) -> float:
    """The median of RUNS runs, in seconds, after one to warm up."""
    f()
    out = []
    for _ in range(RUNS):
        t = time.perf_counter()
        f()
        out.append(time.perf_counter() - t)
    return sorted(out)[RUNS // 2]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "6g").config("spark.sql.files.maxPartitionBytes", "2m").config("spark.python.sql.dataFrameDebugging.enabled", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    work = tempfile.mkdtemp(prefix="bench-")
    items = rows.scan(spark, f"{sf}/lineitem.parquet")
    plain = items.drop(rows.ROW)
    text = f"{work}/lineitem.csv"
    plain.coalesce(1).write.option("header", True).csv(f"{work}/csv")
    shutil.move(next(os.path.join(f"{work}/csv", n) for n in os.listdir(f"{work}/csv") if n.startswith("part-")), text)
    spec = ViewSpec(filters=(Filter("l_quantity", "gt", "25"),), sort=(Sort("l_extendedprice", "desc"),))
    whole = views.build(items, ViewSpec(), "")
    console = sqlconsole.console(spark)
    plain_columns = [f.name for f in plain.schema if f.dataType.simpleString() in ("bigint", "int", "string", "timestamp_ntz")]
    session = sqlconsole.query
    console.read.parquet(f"{sf}/lineitem.parquet").createOrReplaceTempView("data")
    cases = {
        "ingest_csv": lambda: ingest.ingest(spark, text, f"{work}/t", "t"),
        "view_filter_sort": lambda: views.build(items, spec, f"{work}/v"),
        "page": lambda: views.page(whole, 500_000, 200).collect(),
        "search_all_columns": lambda: views.view(items, ViewSpec(search=Search("ab1"))).agg(F.count(F.lit(1))).collect(),
        "profile_column": lambda: profile.profile_column(plain, "l_extendedprice").collect(),
        "top_values": lambda: profile.top_values(plain, "l_quantity").collect(),
        "histogram": lambda: profile.histogram(plain, "l_extendedprice").collect(),
        "profile_all": lambda: profile.profile_all(plain).collect(),
        "diff_positional": lambda: diff.compare(items, items, columns=plain_columns).summary().collect(),
        "console_group_by": lambda: session(console, "SELECT l_returnflag, count(*) AS n, sum(l_quantity) AS q FROM data GROUP BY 1").collect(),
    }
    times = {name: round(spent(f), 4) for name, f in cases.items()}
    shutil.rmtree(work, ignore_errors=True)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": float(sf.rstrip("/").rsplit("sf", 1)[-1]) if "sf" in sf else None}))


if __name__ == "__main__":
    main()
