"""Clock steps over every run, without a task for a target."""

import re

from pyspark.sql import functions as F

from apisight.operators import history as H

SF = "/root/testdata/sf0.001"


def brute(runs):
    last, out = {}, {}
    for r in sorted(runs, key=lambda r: r.id):
        had = last.get(r.target)
        out[r.id] = bool(had is not None and r.run_timestamp is not None and r.run_timestamp < had)
        last[r.target] = r.run_timestamp
    return out


def test_every_event_is_a_run(spark):
    e = spark.read.parquet(f"{SF}/events.parquet")
    some = F.when(F.col("event_id") % 7 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    target = F.when(F.col("user_id") % 3 > 0, F.concat(F.lit("t"), F.col("user_id") % 3))
    runs = e.select((F.col("event_id") * 7919 % 1000003).alias("id"), target.alias("target"), some.alias("run_timestamp"))
    found = H.clock_backwards(runs)
    want = brute(runs.collect())
    assert found.columns == [*runs.columns, "went_back"] and any(want.values())
    assert {r.id: r.went_back for r in found.collect()} == want and found.count() == runs.count()
    assert H.clock_backwards(runs.limit(0)).count() == 0


def test_few_runs_and_no_task_for_a_target(spark):
    runs = spark.createDataFrame([(2**62, "a", "3"), (5, "a", "4"), (6, "b", "1"), (-(2**62), "a", "9")], "id long, target string, run_timestamp string")
    found = H.clock_backwards(runs)
    assert {r.id: r.went_back for r in found.collect()} == {2**62: True, 5: True, 6: False, -(2**62): False}
    many = spark.range(20000).select("id", F.concat(F.lit("t"), F.col("id") % 1).alias("target"), F.col("id").cast("string").alias("run_timestamp"))
    plan = H.clock_backwards(many)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if re.search(r"Window \[.*lag\(run_timestamp#", x)]
    assert windows and all("_block" in x for x in windows), plan
