"""Shapes of the console whose cost must not grow with pairs or with groups."""

import datetime as dt

from pyspark.sql import functions as F

from sheavework.plans import console  # noqa: F401 - registers the shapes
from sheavework.plans.registry import QUERIES


def star(spark, path, **tables):
    for name in console.STAR:
        (tables.get(name) or spark.range(1)).write.parquet(f"{path}/{name}.parquet")
    return str(path)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_join_lists_no_pairs(spark, tmp_path):
    hour = dt.datetime(2024, 1, 1, 5)
    at = [hour + dt.timedelta(seconds=s) for s in (-3600, -1800, -1, 0, 0, 1, 600, 1800, 3599, 3600, 3601, 7200, 90000)] + [hour + dt.timedelta(microseconds=1), None]
    rows = [(i * 7 % 11, t, i) for i, t in enumerate(at)] + [(None, hour, 99)]
    sf = star(spark, tmp_path, events=spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long"))
    got = QUERIES["select_range_join"](spark, sf)
    want = {}
    for e, t, _ in rows:
        for b, u, _ in rows:
            if t and u and t < u <= t + dt.timedelta(hours=1):
                want.setdefault(e, []).append(b)
    assert {r.event_id: (r.n, r.last_id) for r in got.collect()} == {e: (len(bs), max((b for b in bs if b is not None), default=None)) for e, bs in want.items()}
    assert "Join" not in plan_of(got)


def test_approximate_keeps_no_sketch_per_customer(spark, tmp_path):
    orders = spark.range(1000).select((F.col("id") % 300).alias("o_custkey"), F.col("id").cast("double").alias("o_totalprice"))
    got = QUERIES["select_approximate"](spark, star(spark, tmp_path, orders=orders))
    assert [tuple(r) for r in got.collect()] == [(300, 499.5, True, True)]
    sketches = [line for line in plan_of(got).splitlines() if "percentile_approx(" in line and "Aggregate" in line]
    assert sketches and all("keys=[]" in line for line in sketches)
