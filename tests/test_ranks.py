"""Quantiles of groups, robust z, ranks of outliers and frames with a shuffle."""

import random
from statistics import median

import numpy as np
from pyspark.sql import functions as F

from textloom.operators import metrics
from textloom.sources.shared import spread


def test_group_quantiles(spark):
    draw = random.Random(3)
    rows = [(draw.choice(["a", "b", None, "hot", "hot", "hot"]), draw.choice([0, 0, 0, draw.randrange(50), None])) for _ in range(900)] + [("one", 7), ("none", None)]
    found = metrics.group_quantiles(spark.createDataFrame(rows, "g string, x long"), ["g"], "x", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()
    groups = {g: [x for h, x in rows if h == g and x is not None] for g, _ in rows}
    assert {r.g: r["count"] for r in found} == {g: len(v) for g, v in groups.items() if v}
    for r in found:
        assert np.allclose([r[f"q{j}"] for j in range(5)], np.quantile(groups[r.g], [0.0, 0.25, 0.5, 0.9, 1.0]))
    empty = spark.createDataFrame([], "g string, x long")
    assert metrics.group_quantiles(empty, ["g"], "x", [0.5]).count() == 0
    one = metrics.quantiles(spark.createDataFrame([(k, 2.0 * k) for k in range(11)], "a long, b double"), ["a", "b"], [0.5, 0.25]).first()
    assert one.asDict() == {"a_0.5": 5.0, "a_0.25": 2.5, "b_0.5": 10.0, "b_0.25": 5.0}
    assert metrics.quantiles(empty.select("x"), ["x"], [0.5]).first()[0] is None


def test_robust_z(spark):
    rows = [(k, None if k % 4 == 0 else "hot", (k * 37 % 101) ** 2) for k in range(120)] + [(200, "few", 1), (201, "hot", None), (202, "nothing", None)]
    got = {r.key: r for r in metrics.robust_z(spark.createDataFrame(rows, "key long, g string, x long"), ["g"], "x").collect()}
    assert len(got) == len(rows)
    for key, g, x in rows:
        peers = [v for _, h, v in rows if h == g and v is not None]
        if x is None or len(peers) < 8:
            assert got[key].z is None and got[key].excess == 0
        else:
            middle = median(peers)
            mad = median(abs(v - middle) for v in peers)
            assert abs(got[key].z - (x - middle) / (1.4826 * mad)) < 1e-5


def test_equal_outliers(spark):
    rows = [(k, 0.1) for k in range(200)] + [(1000 + k, 0.9) for k in range(9, -1, -1)] + [(2000, 0.95), (2000, 0.95)]
    found = metrics.outliers(spark.createDataFrame(rows, "key long, x double"), "key", "x").collect()
    assert sorted((r["rank"], r.key) for r in found) == [(1, 2000), (2, 2000), *((3 + k, 1000 + k) for k in range(10))]


def test_spread_runs_no_job(spark):
    df = spark.range(100).groupBy((F.col("id") % 7).alias("k")).count()
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("spread", "spread")
    try:
        assert spread(df) is df and not tracker.getJobIdsForGroup("spread")
    finally:
        spark.sparkContext._jsc.clearJobGroup()
