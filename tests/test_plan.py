from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from plotweave.operators import targeting
from plotweave.plans import catalogue, coverage


def test_a_plan_is_held_against_random_points(spark):
    rng = np.random.default_rng(1)
    xy = rng.uniform(0, 1000, (150, 2))
    rows = [(float(x), float(y), float(3 * np.sin(x / 200)), float(2 * np.cos(y / 250))) for x, y in xy]
    pairs = spark.createDataFrame(rows, "x double, y double, rx double, ry double")
    cand = pairs.select("x", "y")
    plan = np.array([(x, y) for x in (100.0, 350.0, 600.0, 850.0) for y in (100.0, 350.0, 600.0, 850.0)])
    got = targeting.validate_plan(targeting.Uncertainty(200.0, 6.0, 0.01), plan, cand, pairs)
    assert got["achieved"] < got["before"] and got["achieved"] > 0 and got["random"] > 0
    assert np.isnan(targeting.achieved_rmse(targeting.Uncertainty(), plan[:2], pairs))


def test_samples_of_any_size(spark, monkeypatch):
    """A bound far above the table takes no room and drops nothing; both ways of sampling take the same rows."""
    df = spark.range(3000).select((F.col("id") % 1000).alias("a"), (F.col("id") % 500 / 4).alias("b"))
    rows = Counter(df.collect())
    assert Counter(targeting.sampled(df, 10**9).collect()) == rows
    small = {n: Counter(targeting.sampled(df, n, 5).collect()) for n in (0, 1, 700, 2999, 3000, 3001)}
    monkeypatch.setattr(targeting, "TASK_SAMPLE", -1)
    for n, want in small.items():
        got = Counter(targeting.sampled(df, n, 5).collect())
        assert got == want and sum(got.values()) == min(n, 3000) and got <= rows
    assert targeting.sampled(df.limit(0), 10).count() == 0


def test_all_corners(spark, data):
    got = coverage.candidate_corners(spark, data).collect()
    k = [r["k"] for r in catalogue.table(spark, data, "supplier").select(F.col("s_suppkey").alias("k")).collect()]
    assert {tuple(r) for r in got} == {(100.0 * i + x, y, 1) for i in k for x in (0.0, 10.0) for y in (0.0, 10.0)} and len(got) == 4 * len(k)
