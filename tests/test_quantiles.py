"""Exact percentiles and order statistics against Spark's buffer and against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from penlight.operators import evaluate, quantiles

FRACTIONS = [0.0, 0.013, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0]


@pytest.fixture(params=[20_000, 400])
def accuracy(request, monkeypatch):
    """As it is, where these tables lie between their bounds whole; and so coarse that bounds are taken from the sketch."""
    monkeypatch.setattr(quantiles, "ACCURACY", request.param)
    monkeypatch.setattr(quantiles, "MARGIN", 6 / request.param)
    return request.param


def table(spark, n=6000):
    rng = np.random.default_rng(4)
    # One key has half of the rows.
    keys = np.where(rng.random(n) < 0.5, "hot", rng.choice(["a", "b", None, "c"], n).astype(object))
    x = np.round(rng.normal(size=n), 2) * 10.0 ** rng.integers(-3, 4, n)
    y = rng.integers(0, 5, n).astype(float)
    y[::7], y[::11], x[5], x[6] = np.nan, 1e300, np.inf, -np.inf
    rows = [(k, None if i % 13 == 0 else float(a), float(b)) for i, (k, a, b) in enumerate(zip(keys, x, y))]
    return spark.createDataFrame([*rows, ("lone", 3.5, None), ("none", None, None)], "key string, x double, y double")


def expected(df, c, keys):
    value = F.when(~F.isnan(c), F.col(c))
    return {tuple(r[k] for k in keys): (r.n, r.q) for r in df.groupBy(*keys).agg(F.count(value).alias("n"), F.percentile(value, F.array(*[F.lit(p) for p in FRACTIONS])).alias("q")).collect() if r.n}


@pytest.mark.parametrize("keys", [(), ("key",)])
def test_percentiles_equal_the_buffered_ones(spark, accuracy, keys):
    df = table(spark)
    found = quantiles.percentiles(df, ["x", "y"], FRACTIONS, keys).collect()
    for c in ("x", "y"):
        assert {tuple(r[k] for k in keys): (r.n, r.quantiles) for r in found if r.feature == c} == expected(df, c, keys)


def test_percentiles_of_nothing(spark):
    df = table(spark).where("false")
    assert quantiles.percentiles(df, ["x"], [0.5]).count() == 0
    assert quantiles.one_row(df, ["x", "y"], [0.5]).collect() == [(None, None)]


def test_few_values_pass_the_bounds(spark, accuracy):
    """What the second pass sorts is a small share of the values once there are many."""
    df = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(10**9)).cast("double").alias("x"))
    plan = quantiles.percentiles(df, ["x"], [0.5])
    assert plan.head().quantiles[0] == df.agg(F.percentile("x", F.lit(0.5))).head()[0]
    low, high = df.agg(F.percentile_approx("x", [0.5 - quantiles.MARGIN, 0.5 + quantiles.MARGIN], accuracy)).head()[0]
    assert df.where(F.col("x").between(low, high)).count() <= 14.5 / accuracy * 200_000 + 2


def test_values_at_ranks(spark, accuracy):
    df = table(spark)
    ordered = sorted(r.x for r in df.collect() if r.x is not None)
    ranks = [(i, i) for i in range(4000, 4400, 7)] + [(1, 4000)]
    found = quantiles.at_ranks(df, "x", spark.createDataFrame(ranks, "id int, rank long"), 4000, 4399, len(ordered)).collect()
    assert sorted((r.id, r.rank, r.value) for r in found) == sorted((i, r, ordered[r]) for i, r in ranks)


def test_bootstrap_has_the_interval_of_resampling(spark):
    rng = np.random.default_rng(0)
    errors = rng.gamma(2.0, size=400)
    found = evaluate.bootstrap_percentile(spark.createDataFrame([(float(e),) for e in errors], "error double"), 95.0).head()
    drawn = np.percentile(rng.choice(errors, size=(4000, 400)), 95, axis=1)
    low, middle, high = np.quantile(drawn, [0.05, 0.5, 0.95])
    assert found.threshold == np.percentile(errors, 95) and found.replicates == 2000 and found.n_samples == 400
    spread = high - low
    assert abs(found.ci_low - low) < 0.15 * spread and abs(found.ci_high - high) < 0.15 * spread and abs(found["median"] - middle) < 0.15 * spread
    assert found.relative_width == (found.ci_high - found.ci_low) / found.threshold


def test_bootstrap_of_one_error_and_of_none(spark):
    one = evaluate.bootstrap_percentile(spark.createDataFrame([(2.0,), (None,), (float("nan"),)], "error double"), 99.0).head()
    assert (one.threshold, one.ci_low, one.ci_high, one.n_samples, one.relative_width) == (2.0, 2.0, 2.0, 1, 0.0)
    none = evaluate.bootstrap_percentile(spark.createDataFrame([], "error double"), 99.0).head()
    assert none.threshold is None and none.n_samples == 0
    two = evaluate.bootstrap_percentile(spark.createDataFrame([(1.0,), (3.0,)], "error double"), 100.0, replicates=300).head()
    assert (two.ci_low, two.ci_high) == (1.0, 3.0)
