"""Draws of hurdle forecasts against the mixture's exact quantiles."""

import math
import os

import numpy as np
import pytest

from panelloom.operators import quantiles as qt
from panelloom.plans import models

SF = "/root/testdata/sf0.001"


def exact(p, mean, level, count):
    """The least value whose distribution function reaches the level."""
    total, k, m = 1 - p, 0, max(mean, 1.0) - 1
    term = math.exp(-m) if count == "poisson" else 1 / (m + 1)
    while total < level:
        total += p * term
        k += 1
        term *= m / k if count == "poisson" else m / (m + 1)
    return k


@pytest.mark.parametrize("count", ["poisson", "geometric"])
def test_quantiles_of_many_draws_are_those_of_the_mixture(spark, count):
    cases = [(p, m) for p in (0.05, 0.3, 0.62, 0.97, 1.0) for m in (1.0, 1.4, 3.3, 20.0)]
    rows = spark.createDataFrame([(i, p, m, p * m) for i, (p, m) in enumerate(cases)], "i int, y_prob double, y_count double, y_pred double")
    got = {r.i: r for r in qt.sampled(rows, ["i"], (0.2, 0.5, 0.8), draws=20_000, count=count).collect()}
    for i, (p, m) in enumerate(cases):
        for level in (0.2, 0.5, 0.8):
            lo, hi = (exact(p, m, level + d, count) for d in (-0.015, 0.015))
            assert lo <= got[i][f"y_q{round(level * 100)}"] <= hi, (p, m, level)


def test_quantiles_are_those_of_the_draws_themselves(spark):
    """Every draw of a few rows, turned into values one by one, and numpy's quantiles of them; the same twice."""
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, 0.1 + 0.04 * i, 1 + 0.3 * i, 1.0) for i in range(20)], "i int, y_prob double, y_count double, y_pred double")
    found = qt.sampled(rows, ["i"], (0.1, 0.5, 0.75)).orderBy("i").collect()
    assert found == qt.sampled(rows.repartition(3), ["i"], (0.1, 0.5, 0.75)).orderBy("i").collect()
    assert [r.y_q50 for r in qt.sampled(rows, ["i"], (0.5,), seed=2).orderBy("i").collect()] != [r.y_q50 for r in found]
    mean = F.col("y_count") - 1
    every = rows.select("i", "y_prob", "y_count", F.explode(qt.uniforms(["i"], 200, 1)).alias("u"), qt.poisson_steps(mean).alias("s"))
    values = {}
    for r in every.select("i", qt.drawn(F.col("u"), F.col("y_prob"), F.col("y_count"), F.col("s")).alias("v")).collect():
        values.setdefault(r.i, []).append(r.v)
    for r in found:
        assert len(values[r.i]) == 200
        assert np.allclose([r.y_q10, r.y_q50, r.y_q75], np.quantile(values[r.i], [0.1, 0.5, 0.75]))


def test_odd_rows_and_large_means(spark):
    rows = spark.createDataFrame([(1, None, 2.0, 5.0), (2, 0.5, None, 5.0), (3, 0.0, 9.0, 0.0), (4, 1.0, 5000.0, 5000.0)], "i int, y_prob double, y_count double, y_pred double")
    got = {r.i: r for r in qt.picked(qt.sampled(rows, ["i"])).collect()}
    assert got[1].y_q50 is None and got[1].y_point == 5 and got[2].y_point == 5
    assert got[3].y_q90 == 0 and abs(got[4].y_q50 - 5000) < 40 and abs((got[4].y_q90 - got[4].y_q10) / math.sqrt(4999) - 2 * 1.2816) < 0.5
    assert qt.picked(rows, 0.3).filter("y_point <=> y_pred").count() == 4
    with pytest.raises(ValueError):
        qt.sampled(rows, ["i"], count="unknown")


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_quantiles_of_the_hurdle_s_forecasts(spark):
    got = models.QUERIES["fcst_hurdle_quantiles"](spark, SF).toPandas()
    assert set(got.horizon) == set(range(1, 8)) and (got.y_q10 <= got.y_med).all() and (got.y_med <= got.y_q90).all() and (got.y_point == got.y_med).all()
    assert 0.75 <= ((got.y_true >= got.y_q10) & (got.y_true <= got.y_q90)).mean()
