"""Models over whole tables, against DuckDB on the small tables."""

import os

import duckdb
import pytest

from panelloom.operators import backtest as bt
from panelloom.plans import models
from panelloom.sources.panels import orders_panel

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def db():
    held = duckdb.connect()
    for name in ("orders", "customer", "nation"):
        held.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return held


def same(spark, db, name):
    got, want = models.QUERIES[name](spark, SF).toPandas(), db.sql(models.SQL[name]).df()[lambda d: d.columns]
    keys = [c for c in ("region", "fold", "horizon", "t_idx") if c in got]
    got, want = (x[sorted(x)].sort_values(keys, ignore_index=True) for x in (got, want))
    import pandas as pd

    pd.testing.assert_frame_equal(got, want, check_dtype=False, atol=1.1e-4)
    return got


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_whole_ranges(spark, db):
    panel = orders_panel(spark, SF)
    n, regions = bt.length(panel), panel.select("region").distinct().count()
    start = int(0.8 * n)
    found = same(spark, db, "fcst_sample_quantiles")
    assert len(found) == regions * 7 * (n - 7 - start + 1) and found.fold.max() == n - 7 - start
    assert len(same(spark, db, "fit_ar1_expanding")) == regions * n
    trained = panel.filter(f"t_idx < {start} AND urgent > 0").count()
    assert same(spark, db, "fit_positive_mean_fallback").n_positive.sum() == trained
    assert len(same(spark, db, "fit_single_class_fallback")) == regions


def test_autoregression_is_a_refit_at_each_step(spark):
    import numpy as np

    from panelloom.operators import learners as ln

    y = np.random.default_rng(2).poisson(4, 60).tolist()
    panel = spark.createDataFrame([("a", t, v) for t, v in enumerate(y)] + [("b", t, 3) for t in range(60)], "region string, t_idx int, y long")
    got = {(r.region, r.t_idx): r.y_pred for r in ln.autoregression(panel).collect()}
    x = np.array([[1.0, *y[t - 7 : t][::-1]] for t in range(7, 60)])
    for t in range(60):
        n = t - 7
        if n <= 8:
            assert got["a", t] is None
        else:
            beta = np.linalg.lstsq(x[:n], np.array(y[7:t], float), rcond=None)[0]
            assert abs(got["a", t] - x[n] @ beta) < 1e-3
    assert abs(got["b", 59] - 3) < 1e-3


def kpss(v):
    """As published, in plain loops."""
    n, e = len(v), [a - sum(v) / len(v) for a in v]
    g = lambda lag: sum(a * b for a, b in zip(e[lag:], e, strict=False))
    few = int(n ** (2 / 9))
    s0, s1 = g(0) / n + sum(2 * g(i) / n for i in range(1, few + 1)), sum(i * 2 * g(i) / n for i in range(1, few + 1))
    lags = min(int(1.1447 * ((s1 / s0) ** 2) ** (1 / 3) * n ** (1 / 3)), n - 1)
    total, eta = 0.0, 0.0
    for a in e:
        total += a
        eta += total * total
    return eta / n**2 / ((g(0) + 2 * sum((1 - i / (lags + 1)) * g(i) for i in range(1, lags + 1))) / n)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_every_horizon(spark):
    week = {1, 2, 3, 4, 5, 6, 7}
    of = lambda name: {r.horizon for r in models.QUERIES[name](spark, SF).select("horizon").distinct().collect()}
    assert of("bt_linear_global") == of("multi_target_backtest") == of("hurdle_backtest") == week
    drops = models.importance_permutation(spark, SF).toPandas()
    assert set(drops.horizon) == week and len(drops) == 7 * len(models.COLUMNS) and drops.sd_drop.notna().all()
    assert {f"{h}" for h in week} <= set(models.importance_by_horizon(spark, SF).columns)
    trials = models.tune_random_search(spark, SF).toPandas()
    assert sorted(trials.number) == list(range(50)) and trials.value.gt(0).all()
