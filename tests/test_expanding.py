"""Backtests with a model argument, on planted panels and against the naive forecasts."""

import math
import os

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from panelloom.operators import backtest as bt
from panelloom.operators import expanding as ex
from panelloom.plans import models
from panelloom.sources.panels import orders_panel

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def panel_of(spark, series):
    rows = [(k, t, int(v)) for k, values in series.items() for t, v in enumerate(values)]
    return spark.createDataFrame(rows, "region string, t_idx int, y long").withColumn("event_date", F.expr("date_add(date'2020-01-01', t_idx)"))


@pytest.fixture(scope="module")
def panel(spark):
    pick = np.random.default_rng(4)
    return panel_of(spark, {"a": pick.poisson(3, 140), "b": pick.poisson(0.6, 140)}).cache()


def test_rows_hold_what_is_known(panel):
    y = {(r.region, r.t_idx): r.y for r in panel.collect()}
    days = {r.t_idx: r.event_date for r in panel.collect()}
    for r in ex.direct_rows(panel, horizons=(1, 3, 7, 9)).filter("t0 IN (40, 99, 137)").collect():
        k, target = r.region, r.t0 + r.horizon - 1
        assert r.y_true == y[k, target] and r.is_weekend == (days[target].weekday() >= 5)
        assert r.lag_1 == y[k, r.t0 - 1] and r.lag_7 == y[k, r.t0 - 7] and math.isclose(r.mean_28, sum(y[k, r.t0 - i] for i in range(1, 29)) / 28)
        assert r.y_week == y[k, target - 7 * math.ceil(r.horizon / 7)]


@pytest.mark.parametrize("builder", [ex.weekly_naive, ex.glm("gaussian"), ex.glm("poisson", steps=3)])
def test_nothing_after_t0_changes_a_forecast(spark, panel, builder):
    cut = 120
    later = panel.withColumn("y", F.when(F.col("t_idx") >= cut, F.col("y") * 7 + 5).otherwise(F.col("y")))
    got = []
    for p in (panel, later):
        found = ex.expanding_backtest(ex.direct_rows(p, (1, 4)), builder, start=100, keys=("region",), retrain=10).filter(F.col("t0") <= cut).collect()
        got.append({(r.region, r.t0, r.horizon): round(r.y_pred, 9) for r in found})
    assert got[0] == got[1] and len(got[0]) == 2 * 2 * 21


def test_linear_model_is_a_refit_on_all_that_is_known(panel):
    rows = ex.direct_rows(panel, (2,))
    names = ("one", *ex.PAST, *ex.AHEAD)
    held = sorted((r for r in rows.collect() if r.region == "a"), key=lambda r: r.t0)
    found = ex.expanding_backtest(rows, ex.glm("gaussian", ridge=1e-6), start=90, keys=("region",), retrain=14).filter("region = 'a'").collect()
    assert len(found) == 140 - 1 - 90
    for r in found:
        fit = 90 + (r.t0 - 90) // 14 * 14
        known = [x for x in held if 28 <= x.t0 and x.t0 + 1 < fit]
        x = np.array([[x[n] for n in names] for x in known])
        beta = np.linalg.solve(x.T @ x + 1e-6 * np.eye(len(names)), x.T @ np.array([x.y_true for x in known], float))
        here = next(x for x in held if x.t0 == r.t0)
        assert math.isclose(r.y_pred, float(beta @ [here[n] for n in names]), rel_tol=1e-6, abs_tol=1e-6)


@pytest.mark.parametrize("sent", [100_000, 0])
@pytest.mark.parametrize("family", ["logistic", "poisson", "tweedie"])
def test_coefficients_are_recovered(spark, monkeypatch, family, sent):
    monkeypatch.setattr(ex, "BROADCAST", sent)
    pick = np.random.default_rng(1)
    x = pick.normal(size=(6000, 2))
    eta = 0.3 + 0.8 * x[:, 0] - 0.5 * x[:, 1]
    y = pick.random(6000) < 1 / (1 + np.exp(-eta)) if family == "logistic" else pick.poisson(np.exp(eta))
    frame = spark.createDataFrame([(i % 2, 1.0, float(a), float(b), float(v)) for i, ((a, b), v) in enumerate(zip(x, y, strict=True))], "k int, one double, u double, v double, y double")
    fits = ex.fitted(frame, ["k"], [ex.Glm(family, ("u", "v"), "y")]).collect()
    assert sorted(r.k for r in fits) == [0, 1]
    for r in fits:
        assert np.allclose(r.beta_y_pred, [0.3, 0.8, -0.5], atol=0.12)


def test_the_two_ways_to_sum_agree(panel, monkeypatch):
    rows, got = ex.direct_rows(panel, (1, 5)), []
    for sent in (100_000, 0):
        monkeypatch.setattr(ex, "BROADCAST", sent)
        found = ex.expanding_backtest(rows, ex.hurdle(), start=90, keys=("region",), retrain=15).collect()
        got.append({(r.region, r.t0, r.horizon): (round(r.y_prob, 8), round(r.y_count, 8)) for r in found})
    assert got[0] == got[1] and len(got[0]) == 2 * (50 + 46)


def test_no_rows_and_one_class(spark, panel):
    rows = ex.direct_rows(panel, (1,))
    assert ex.expanding_backtest(rows, ex.glm(), start=500).count() == 0
    silent = panel_of(spark, {"a": [0] * 80})
    found = ex.expanding_backtest(ex.direct_rows(silent, (1,)), ex.hurdle(), start=60).collect()
    assert len(found) == 20 and all(r.y_pred == 0 and r.y_prob < 0.02 for r in found)


@tables
def test_weekly_model_equals_the_naive_forecast(spark):
    db = duckdb.connect()
    for name in ("orders", "customer", "nation"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    want = db.sql(models.SQL["bt_model_weekly"])
    got = models.QUERIES["bt_model_weekly"](spark, SF).select(want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) > 1000


def test_hurdle_forecasts(panel):
    """A probability times a count that isn't negative, near the mean; a regime's keys are told apart."""
    rows = ex.direct_rows(panel, (1, 7))
    for keys in ((), ("region",)):
        got = ex.expanding_backtest(rows, ex.hurdle(features=("mean_28", "is_weekend")), start=110, keys=keys, retrain=60).collect()
        assert len(got) == 2 * (30 + 24)
        for k, mean in (("a", 3.0), ("b", 0.6)):
            own = [r for r in got if r.region == k]
            assert all(0 <= r.y_prob <= 1 and r.y_count >= 0 and math.isclose(r.y_pred, r.y_prob * r.y_count) for r in own)
            assert abs(sum(r.y_pred for r in own) / len(own) - mean) < 0.5 * mean + 0.3


@pytest.mark.parametrize("family", ["gaussian", "poisson"])
def test_rows_are_summed_before_they_meet_the_fits(spark, monkeypatch, family):
    """300 refits: what the steps read holds neither a row nor a value for each refit."""
    rng = np.random.default_rng(5)
    frame = pd.DataFrame({"k": rng.integers(0, 2, 900), "one": 1.0, "u": rng.normal(size=900), "known": rng.integers(0, 300, 900)})
    frame["y"] = rng.poisson(np.exp(0.5 + 0.3 * frame.u)).astype(float)
    grouped, kept = [], ex.written
    monkeypatch.setattr(ex, "_products", lambda *a, of=ex._products: grouped.append(a) or of(*a))
    monkeypatch.setattr(ex, "written", lambda df: grouped.append(df.schema) or kept(df))
    model = ex.Glm(family, ("u",), "y")
    found = {(r.k, r.fit): r for r in ex.fitted(spark.createDataFrame(frame), ["k"], [model], 300).collect()}
    assert not [f.name for s in grouped if hasattr(s, "fields") for f in s.fields if f.name == "_sees"]
    for k, fit in [(0, 20), (1, 150), (0, 299)]:
        own = frame[(frame.k == k) & (frame.known <= fit)]
        x, beta = own[["one", "u"]].to_numpy(), np.array([np.log(own.y.mean()) if family == "poisson" else 0.0, 0.0])
        for _ in range(8 if family == "poisson" else 1):
            mu = np.exp(x @ beta) if family == "poisson" else x @ beta
            w = mu if family == "poisson" else np.ones(len(x))
            step = np.linalg.solve((x * w[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (own.y.to_numpy() - mu) - 1e-3 * beta)
            beta = beta + (step / max(1.0, np.abs(step).max() / 4) if family == "poisson" else step)
        assert found[k, fit]["n_y_pred"] == len(own)
        assert np.allclose(found[k, fit]["beta_y_pred"], beta, atol=1e-9)


@tables
def test_orders_are_read_once(spark, monkeypatch):
    seen = []

    def rows(panel, **others):
        seen.append(panel.inputFiles())
        raise InterruptedError

    monkeypatch.setattr(models.ex, "direct_rows", rows)
    for run in (models.hurdle_backtest_by_tier, models.leaderboard_trained, models.component_summary_trained):
        with pytest.raises(InterruptedError):
            run(spark, SF)
    assert seen == [[], [], []]  # the panel was written before its length, tiers and rows were taken
