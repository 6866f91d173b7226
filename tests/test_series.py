"""Stationarity with lags and autoregression with differencing, against plain versions in numpy."""

import os

import numpy as np
import pytest
from test_models import kpss

from panelloom.operators import backtest as bt
from panelloom.operators import series
from panelloom.plans import models
from panelloom.sources.panels import orders_panel

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def panel_of(spark, held):
    return spark.createDataFrame([(k, t, int(v)) for k, x in held.items() for t, v in enumerate(x)], "region string, t_idx int, y long").repartition(5)


def augmented(v, most):
    """The Dickey-Fuller regression for each number of lags over the same rows; that of the least criterion."""
    v = np.asarray(v, float)
    d = np.diff(v)
    at = np.arange(most + 1, len(v))  # rows whose lags are all there
    best = None
    for lags in range(most + 1):
        x = np.column_stack([np.ones(len(at)), v[at - 1], *(d[at - 1 - i] for i in range(1, lags + 1))])
        y = d[at - 1]
        beta, *_ = np.linalg.lstsq(x, y, rcond=None)
        left = float(((y - x @ beta) ** 2).sum())
        score = len(at) * np.log(left / len(at)) + 2 * x.shape[1]
        if best is None or score < best[0] - 1e-9:
            best = (score, lags, beta[1] / np.sqrt(left / (len(at) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]))
    return best[2], best[1]


def test_statistics_with_lags(spark):
    pick = np.random.default_rng(5)
    ar = [0.0, 0.0, 0.0]
    for e in pick.normal(0, 9, 260):
        ar.append(0.5 * ar[-1] - 0.6 * ar[-2] + 0.3 * ar[-3] + e)
    held = {"noise": pick.poisson(9, 200), "walk": np.cumsum(pick.integers(-5, 6, 200)), "ar": np.round(ar), "short": pick.poisson(3, 12), "weekly": pick.poisson(3 + 3 * (np.arange(150) % 7 == 0))}
    got = {(r.region, r.differenced): r for r in series.stationarity(panel_of(spark, held)).collect()}
    assert len(got) == 2 * len(held)
    for k, v in held.items():
        for differenced in (False, True):
            x, r = (np.diff(v) if differenced else v), got[k, differenced]
            n = len(x)
            most = int(min(np.floor(12 * (n / 100) ** 0.25), n // 2 - 3, series.MOST_LAGS))
            t, lags = augmented(x, most)
            assert r.lags == lags and abs(r.df_t - t) < 1e-6 * max(1, abs(t)), (k, differenced)
            assert abs(r.kpss - kpss(list(map(float, x)))) < 1e-9
    assert got["noise", False].stationary and not got["walk", False].stationary and got["walk", True].stationary
    assert got["ar", False].lags >= 2


def test_odd_series_have_defined_results(spark):
    """Spikes, alternation, trends, constants and a few steps: no division by zero, and the defined values."""
    held = {
        "spike": [0] * 30 + [9] + [0] * 30, "last": [0] * 40 + [1], "alternating": [1, 5] * 30, "trend": list(range(60)), "flat": [4] * 50, "three": [1, 2, 1], "two": [1, 2], "one": [7],
        "balanced": [0, 1, 0, -1] * 15, "seven": [3, 1, 4, 1, 5, 9, 2], "eight": [3, 1, 4, 1, 5, 9, 2, 6],
    }
    got = {(r.region, r.differenced): r for r in series.stationarity(panel_of(spark, held)).collect()}
    assert len(got) == 2 * len(held) - 1  # one step has no difference
    assert got["flat", False].stationary and got["spike", False].df_t < -7 and got["spike", False].stationary == (got["spike", False].kpss < series.KPSS_CUT)
    assert got["balanced", False].df_t is None and got["balanced", False].kpss > 0  # its autocovariances cancel, so no lag is chosen from them
    assert got["alternating", False].kpss == pytest.approx(0.5) and not got["alternating", False].stationary  # it falls back, but the sums' spread speaks against a level
    assert got["trend", True].stationary
    assert not got["trend", False].stationary and got["trend", False].df_t is None and got["alternating", False].df_t is None
    for k in ("three", "two", "seven"):
        assert (got[k, False].df_t, got[k, False].kpss, got[k, False].stationary) == (None, None, False)
    assert got["one", False].stationary and got["flat", True].stationary


@tables
def test_profiles(spark):
    both = models.QUERIES["profile_stationarity_both"](spark, SF).toPandas()
    assert len(both) == 50 and both.kpss.notna().all() and both.stationary.mean() > 0.9


# --- autoregression ---


def plain(y, cut, order, ridge=1e-6):
    """Order of differencing and coefficients from steps before ``cut``."""
    v = np.asarray(y[:cut], float)
    if len(v) - order - 1 <= 2 * (order + 2):
        return 0, None
    d = np.diff(v)
    at = np.arange(order + 1, len(v))
    best = None
    for lags in range(order):
        x = np.column_stack([np.ones(len(at)), v[at - 1], *(d[at - 1 - i] for i in range(1, lags + 1))])
        beta = np.linalg.lstsq(x, d[at - 1], rcond=None)[0]
        left = float(((d[at - 1] - x @ beta) ** 2).sum())
        score = len(at) * np.log(left / len(at)) + 2 * x.shape[1]
        if best is None or score < best[0] - 1e-9:
            best = (score, beta[1] / np.sqrt(left / (len(at) - x.shape[1]) * np.linalg.inv(x.T @ x)[1, 1]))
    by = 0 if best[1] < series.DF_CUT else 1
    s = d if by else v
    now = at - by
    x = np.column_stack([np.ones(len(at)), *(s[now - i] for i in range(1, order + 1))])
    return by, np.linalg.solve(x.T @ x + ridge * np.eye(order + 1), x.T @ s[now])


def test_each_refit_chooses_its_order_and_forecasts_by_recursion(spark):
    pick = np.random.default_rng(0)
    held = {"still": pick.poisson(20, 150), "walk": np.cumsum(pick.integers(-6, 7, 150)) + 500, "late": np.concatenate([pick.poisson(9, 70), 9 + np.cumsum(pick.integers(-8, 9, 80))]), "flat": np.full(150, 6)}
    start, retrain, order = 60, 15, 3
    got = series.autoregressive_backtest(panel_of(spark, held), start, order, retrain).collect()
    assert len(got) == 4 * (7 * (150 - start) - 21)
    assert {r.d for r in got if r.region == "still"} == {0} and {r.d for r in got if r.region == "walk"} == {1}
    assert {r.d for r in got if r.region == "late"} == {0, 1}
    assert all(abs(r.y_pred - 6) < 1e-3 for r in got if r.region == "flat")
    for r in got:
        if r.region == "flat" or r.t0 % 7:
            continue
        y = held[r.region].astype(float)
        cut = start + (r.t0 - start) // retrain * retrain
        d, beta = plain(y, cut, order)
        known = list(y[: r.t0])
        s = list(np.diff(known)) if d else known
        for _ in range(r.horizon):
            s.append(float(beta[0] + sum(beta[i] * s[-i] for i in range(1, order + 1))))
        want = known[-1] + sum(s[-r.horizon :]) if d else s[-1]
        assert r.d == d and abs(r.y_pred - want) < 1e-5 * max(1, abs(want)) and r.y_true == y[r.t0 + r.horizon - 1]


def test_too_few_steps(spark):
    got = series.autoregressive_backtest(panel_of(spark, {"a": [1, 2, 3] * 10}), 10, 7).collect()
    assert got and all(r.y_pred is None for r in got if r.t0 < 26)
    assert series.autoregressive_backtest(panel_of(spark, {"a": [1, 2, 3]}), 10).count() == 0


@tables
def test_the_query_s_forecasts(spark):
    got = models.QUERIES["fit_arima_expanding"](spark, SF).toPandas()
    panel = orders_panel(spark, SF)
    n = bt.length(panel)
    assert len(got) == 25 * (7 * (n - int(0.8 * n)) - 21) and got.y_pred.notna().all()
    assert ((got.y_pred - got.y_true) ** 2).mean() < 1.1 * got.y_true.var()
