"""Small panels by hand, identities and leakage."""

import math

import pytest
from pyspark.sql import functions as F

from panelloom.operators import backtest as bt
from panelloom.operators import learners as ln
from panelloom.operators import metrics as m
from panelloom.operators import reshape as rs
from panelloom.operators import windows as w
from panelloom.sources.panels import tiers


@pytest.fixture(scope="module")
def panel(spark):
    rows = [(r, t, (t * k) % 5 * k) for k, r in enumerate(("a", "b", "c", "d"), 1) for t in range(60)]
    return spark.createDataFrame(rows, "region string, t_idx int, y long").withColumn("event_date", F.date_add(F.lit("2024-01-01").cast("date"), "t_idx"))


def test_tier_filter_keeps_unknown(panel):
    kept = tiers(panel).filter(~F.col("tier").eqNullSafe(0))
    assert kept.filter("tier IS NULL").count() == 1 and kept.count() == 3


def test_row_total_takes_nulls_as_zero(spark):
    df = spark.createDataFrame([(None, None), (1, None), (1, 2)], "a long, b long")
    assert [r.t for r in df.select(rs.row_total(["a", "b"]).alias("t")).collect()] == [0, 1, 3]


def test_wide_to_long_splits_at_the_last_underscore(spark):
    df = spark.createDataFrame([("2024-01-01", 1, 2, 9)], "event_date string, `x_y_north-east` long, x_y_b long, total long")
    got = {(r.region, r.x_y, r.total) for r in rs.wide_to_long(df, ["north-east", "b"], "event_date").collect()}
    assert got == {("north-east", 1, 9), ("b", 2, 9)}


def test_pair_inside_one_group_names_it_twice(spark):
    flows = spark.createDataFrame([("d", "p", "q", 1), ("d", "q", "r", 2), ("d", "r", "p", 3)], "event_date string, a string, b string, value long")
    groups = spark.createDataFrame([("p", "g"), ("q", "g"), ("r", "h")], "member string, grp string")
    assert {(r.pair, r.value) for r in rs.pair_rollup(flows, groups, "f").collect()} == {("f_g_g", 1), ("f_g_h", 5)}


@pytest.mark.parametrize(("adjust", "shift"), [(True, 0), (False, 0), (True, 1), (False, 1)])
def test_ewm_against_the_recurrence(panel, adjust, shift):
    alpha, rows = 0.3, panel.select("region", "t_idx", "y", w.ewm("y", 0.3, adjust, shift).alias("e")).filter("region = 'b'").orderBy("t_idx").collect()
    values = [r.y for r in rows]
    for t, r in enumerate(rows):
        past = values[: t + 1 - shift]
        if not past:
            assert r.e is None
        elif adjust:
            weights = [(1 - alpha) ** (len(past) - 1 - i) for i in range(len(past))]
            assert math.isclose(r.e, sum(a * b for a, b in zip(weights, past, strict=True)) / sum(weights), abs_tol=1e-9)
        else:
            s = past[0]
            for v in past[1:]:
                s = alpha * v + (1 - alpha) * s
            assert math.isclose(r.e, s, abs_tol=1e-9)


def test_half_life_helpers():
    assert math.isclose(w.retention_from_halflife(7), 0.9057236642639067)
    assert math.isclose(w.halflife_from_alpha(w.retention_from_halflife(7)), 7)
    assert math.isclose(w.alpha_from_halflife(1), 0.5)


def test_boundaries_are_python_doubles():
    assert bt.split_after_idx(2405, 0.7 + 0.1) == int(2404 * 0.7999999999999999)


def test_fold_count_and_targets(panel):
    p = bt.long_predictions(panel, start=40)
    assert p.count() == 4 * (60 - 7 - 40 + 1) * 7
    first = p.filter("region = 'a' AND fold = 0 AND horizon = 3").first()
    assert (first.y_true, first.y_pred, first.y_last) == (42 % 5, 35 % 5, 39 % 5)


def test_weekly_naive_refuses_long_horizons(panel):
    with pytest.raises(ValueError):
        bt.naive_weekly(panel, bt.folds(panel, 40, 8), 8)
    with pytest.raises(ValueError):
        bt.naive(panel, bt.folds(panel, 40), "other")


def test_views_agree(panel):
    p = bt.long_predictions(panel, start=40)
    v = m.views(p, m.metric("MAE").alias("mae"), F.count("*").alias("n")).collect()
    whole = next(r for r in v if r["view"] == "global")
    for name in ("region", "horizon", "region_horizon"):
        part = [r for r in v if r["view"] == name]
        assert math.isclose(sum(r.mae * r.n for r in part) / sum(r.n for r in part), whole.mae)
    assert {r["view"]: sum(x["view"] == r["view"] for x in v) for r in v} == {"global": 1, "region": 4, "horizon": 7, "region_horizon": 28}


def test_roc_auc_counts_ties_half(spark):
    df = spark.createDataFrame([("k", 0.2, 0), ("k", 0.5, 1), ("k", 0.5, 0), ("k", 0.9, 1), ("one", 0.3, 1)], "region string, y_prob double, y_true int")
    got = {r.region: r.roc_auc for r in m.roc_auc(df, ["region"]).collect()}
    assert got == {"k": 3.5 / 4, "one": None}
    assert math.isclose({r.region: r.pr_auc for r in m.pr_auc(df, ["region"]).collect()}["k"], 0.5 * 1 + 0.5 * 2 / 3)


def test_linear_backtest_matches_a_refit(panel):
    import numpy as np

    got = ln.linear_backtest(panel, ["region"], 45, horizons=(1, 3), retrain=5).collect()
    rows = {(r.region, r.t_idx): r for r in ln.tabular(panel).collect()}
    assert len(got) > 50
    for g in got[::9]:
        cutoff = 45 + (g.t0 - 45) // 5 * 5
        used = [(r, rows[k[0], k[1] + g.horizon - 1].label) for k, r in rows.items() if k[0] == g.region and k[1] + g.horizon - 1 < cutoff]
        x = np.array([[1, r.lag_1, r.lag_7, r.mean_28] for r, _ in used])
        beta = np.linalg.solve(x.T @ x + 1e-6 * np.eye(4), x.T @ np.array([y for _, y in used]))
        here = rows[g.region, g.t0]
        assert math.isclose(g.y_pred, float(beta @ [1, here.lag_1, here.lag_7, here.mean_28]), abs_tol=1e-5)


def test_platt_keeps_order_and_skips_single_classes(spark):
    rows = [(1, p / 20, int(p * 7 % 20 < p)) for p in range(1, 20)] * 5 + [(2, 0.5, 1)]
    df = spark.createDataFrame(rows, "horizon int, y_prob double, y_true int")
    fits = ln.platt(df)
    assert [r.horizon for r in fits.collect()] == [1] and fits.first().b > 0
    assert ln.calibrated(df, fits).filter("horizon = 2").first().y_cal == 0.5


def test_venn_abers_is_a_probability(spark):
    rows = [(1, p / 20, int(p > 9)) for p in range(1, 20)]
    df = spark.createDataFrame(rows, "horizon int, y_prob double, y_true int")
    got = ln.venn_abers(df, df).orderBy("score").collect()
    assert len(got) == 19 and all(0 < r.p < 1 for r in got) and got[0].p < 0.5 < got[-1].p


def test_asof_takes_the_latest_before(spark):
    left = spark.createDataFrame([("a", 5, "x"), ("a", 1, "y")], "region string, t0 int, name string")
    right = spark.createDataFrame([("a", 1, 10), ("a", 4, 40), ("a", 5, 50)], "region string, t_idx int, y int")
    assert {(r.name, r.v) for r in rs.asof(left, right, "region", "t0", "t_idx", "y", "v").collect()} == {("x", 40), ("y", None)}
