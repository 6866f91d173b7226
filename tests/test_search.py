"""Search over variants, ensembles, rankings and the held-out run, on planted data and against plain versions."""

import os

import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F
from test_expanding import panel_of

from panelloom.operators import backtest as bt
from panelloom.operators import ensemble
from panelloom.operators import expanding as ex
from panelloom.operators.search import searched
from panelloom.plans import models
from panelloom.sources.panels import orders_panel

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def test_a_trial_is_a_backtest_of_its_own(spark):
    pick = np.random.default_rng(3)
    panel = panel_of(spark, {"a": pick.poisson(3, 150), "b": pick.poisson(9, 150), "c": [2] * 150}).cache()
    variants = {"lags": ("lag_1", "lag_7"), "all": (*ex.PAST, *ex.AHEAD)}
    trials = [(0, "lags", 0.5, 14), (1, "all", 2.0, 28), (2, "all", 1e-3, 14), (3, "lags", 100.0, 42)]
    got = {r.number: r for r in searched(panel, 100, variants, trials, (1, 4)).collect()}
    y = {r: [x.y for x in sorted(panel.filter(F.col("region") == r).collect(), key=lambda x: x.t_idx)] for r in "ab"}
    for number, variant, ridge, retrain in trials:
        one = ex.expanding_backtest(ex.direct_rows(panel, (1, 4)), ex.glm("gaussian", variants[variant], ridge=ridge), 100, retrain=retrain).collect()
        scaled = []
        for region in "ab":  # c has no scale
            error = np.sqrt(np.mean([(r.y_pred - r.y_true) ** 2 for r in one if r.region == region]))
            scaled.append(error / np.sqrt(np.mean([(y[region][t] - y[region][t - 7]) ** 2 for t in range(7, 100)])))
        assert abs(got[number].value - np.mean(scaled)) < 1e-8 and got[number].variant == variant
    for variant in variants:
        own = [r for r in got.values() if r.variant == variant]
        assert [r.number for r in own if r.best] == [min(own, key=lambda r: r.value).number]


@tables
def test_the_query_has_a_winner_for_each_variant(spark):
    got = models.QUERIES["tune_random_search"](spark, SF).toPandas()
    assert len(got) == 50 and got.value.gt(0).all() and (got[got.best].variant.value_counts() == 1).all() and got.best.sum() == len(models._VARIANTS)


# --- self-paced ensemble ---


def planted(spark, n=6000, seed=1):
    """Three positives in a hundred, where two features meet, with noise about."""
    pick = np.random.default_rng(seed)
    x = pick.random((n, 4))
    chance = 0.005 + 0.5 * ((x[:, 0] > 0.8) & (x[:, 1] > 0.7)) + 0.08 * (x[:, 2] > 0.9)
    rows = [(i, [float(v) for v in a], float(pick.random() < c)) for i, (a, c) in enumerate(zip(x, chance, strict=True))]
    return spark.createDataFrame(rows, "i int, x array<double>, active double").select("i", "active", array_to_vector("x").alias("features"))


def average_precision(y, p):
    order = np.argsort(-p, kind="stable")
    y = y[order]
    return float((np.cumsum(y) / np.arange(1, len(y) + 1))[y > 0].mean())


def test_twenty_members_beat_one_tree(spark):
    train, test = planted(spark), planted(spark, seed=2)
    score = {}
    for members in (1, 20):
        got = ensemble.self_paced(train, test, ["i"], members=members).toPandas()
        assert len(got) == 6000 and got.y_prob.between(0, 1).all()
        score[members] = average_precision(got.active.to_numpy(), got.y_prob.to_numpy())
    assert score[20] > score[1]
    assert ensemble.self_paced(train.filter("active = 0"), test, ["i"], members=2).filter("y_prob <> 0").count() == 0


# --- rankings ---


def test_planted_features_come_first(spark):
    pick = np.random.default_rng(6)
    n = 500
    a, b = pick.poisson(8, (4, n)), pick.poisson(8, (4, n))
    rows = []
    for k in range(4):
        for t in range(n):
            y = int(3 * a[k, t - 9] + b[k, t - 4]) if t >= 9 else 0
            rows.append((f"r{k}", t, y, *(int(v) for v in (a[k, t], b[k, t])), *(int(v) for v in pick.poisson(5, 4))))
    panel = spark.createDataFrame(rows, "region string, t_idx int, y long, revenue_cents long, urgent long, high long, medium long, notspec long, low long").withColumn("event_date", F.expr("date_add(date'2020-01-01', t_idx)"))
    gains = models._importances(spark, None, horizons=(1, 3), panel=panel).toPandas()
    assert gains.feature.nunique() > 200 and np.allclose(gains.groupby("horizon").gain.sum(), 1)
    first = {h: set(own.nlargest(2, "gain").feature) for h, own in gains.groupby("horizon")}
    assert "revenue_cents_lag_9" in first[1] and "revenue_cents_lag_7" in first[3]
    assert gains[gains.horizon == 1].set_index("feature").gain.rank(ascending=False)["urgent_lag_4"] <= 4


@tables
def test_rankings_over_the_whole_block(spark):
    top = models.QUERIES["topk_features"](spark, SF).toPandas()
    assert len(top) == 100 and (np.diff(top.mean_gain) <= 0).all()
    table = models.QUERIES["topk_importance"](spark, SF).toPandas()
    assert len(table) == 30 and table.sd_gain.notna().all() and table.feature.tolist() == top.feature.tolist()[:30]
    assert len(models.QUERIES["fit_feature_ranking"](spark, SF).toPandas()) > 200


# --- held-out run, regimes, two stages ---


@tables
def test_held_out_run_equals_the_linear_backtest_where_strides_agree(spark):
    key = ["region", "t0", "horizon"]
    want = models.QUERIES["bt_linear_global"](spark, SF).toPandas().set_index(key).sort_index()
    same = models.bt_test_segment(spark, SF, stride=1, retrain=28).toPandas().set_index(key).sort_index()
    assert len(same) == len(want) and np.allclose(same.y_pred, want.y_pred, atol=1e-6)
    wide = models.bt_test_segment(spark, SF, stride=5, retrain=28).toPandas().set_index(key).sort_index()
    assert len(wide) < len(want) / 4 and np.allclose(wide.y_pred, want.y_pred[wide.index], atol=1e-6)
    often = models.QUERIES["bt_test_segment"](spark, SF).toPandas().set_index(key).sort_index()
    assert len(often) == len(want) and not np.allclose(often.y_pred, want.y_pred, atol=1e-6)


@tables
@pytest.mark.parametrize("name", ["hurdle_backtest_by_tier", "hurdle_backtest_by_region", "bt_known_future", "bt_linear_by_tier", "bt_linear_by_region", "fit_ar7_expanding"])
def test_no_worse_than_zero_and_last(spark, name):
    """Over the held-out steps: a smaller error than the last value, and than nothing at all."""
    panel = orders_panel(spark, SF)
    got = models.QUERIES[name](spark, SF).withColumnRenamed("t_idx", "t0").filter("y_pred IS NOT NULL")
    got = got.withColumnRenamed("y", "y_true") if "y" in got.columns else got
    last = panel.select("region", (F.col("t_idx") + 1).alias("t0"), F.col("y").alias("last"))
    sq = lambda c: F.avg((F.col(c) - F.col("y_true")) ** 2)
    r = got.withColumn("zero", F.lit(0)).join(last, ["region", "t0"]).agg(sq("y_pred").alias("own"), sq("last").alias("last"), sq("zero").alias("zero"), F.count("*").alias("n")).first()
    assert r.n > 20_000 and r.own < r.last and r.own < r.zero


@tables
def test_two_stages_against_the_product_of_averages(spark):
    panel = orders_panel(spark, SF)
    start = int(0.8 * bt.length(panel))
    got = models.QUERIES["hurdle_two_stage_backtest"](spark, SF)
    truth = panel.select("region", "t_idx", (F.col("urgent") > 0).cast("int").alias("hit"))
    flat = panel.filter(F.col("t_idx") < start).groupBy("region").agg((F.avg((F.col("y") > 0).cast("int")) * F.avg(F.when(F.col("y") > 0, (F.col("urgent") > 0).cast("int")))).alias("flat"))
    both = got.withColumn("t_idx", F.col("t0") + F.col("horizon") - 1).join(truth, ["region", "t_idx"]).join(flat, "region")
    r = both.agg(F.avg((F.col("y_prob") - F.col("hit")) ** 2).alias("own"), F.avg((F.col("flat") - F.col("hit")) ** 2).alias("flat"), F.min("y_prob").alias("a"), F.max("y_prob").alias("b"), F.max(F.abs(F.col("y_prob") - F.col("y_first") * F.col("y_given"))).alias("d")).first()
    assert r.own <= r.flat + 1e-3 and 0 <= r.a < r.b <= 1 and r.d < 1e-12


def test_venn_abers_query(spark):
    if not os.path.isdir(SF):
        pytest.skip("no tables")
    got = models.QUERIES["cal_venn_abers"](spark, SF).toPandas()
    assert set(got.horizon) == set(range(1, 8)) and got.p.between(0, 1).all()
