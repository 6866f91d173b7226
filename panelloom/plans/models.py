"""Learners, calibration, hurdle models, leaderboards and importances over the panel and its predictions."""

from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import GBTRegressor, GeneralizedLinearRegression, LinearRegression, RandomForestRegressor
from pyspark.sql import Window
from pyspark.sql import functions as F

from panelloom.operators import backtest as bt
from panelloom.operators import calibration as cal
from panelloom.operators import ensemble
from panelloom.operators import expanding as ex
from panelloom.operators import learners as ln
from panelloom.operators import metrics, quantiles, series
from panelloom.operators.search import searched
from panelloom.operators.shared import written
from panelloom.plans.base import PANEL, PREDS, Plans
from panelloom.sources.panels import orders_panel, tiers

plan = Plans()
QUERIES, SQL = plan.queries, plan.sql
R = lambda c, n=6: F.round(c, n) + 0.0
COLUMNS = [*ln.FEATURES, "is_weekend"]


def _preds(spark, sf_dir):
    return bt.long_predictions(orders_panel(spark, sf_dir))


def _split(spark, sf_dir):
    """Tabular rows before and after 80 % of the steps, with assembled features."""
    panel = orders_panel(spark, sf_dir)
    cut = int(0.8 * bt.length(panel))
    rows = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(ln.tabular(panel))
    return rows.filter(F.col("t_idx") < cut), rows.filter(F.col("t_idx") >= cut)


def _ahead(spark, sf_dir):
    """As _split, a row for each horizon: ``label`` and ``active`` of the step horizon - 1 later; training labels lie before the cut."""
    panel = orders_panel(spark, sf_dir)
    cut = int(0.8 * bt.length(panel))
    w = Window.partitionBy("region").orderBy("t_idx")
    later = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("label", h - 1).over(w).alias("label")) for h in ln.HORIZONS])
    rows = ln.tabular(panel).withColumn("later", later).withColumn("l", F.explode("later")).filter("l.label IS NOT NULL")
    rows = rows.select("region", "t_idx", *COLUMNS, "l.horizon", "l.label", (F.col("l.label") > 0).cast("double").alias("active"))
    rows = VectorAssembler(inputCols=COLUMNS, outputCol="features").transform(rows)
    return rows.filter(F.col("t_idx") + F.col("horizon") - 1 < cut), rows.filter(F.col("t_idx") >= cut)


def _scored(model, test, name="prediction"):
    return model.transform(test).select("region", "t_idx", "label", F.col(name).alias("y_pred"))


def _probability(model, test):
    return model.transform(test).select("region", "t_idx", "active", vector_to_array("probability")[1].alias("y_prob"))


def _balanced(train, label="active"):
    """Rows with weight N / (2 N of the class)."""
    n = train.groupBy(label).count().collect()  # a row for each class
    total = sum(r["count"] for r in n)
    weight = F.lit(1.0)
    for r in n:
        weight = F.when(F.col(label) == r[label], total / (2.0 * r["count"])).otherwise(weight)
    return train.withColumn("weight", weight)


# --- preparation ---------------------------------------------------------------------------------


@plan()
def prep_impute_median(spark, sf_dir):
    """Missing early lags take the median of the known."""
    p = orders_panel(spark, sf_dir)
    w = Window.partitionBy("region").orderBy("t_idx")
    lagged = p.select("region", "t_idx", F.lag("y", 14).over(w).cast("double").alias("lag_14"))
    return Imputer(strategy="median", inputCols=["lag_14"], outputCols=["lag_14_filled"]).fit(lagged).transform(lagged)


@plan(PANEL + " SELECT region, event_date, round((y - avg(y) OVER (PARTITION BY region)) / nullif(stddev_pop(y) OVER (PARTITION BY region), 0), 4) + 0.0 AS z FROM panel")
def prep_standardize(spark, sf_dir):
    p = orders_panel(spark, sf_dir)
    stats = p.groupBy("region").agg(F.avg("y").alias("mu"), F.stddev_pop("y").alias("sd"))
    return p.join(F.broadcast(stats), "region").select("region", "event_date", R((F.col("y") - F.col("mu")) / F.nullif("sd", F.lit(0.0)), 4).alias("z"))


@plan(PANEL + ", s AS (SELECT region, min(y) AS lo, max(y) AS hi FROM panel GROUP BY region) SELECT region, event_date, round((y - lo) / nullif(hi - lo, 0), 6) AS scaled FROM panel JOIN s USING (region)")
def prep_minmax_by_key(spark, sf_dir):
    p = orders_panel(spark, sf_dir)
    s = p.groupBy("region").agg(F.min("y").alias("lo"), F.max("y").alias("hi"))
    return p.join(F.broadcast(s), "region").select("region", "event_date", R((F.col("y") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))).alias("scaled"))


@plan(PANEL + " SELECT region, (dense_rank() OVER (ORDER BY region) - 1)::INT AS region_code, round((tier - min(tier) OVER ()) / nullif(max(tier) OVER () - min(tier) OVER (), 0), 6)::DOUBLE AS tier_scaled FROM tiers")
def prep_static_encode(spark, sf_dir):
    """Ordinal region and scaled tier; one row for each region."""
    t = tiers(orders_panel(spark, sf_dir))
    span = t.agg(F.min("tier").alias("lo"), F.max("tier").alias("hi"))
    code = F.dense_rank().over(Window.orderBy("region")) - 1
    return t.crossJoin(F.broadcast(span)).select("region", code.alias("region_code"), R((F.col("tier") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0))).alias("tier_scaled"))


_TAB = ", tab AS (SELECT region, t_idx, event_date, y::DOUBLE AS label, lag(y, 1) OVER w::DOUBLE AS lag_1, lag(y, 7) OVER w::DOUBLE AS lag_7, avg(y) OVER (PARTITION BY region ORDER BY t_idx ROWS BETWEEN 28 PRECEDING AND 1 PRECEDING) AS mean_28, (isodow(event_date) >= 6)::INT::DOUBLE AS is_weekend FROM panel WINDOW w AS (PARTITION BY region ORDER BY t_idx))".replace("lag(y, 1) OVER w::DOUBLE", "(lag(y, 1) OVER w)::DOUBLE").replace("lag(y, 7) OVER w::DOUBLE", "(lag(y, 7) OVER w)::DOUBLE")


@plan(PANEL + _TAB + " SELECT region, t_idx, label, lag_1, lag_7, round(mean_28, 6) AS mean_28, is_weekend, t_idx >= (SELECT CAST(floor(0.8 * (max(t_idx) + 1)) AS INT) FROM panel) AS is_test FROM tab WHERE t_idx >= 28")
def prep_tabularize(spark, sf_dir):
    p = orders_panel(spark, sf_dir)
    cut = int(0.8 * bt.length(p))
    return ln.tabular(p).select("region", "t_idx", "label", "lag_1", "lag_7", R(F.col("mean_28")).alias("mean_28"), "is_weekend", (F.col("t_idx") >= cut).alias("is_test"))


# --- learners ------------------------------------------------------------------------------------


@plan()
def fit_logistic(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _probability(LogisticRegression(labelCol="active", weightCol="weight", maxIter=30).fit(_balanced(train)), test)


#: Where training ends, as in the other backtests.
_END = "(SELECT CAST(floor(0.8 * (max(t_idx) + 1)) AS INT) FROM panel)"


def _only_class(panel, end):
    flag = (F.col("notspec") > 0).cast("int")
    return panel.filter(F.col("t_idx") < end).groupBy("region").agg(F.min(flag).alias("only_class"), (F.countDistinct(flag) < 2).alias("constant"))


@plan(PANEL + " SELECT region, min((notspec > 0)::INT)::INT AS only_class, count(DISTINCT notspec > 0) < 2 AS constant FROM panel WHERE t_idx < " + _END + " GROUP BY region")
def fit_single_class_fallback(spark, sf_dir):
    """Keys whose training rows show one class get that class as a constant prediction."""
    panel = orders_panel(spark, sf_dir)
    return _only_class(panel, int(0.8 * bt.length(panel)))


@plan()
def fit_linear(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _scored(LinearRegression(regParam=1e-4).fit(train), test)


@plan()
def fit_poisson(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _scored(GeneralizedLinearRegression(family="poisson", link="log", maxIter=15, regParam=1e-4).fit(train), test)


@plan()
def fit_tweedie(spark, sf_dir):
    """The count head: weights are 1 on positive days and 0 elsewhere."""
    train, test = _split(spark, sf_dir)
    weighted = train.withColumn("weight", F.when(F.col("label") > 0, 1.0).otherwise(0.0))
    return _scored(GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, weightCol="weight", maxIter=15, regParam=1e-4).fit(weighted), test)


@plan()
def fit_gbt_log(spark, sf_dir):
    """Boosted trees on log(1 + y), turned back."""
    train, test = _split(spark, sf_dir)
    model = GBTRegressor(labelCol="log_label", maxIter=8, maxDepth=4, seed=1).fit(train.withColumn("log_label", F.log1p("label")))
    return model.transform(test).select("region", "t_idx", "label", F.expm1("prediction").alias("y_pred"))


@plan()
def fit_gbt_classifier(spark, sf_dir):
    train, test = _split(spark, sf_dir)
    return _probability(GBTClassifier(labelCol="active", weightCol="weight", maxIter=8, maxDepth=4, seed=1).fit(_balanced(train)), test)


@plan()
def fit_self_paced_ensemble(spark, sf_dir, members: int = 20, bins: int = 10):
    """Trees on all positives and on negatives sampled from bins of hardness, evener with each member; averaged."""
    train, test = _split(spark, sf_dir)
    return ensemble.self_paced(train, test, ["region", "t_idx"], members=members, bins=bins).select("region", "t_idx", "active", "y_prob")


@plan(PREDS + " SELECT least(CAST(floor(y_prob * 10) AS INT), 9) AS bin, count(*)::BIGINT AS n, round(avg(y_prob), 6) AS hardness, round(1 / (avg(y_prob) + 0.1), 4) AS pace FROM preds WHERE y_true = 0 GROUP BY 1")
def sample_hardness_bins(spark, sf_dir):
    """Bins of the majority by hardness, and the share each gets."""
    p = _preds(spark, sf_dir).filter("y_true = 0").withColumn("bin", F.least(F.floor(F.col("y_prob") * 10).cast("int"), F.lit(9)))
    return p.groupBy("bin").agg(F.count("*").alias("n"), R(F.avg("y_prob")).alias("hardness"), F.round(1 / (F.avg("y_prob") + 0.1), 4).alias("pace"))


_W = "OVER (PARTITION BY region ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


_AR1 = f", l AS (SELECT region, t_idx, y, lag(y) OVER (PARTITION BY region ORDER BY t_idx) AS x FROM panel), f AS (SELECT region, t_idx, y, x, regr_slope(y, x) {_W} AS b, regr_intercept(y, x) {_W} AS a FROM l) SELECT region, t_idx, y, round(a + b * x + 1e-9, 4) + 0.0 AS y_pred FROM f"


def _ar1(panel):
    # Early fits are small fractions that often end on a half at the last digit; the nudge takes those up in every engine.
    w = Window.partitionBy("region").orderBy("t_idx")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    held = panel.select("region", "t_idx", "y", F.lag("y").over(w).alias("x"))
    fits = held.select("region", "t_idx", "y", "x", F.regr_slope("y", "x").over(past).alias("b"), F.regr_intercept("y", "x").over(past).alias("a"))
    return fits.select("region", "t_idx", "y", R(F.col("a") + F.col("b") * F.col("x") + 1e-9, 4).alias("y_pred"))


@plan(PANEL + _AR1)
def fit_ar1_expanding(spark, sf_dir):
    """Each step's forecast from a regression of the value on the one before over everything earlier; null until that can be fitted."""
    return _ar1(orders_panel(spark, sf_dir))


@plan()
def fit_ar7_expanding(spark, sf_dir):
    """Each step's forecast from its last seven values, refitted at each step on everything earlier."""
    return ln.autoregression(orders_panel(spark, sf_dir))


def _linear(spark, sf_dir, keys, share=0.8):
    panel = orders_panel(spark, sf_dir)
    start = int(share * bt.length(panel))
    if "tier" in keys:
        panel = panel.join(F.broadcast(tiers(panel).select("region", F.coalesce("tier", F.lit(-1)).alias("tier"))), "region")
    return ln.linear_backtest(panel, keys, start)


@plan()
def bt_linear_global(spark, sf_dir):
    return _linear(spark, sf_dir, ["all"])


@plan()
def bt_linear_by_tier(spark, sf_dir):
    return _linear(spark, sf_dir, ["tier"])


@plan()
def bt_linear_by_region(spark, sf_dir):
    return _linear(spark, sf_dir, ["region"])


@plan()
def bt_test_segment(spark, sf_dir, stride: int = 1, retrain: int = 7):
    """The held-out end from 80 % on: forecasts at every ``stride``-th step, models refitted every ``retrain`` steps and frozen between."""
    panel = orders_panel(spark, sf_dir)
    start = int(0.8 * bt.length(panel))
    return ex.expanding_backtest(ex.direct_rows(panel), ex.glm("gaussian", ex.PAST, ridge=1e-6), start, retrain=retrain, stride=stride)


@plan()
def fit_arima_expanding(spark, sf_dir):
    """Seven steps ahead from seven lags; each region's order of differencing and coefficients chosen anew at every refit."""
    panel = orders_panel(spark, sf_dir)
    return series.autoregressive_backtest(panel, int(0.8 * bt.length(panel)))


def _quantiles(preds):
    v = F.col("y_pred") + F.col("i") % 5
    return preds.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(8)))).groupBy("region", "fold", "horizon").agg(F.median(v).alias("y_med"), F.percentile(v, 0.9).alias("y_q90"))


@plan(PREDS + ", s AS (SELECT region, fold, horizon, y_pred + (i % 5) AS v FROM preds, (SELECT unnest(range(0, 9)) AS i)) SELECT region, fold, horizon, median(v) AS y_med, quantile_cont(v, 0.9) AS y_q90 FROM s GROUP BY region, fold, horizon")
def fcst_sample_quantiles(spark, sf_dir):
    """Sampled forecasts reduced to their median and a quantile."""
    return _quantiles(_preds(spark, sf_dir))


# --- calibration ---------------------------------------------------------------------------------


def _cv_test(spark, sf_dir, share=0.42):
    """Calibrators learn from the first share of the folds; the seven folds after it, whose targets overlap, are left out of both."""
    p = _preds(spark, sf_dir)
    cut = int(share * (p.agg(F.max("fold")).first()[0] + 1))
    return p.filter(F.col("fold") < cut), p.filter(F.col("fold") >= cut + 7)


@plan()
def cal_sigmoid_fit(spark, sf_dir):
    return ln.platt(_cv_test(spark, sf_dir)[0])


@plan()
def cal_isotonic_fit(spark, sf_dir):
    """A rising step function for each horizon, all pooled at once, linear between steps and clipped outside."""
    cv, test = _cv_test(spark, sf_dir)
    return cal.stepped(test, cal.isotonic(cv, ["horizon"]), ["horizon"]).select("region", "fold", "horizon", "y_cal")


_FIXED = {1: (0.1, 1.0), 2: (0.2, 0.9), 3: (0.0, 1.1)}


@plan(PREDS + ", k(horizon, a, b) AS (VALUES " + ", ".join(f"({h}, {a}::DOUBLE, {b}::DOUBLE)" for h, (a, b) in _FIXED.items()) + ") SELECT region, fold, horizon, round(coalesce(1 / (1 + exp(-(a + b * ln(y_prob / (1 - y_prob))))), y_prob), 6) AS y_cal FROM preds LEFT JOIN k USING (horizon)".replace("ln(y_prob / (1 - y_prob))", "ln(least(greatest(y_prob, 1e-6), 1 - 1e-6) / (1 - least(greatest(y_prob, 1e-6), 1 - 1e-6)))"))
def cal_apply(spark, sf_dir):
    """Given calibrators of three horizons; the others pass raw."""
    fits = spark.createDataFrame([(h, a, b) for h, (a, b) in _FIXED.items()], "horizon int, a double, b double")
    return ln.calibrated(_preds(spark, sf_dir), fits).select("region", "fold", "horizon", R(F.col("y_cal")).alias("y_cal"))


@plan()
def cal_out_of_fold(spark, sf_dir):
    """Each row calibrated by a fit on the other folds of its horizon; five folds, each class dealt in turn."""
    cv = _cv_test(spark, sf_dir)[0]
    return cal.out_of_fold(cv, ["horizon"]).select("region", "fold", "horizon", "part", "y_true", "y_cal")


@plan()
def cal_venn_abers(spark, sf_dir):
    cv, test = _cv_test(spark, sf_dir)
    return ln.venn_abers(cv, test)


_TABLE = "count(*) FILTER (WHERE y_true > 0)::BIGINT AS n_pos, round(avg((y_prob - (y_true > 0)::INT) * (y_prob - (y_true > 0)::INT)), 4) AS brier, round(avg(-((y_true > 0)::INT * ln(p) + (1 - (y_true > 0)::INT) * ln(1 - p))), 4) AS log_loss"


@plan(PREDS + f" SELECT 'raw' AS method, horizon, {_TABLE} FROM (SELECT *, least(greatest(y_prob, 1e-6), 1 - 1e-6) AS p FROM preds) GROUP BY horizon")
def eval_calibration_table(spark, sf_dir):
    from panelloom.plans.evaluation import brier, log_loss

    found = _preds(spark, sf_dir).groupBy("horizon").agg(F.count(F.when(F.col("y_true") > 0, 1)).alias("n_pos"), F.round(brier(), 4).alias("brier"), F.round(log_loss(), 4).alias("log_loss"))
    return found.withColumn("method", F.lit("raw"))


# --- hurdle models -------------------------------------------------------------------------------


@plan(PREDS + " SELECT region, fold, horizon, round(y_prob * y_pred, 6) AS y_soft FROM preds")
def hurdle_soft_gate(spark, sf_dir):
    return _preds(spark, sf_dir).select("region", "fold", "horizon", R(F.col("y_prob") * F.col("y_pred")).alias("y_soft"))


@plan(PREDS + " SELECT region, fold, horizon, CASE WHEN y_prob >= 0.5 THEN y_pred ELSE 0 END AS y_hard FROM preds")
def hurdle_hard_gate(spark, sf_dir):
    return _preds(spark, sf_dir).select("region", "fold", "horizon", F.when(F.col("y_prob") >= 0.5, F.col("y_pred")).otherwise(F.lit(0)).alias("y_hard"))


def _expanding(spark, sf_dir, builder, keys=(), share=0.8, retrain=112):
    """A backtest of ``builder`` from a share of the steps on; ``keys`` is the regime: all rows, tiers, or regions."""
    panel = written(orders_panel(spark, sf_dir))  # its length, its tiers and its rows, of orders read once
    start = int(share * bt.length(panel))
    if "tier" in keys:
        panel = panel.join(F.broadcast(tiers(panel).select("region", F.coalesce("tier", F.lit(-1)).alias("tier"))), "region")
    return ex.expanding_backtest(ex.direct_rows(panel, carry=tuple(k for k in keys if k != "region")), builder, start, keys, retrain)


@plan(PREDS + " SELECT region, (fold + start)::INT AS t0, horizon, y_true, y_pred::DOUBLE AS y_pred FROM preds, size")
def bt_model_weekly(spark, sf_dir):
    """The weekly-naive model through the same backtest as every other; whole weeks of horizons only."""
    found = _expanding(spark, sf_dir, ex.weekly_naive)
    most = found.agg(F.max("t0")).first()[0]
    return found.filter(F.col("t0") <= F.lit(most - len(ex.HORIZONS) + 1))


@plan()
def bt_known_future(spark, sf_dir):
    """Linear models with calendar covariates of the target step, refitted as the window grows."""
    return _expanding(spark, sf_dir, ex.glm("gaussian"))


@plan()
def hurdle_backtest(spark, sf_dir):
    """Probability of activity times the count expected on active days, one pair of models for all regions."""
    return _expanding(spark, sf_dir, ex.hurdle())


@plan()
def hurdle_backtest_by_tier(spark, sf_dir):
    """A pair of models for each activity tier."""
    return _expanding(spark, sf_dir, ex.hurdle(), ("tier",))


@plan()
def hurdle_backtest_by_region(spark, sf_dir):
    """A pair of models for each region."""
    return _expanding(spark, sf_dir, ex.hurdle(), ("region",))


#: Steps between refits of the models that are compared, and the shares of the steps where forecasts begin and where they count.
_RETRAIN, _BEGIN, _COUNTS = 112, 0.7, 0.8


def _regimes(spark, sf_dir):
    """Rows of the three regimes under one key: all regions together, by tier, and by themselves; the two steps; and the panel, written."""
    whole = written(orders_panel(spark, sf_dir))
    n = bt.length(whole)
    panel = whole.join(F.broadcast(tiers(whole).select("region", F.coalesce("tier", F.lit(-1)).cast("string").alias("tier"))), "region")
    unit = lambda name, of: F.struct(F.lit(name).alias("regime"), of.alias("unit"))
    rows = ex.direct_rows(panel, carry=("tier",)).withColumn("r", F.explode(F.array(unit("global", F.lit("all")), unit("activity", F.col("tier")), unit("local", F.col("region")))))
    return rows.select("r.regime", "r.unit", *[c for c in rows.columns if c not in ("r", "tier")]), int(_BEGIN * n), int(_COUNTS * n), whole


def _calibrated(spark, sf_dir):
    """(regime, unit, region, t0, horizon, y_true, y_prob, y_count, y_pred, y_sigmoid, y_venn): hurdle forecasts of three regimes, calibrated by earlier ones of their regime and horizon."""
    rows, begin, counts, _ = _regimes(spark, sf_dir)
    keys = ("regime", "unit")
    found = ex.expanding_backtest(rows, ex.hurdle(), begin, keys, _RETRAIN)
    return cal.in_folds(found, begin, keys[:1], _RETRAIN).filter(F.col("t0") >= counts)


@plan()
def hurdle_calibrated(spark, sf_dir):
    """Raw, sigmoid and Venn-Abers probabilities of three regimes, by horizon and over all: how good they are, and the counts they make."""
    ways = F.array(*[F.struct(F.lit(n).alias("method"), F.col(c).alias("y_prob")) for n, c in (("raw", "y_prob"), ("sigmoid", "y_sigmoid"), ("venn_abers", "y_venn"))])
    long = _calibrated(spark, sf_dir).withColumn("w", F.explode(ways)).select("regime", "w.method", "horizon", "y_true", "w.y_prob", (F.col("w.y_prob") * F.col("y_count")).alias("y_pred"))
    hit, p = (F.col("y_true") > 0).cast("int"), F.least(F.greatest(F.col("y_prob"), F.lit(1e-6)), F.lit(1 - 1e-6))
    loss = -(hit * F.ln(p) + (1 - hit) * F.ln(1 - p))
    each = [F.count("*").alias("n"), F.avg((F.col("y_prob") - hit) ** 2).alias("brier"), F.avg(loss).alias("log_loss"), metrics.metric("MAE").alias("MAE"), metrics.metric("RMSE").alias("RMSE")]
    return long.groupingSets([["regime", "method"], ["regime", "method", "horizon"]], "regime", "method", "horizon").agg(*each)


@plan()
def fcst_hurdle_quantiles(spark, sf_dir):
    """Median and quantiles of 200 draws of the hurdle's forecasts; the point forecast is the median, or the mean where there is none."""
    found = quantiles.sampled(hurdle_backtest(spark, sf_dir), ["region", "t0", "horizon"])
    return quantiles.picked(found).select("region", "t0", "horizon", "y_true", "y_q10", F.col("y_q50").alias("y_med"), "y_q90", "y_point")


@plan()
def hurdle_two_stage_backtest(spark, sf_dir):
    """P(any) times P(urgent given any), the second learned on active days only; both refitted as the window grows."""
    panel = orders_panel(spark, sf_dir)
    rows = ex.direct_rows(panel, labels=("urgent",))
    rows = rows.withColumns({"damage": (F.col("urgent") > 0).cast("double")}).drop("urgent")
    return ex.expanding_backtest(rows, ex.two_stage("active", "damage"), int(0.8 * bt.length(panel)), (), _RETRAIN).withColumnRenamed("y_pred", "y_prob")


def _positive_mean(panel, end):
    positive = F.when(F.col("urgent") > 0, F.col("urgent"))
    return panel.filter(F.col("t_idx") < end).groupBy("region").agg(F.count(positive).alias("n_positive"), F.when(F.count(positive) < 50, F.round(F.coalesce(F.avg(positive), F.lit(1.0)), 6)).alias("constant"))


@plan(PANEL + " SELECT region, count(*) FILTER (WHERE urgent > 0)::BIGINT AS n_positive, CASE WHEN count(*) FILTER (WHERE urgent > 0) < 50 THEN round(coalesce(avg(urgent) FILTER (WHERE urgent > 0), 1.0), 6) END AS constant FROM panel WHERE t_idx < " + _END + " GROUP BY region")
def fit_positive_mean_fallback(spark, sf_dir):
    """Under 50 positive days the mean of those stands for the count model, 1 if there are none."""
    panel = orders_panel(spark, sf_dir)
    return _positive_mean(panel, int(0.8 * bt.length(panel)))


@plan()
def multi_target_backtest(spark, sf_dir):
    """One linear model for each order priority, all targets in the same grouped sums."""
    from panelloom.sources.panels import PRIORITIES

    p = orders_panel(spark, sf_dir)
    start = int(0.8 * bt.length(p))
    long = p.unpivot(["region", "t_idx", "event_date"], list(PRIORITIES), "target", "y")
    keyed = long.select(F.concat_ws("|", "region", "target").alias("region"), "t_idx", "event_date", "y", "target")
    return ln.linear_backtest(keyed, ["target"], start).select(F.split("region", r"\|")[0].alias("region"), F.split("region", r"\|")[1].alias("target"), "t0", "horizon", "y_true", "y_pred")


@plan(PANEL + ", s AS (SELECT region, avg((urgent > 0)::INT) FILTER (WHERE y > 0) AS given FROM panel GROUP BY region), a AS (SELECT region, avg((y > 0)::INT) AS event FROM panel GROUP BY region) SELECT region, round(event * given, 6) AS p FROM s JOIN a USING (region)")
def hurdle_two_stage_prob(spark, sf_dir):
    """P(any) times P(urgent given any), the second learned on active days only."""
    p = orders_panel(spark, sf_dir)
    event = p.groupBy("region").agg(F.avg((F.col("y") > 0).cast("int")).alias("event"))
    given = p.filter("y > 0").groupBy("region").agg(F.avg((F.col("urgent") > 0).cast("int")).alias("given"))
    return event.join(given, "region").select("region", R(F.col("event") * F.col("given")).alias("p"))


# --- leaderboards and importances ----------------------------------------------------------------

_LB = "(SELECT 'weekly' AS model, region, horizon, y_pred AS v, y_true FROM preds UNION ALL SELECT 'last', region, horizon, y_last, y_true FROM preds UNION ALL SELECT 'zero', region, horizon, 0, y_true FROM preds)"


def _models(spark, sf_dir):
    p = _preds(spark, sf_dir)
    pick = lambda n, c: p.select(F.lit(n).alias("model"), "region", "horizon", c.alias("v"), "y_true")
    return pick("weekly", F.col("y_pred")).unionByName(pick("last", F.col("y_last"))).unionByName(pick("zero", F.lit(0).cast("long")))


def _score():
    e = F.col("v") - F.col("y_true")
    return [R(F.avg(F.abs(e))).alias("MAE"), R(F.sqrt(F.avg(e * e))).alias("RMSE")]


_SCORE = "round(avg(abs(v - y_true)), 6) AS MAE, round(sqrt(avg((v - y_true) * (v - y_true))), 6) AS RMSE"


@plan(PREDS + f", s AS (SELECT model, {_SCORE} FROM {_LB} GROUP BY model) SELECT *, rank() OVER (ORDER BY RMSE)::INT AS place FROM s")
def leaderboard(spark, sf_dir):
    return _models(spark, sf_dir).groupBy("model").agg(*_score()).withColumn("place", F.rank().over(Window.orderBy("RMSE")))


@plan(PREDS + f" SELECT model, horizon, NULL::VARCHAR AS region, {_SCORE} FROM {_LB} GROUP BY model, horizon UNION ALL SELECT model, NULL, region, {_SCORE} FROM {_LB} GROUP BY model, region")
def leaderboard_regimes(spark, sf_dir):
    """Side by side by horizon and by region."""
    x = _models(spark, sf_dir)
    return x.groupBy("model", "horizon").agg(*_score()).unionByName(x.groupBy("model", "region").agg(*_score()), allowMissingColumns=True)


@plan(PREDS + " SELECT 'classifier' AS component, round(avg((y_prob - (y_true > 0)::INT) * (y_prob - (y_true > 0)::INT)), 6) AS brier, NULL::DOUBLE AS MAE FROM preds UNION ALL SELECT 'count', NULL, round(avg(abs(y_pred - y_true)) FILTER (WHERE y_true > 0), 6) FROM preds UNION ALL SELECT 'hurdle', NULL, round(avg(abs(y_prob * y_pred - y_true)), 6) FROM preds")
def component_summary(spark, sf_dir):
    p = _preds(spark, sf_dir)
    d = F.col("y_prob") - (F.col("y_true") > 0).cast("int")
    mae = lambda v: R(F.avg(F.abs(v - F.col("y_true")))).alias("MAE")
    a = p.agg(R(F.avg(d * d)).alias("brier")).withColumn("component", F.lit("classifier"))
    b = p.filter("y_true > 0").agg(mae(F.col("y_pred"))).withColumn("component", F.lit("count"))
    c = p.agg(mae(F.col("y_prob") * F.col("y_pred"))).withColumn("component", F.lit("hurdle"))
    return a.unionByName(b, allowMissingColumns=True).unionByName(c, allowMissingColumns=True)


@plan(PREDS + f", s AS (SELECT model, {_SCORE} FROM {_LB} GROUP BY model), r AS (SELECT *, row_number() OVER (ORDER BY RMSE, model) AS k FROM s) SELECT model, MAE, RMSE FROM r WHERE k = 1")
def topk_winner(spark, sf_dir):
    return _models(spark, sf_dir).groupBy("model").agg(*_score()).orderBy("RMSE", "model").limit(1)


def _trained(spark, sf_dir):
    """(model, regime, region, t0, horizon, y_true, y_pred, y_prob, y_count), written: forecasts of every trained model and regime, and of the naive ones;
    the step where they count, and the panel."""
    rows, begin, counts, panel = _regimes(spark, sf_dir)
    rows, keys = written(rows), ("regime", "unit")
    none = F.lit(None).cast("double")
    shape = lambda df, model, pred, prob=none, count=none: df.select(F.lit(model).alias("model"), "regime", "region", "t0", "horizon", "y_true", pred.cast("double").alias("y_pred"), prob.alias("y_prob"), count.alias("y_count"))
    whole = ex.expanding_backtest(rows, ex.hurdle(), begin, keys, _RETRAIN)
    made = written(cal.in_folds(whole, begin, keys[:1], _RETRAIN).filter(F.col("t0") >= counts))
    out = shape(made, "hurdle_raw", F.col("y_pred"), F.col("y_prob"), F.col("y_count"))
    for name in ("sigmoid", "venn"):
        out = out.unionByName(shape(made, f"hurdle_{name}", F.col(f"y_{name}") * F.col("y_count"), F.col(f"y_{name}"), F.col("y_count")))
    for family in ("gaussian", "poisson"):
        out = out.unionByName(shape(ex.expanding_backtest(rows, ex.glm(family), counts, keys, _RETRAIN), {"gaussian": "linear"}.get(family, family), F.col("y_pred")))
    once = rows.filter((F.col("t0") >= counts) & (F.col("regime") == "global")).withColumn("regime", F.lit("none"))
    naive = [("weekly", F.col("y_week")), ("last", F.col("lag_1")), ("zero", F.lit(0.0))]
    for name, value in naive:
        out = out.unionByName(shape(once, name, value))
    return written(out), counts, panel


def _trained_scores(long, *keys):
    hit = (F.col("y_true") > 0).cast("int")
    e = F.greatest(F.col("y_pred"), F.lit(0.0)) - F.col("y_true")
    positive = lambda x: F.when(F.col("y_true") > 0, x)
    return long.groupBy(*keys).agg(
        F.count("*").alias("n"), F.avg(F.abs(e)).alias("MAE"), F.sqrt(F.avg(e * e)).alias("RMSE"), F.sqrt(F.avg(positive(e * e))).alias("RMSE_pos"), F.avg(e).alias("ME"),
        F.avg((F.col("y_prob") - hit) ** 2).alias("brier"),
    )


@plan()
def leaderboard_trained(spark, sf_dir):
    """Every trained model in every regime, and the naive ones, over all and side by side by horizon and by region: errors; over all also scaled errors
    averaged over regions, rank metrics of the probabilities, and the place by scaled error."""
    long, counts, panel = _trained(spark, sf_dir)
    keys = ["model", "regime"]
    scales = metrics.naive_scales(panel, counts)
    by_region = _trained_scores(long, *keys, "region")
    scaled = by_region.join(F.broadcast(scales), "region").groupBy(*keys)
    macro = scaled.agg(F.avg(F.col("MAE") / F.nullif("mae_scale", F.lit(0.0))).alias("MASE_mean"), F.avg(F.col("RMSE") / F.nullif("rmse_scale", F.lit(0.0))).alias("RMSSE_mean"))
    probable = long.filter("y_prob IS NOT NULL")
    ranked = metrics.pr_auc(probable, keys).join(metrics.roc_auc(probable, keys), keys)
    whole = _trained_scores(long, *keys).join(macro, keys).join(ranked, keys, "left").withColumn("place", F.rank().over(Window.orderBy("RMSSE_mean")))  # a row for each model and regime
    return whole.unionByName(_trained_scores(long, *keys, "horizon"), allowMissingColumns=True).unionByName(by_region, allowMissingColumns=True)


@plan()
def component_summary_trained(spark, sf_dir):
    """The hurdle's parts in each regime: probabilities raw and calibrated, counts on active days, and what they make together."""
    long = _trained(spark, sf_dir)[0].filter("y_prob IS NOT NULL")
    of = lambda name: F.regexp_replace("model", "hurdle", name)
    columns = ["component", "regime"]
    whole = _trained_scores(long.withColumn("component", of("hurdle")), *columns).drop("brier")
    prob = long.withColumn("component", of("classifier"))
    hit = (F.col("y_true") > 0).cast("int")
    classified = prob.groupBy(*columns).agg(F.count("*").alias("n"), F.avg((F.col("y_prob") - hit) ** 2).alias("brier")).join(metrics.pr_auc(prob, columns), columns).join(metrics.roc_auc(prob, columns), columns)
    heads = long.filter("model = 'hurdle_raw' AND y_true > 0").withColumns({"component": F.lit("count"), "y_pred": F.col("y_count")})
    return whole.unionByName(classified, allowMissingColumns=True).unionByName(_trained_scores(heads, *columns).drop("brier"), allowMissingColumns=True)


# --- rankings ------------------------------------------------------------------------------------

_METRICS = ("y", "revenue_cents", "urgent", "high", "medium", "notspec", "low")


def _feature_block(panel, metrics_=_METRICS, lags: int = 28, windows=(3, 7, 14, 28)):
    """(region, t_idx, y, features): lags and rolling figures of every metric, and the calendar, by one window; the names of the features in order."""
    w = Window.partitionBy("region").orderBy("t_idx")
    past = lambda k: w.rowsBetween(-k, -1)
    named = {f"{m}_lag_{k}": F.lag(m, k).over(w).cast("double") for m in metrics_ for k in range(1, lags + 1)}
    rolled = {"mean": F.avg, "max": F.max, "sd": F.stddev_pop}
    named |= {f"{m}_{n}_{k}": f(m).over(past(k)).cast("double") for m in metrics_ for n, f in rolled.items() for k in windows}
    day = F.dayofyear("event_date") * (2 * math.pi / 365.25)
    named |= {"weekday": F.weekday("event_date").cast("double"), "month": F.month("event_date").cast("double"), "year_sin": F.sin(day), "year_cos": F.cos(day), "is_weekend": (F.weekday("event_date") >= 5).cast("double")}
    held = panel.select("region", "t_idx", F.col("y").cast("double").alias("label"), F.array(*named.values()).alias("features")).filter(F.col("t_idx") >= lags)
    return held, list(named)


def _importances(spark, sf_dir, horizons=ln.HORIZONS, panel=None, trees: int = 12, depth: int = 5):
    """(horizon, feature, gain) over the whole block of features: forests for each horizon, whose trees are grown level by level together."""
    panel = orders_panel(spark, sf_dir) if panel is None else panel
    block, names = _feature_block(panel)
    w = Window.partitionBy("region").orderBy("t_idx")
    ahead = {f"y_{h}": F.lead("label", h - 1).over(w) for h in horizons}
    rows = written(block.withColumns(ahead).withColumn("features", array_to_vector("features")))
    found = []
    for h in horizons:
        model = RandomForestRegressor(labelCol=f"y_{h}", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", maxBins=16, seed=1).fit(rows.filter(F.col(f"y_{h}").isNotNull()))
        found += [(h, c, float(g)) for c, g in zip(names, model.featureImportances.toArray(), strict=True)]
    return panel.sparkSession.createDataFrame(found, "horizon int, feature string, gain double")


@plan()
def fit_feature_ranking(spark, sf_dir):
    return _importances(spark, sf_dir).groupBy("feature").agg(F.avg("gain").alias("mean_gain"))


@plan()
def topk_features(spark, sf_dir, k: int = 100):
    """The features with the highest mean gain over all horizons."""
    return fit_feature_ranking(spark, sf_dir).orderBy(F.desc("mean_gain"), "feature").limit(k)


@plan()
def topk_importance(spark, sf_dir, k: int = 30):
    return _importances(spark, sf_dir).groupBy("feature").agg(F.avg("gain").alias("mean_gain"), F.stddev("gain").alias("sd_gain")).orderBy(F.desc("mean_gain"), "feature").limit(k)


@plan()
def importance_by_horizon(spark, sf_dir):
    return _importances(spark, sf_dir).groupBy("feature").pivot("horizon", list(ln.HORIZONS)).agg(F.first("gain"))


@plan()
def importance_permutation(spark, sf_dir, shuffles: int = 10):
    """Loss of accuracy by horizon when a feature's values are dealt anew: joined by two hash orders within each region."""
    train, test = _ahead(spark, sf_dir)
    fits = []
    for h in ln.HORIZONS:
        model = LinearRegression(regParam=1e-4).fit(train.filter(F.col("horizon") == h))
        fits.append((h, float(model.intercept), *model.coefficients.toArray().tolist()))
    betas = spark.createDataFrame(fits, ", ".join(["horizon int", "b double", *(f"b_{c} double" for c in COLUMNS)]))
    dealt = test.withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shuffles - 1))))
    a, b = (Window.partitionBy("region", "horizon", "s").orderBy(F.xxhash64("t_idx", 2 * F.col("s") + k), "t_idx") for k in (0, 1))
    left = dealt.select("region", "horizon", "s", "label", *COLUMNS, F.row_number().over(a).alias("i"))
    right = dealt.select("region", "horizon", "s", *[F.col(c).alias(f"{c}_new") for c in COLUMNS], F.row_number().over(b).alias("i"))
    error = lambda p: F.avg(F.abs(p - F.col("label")))
    straight = sum((F.col(c) * F.col(f"b_{c}") for c in COLUMNS), F.col("b"))
    drops = left.join(right, ["region", "horizon", "s", "i"]).join(F.broadcast(betas), "horizon").groupBy("horizon", "s")
    drops = drops.agg(*[(error(straight + (F.col(f"{c}_new") - F.col(c)) * F.col(f"b_{c}")) - error(straight)).alias(c) for c in COLUMNS])
    return drops.unpivot(["horizon", "s"], COLUMNS, "feature", "drop").groupBy("feature", "horizon").agg(F.avg("drop").alias("mean_drop"), F.stddev("drop").alias("sd_drop"))


#: Sets of features that the search compares.
_VARIANTS = {"lags": ("lag_1", "lag_7"), "level": ("mean_28",), "past": ex.PAST, "calendar": (*ex.PAST, *ex.AHEAD)}


@plan()
def tune_random_search(spark, sf_dir, trials: int = 50):
    """Trials of feature set, ridge strength and refit stride, scored by the scaled error averaged over regions; each set's winner is marked. The export of all trials."""
    import random

    panel, pick = orders_panel(spark, sf_dir), random.Random(1)
    names = list(_VARIANTS)
    drawn = [(k, names[k % len(names)], 10 ** pick.uniform(-6, 2), pick.choice([14, 28, 56])) for k in range(trials)]
    found = searched(panel, int(0.8 * bt.length(panel)), _VARIANTS, drawn)
    return found.select("number", "variant", "value", F.to_json(F.struct("ridge", "retrain")).alias("params"), F.lit("complete").alias("state"), "best")


_DF = ", l AS (SELECT region, t_idx, y, lag(y) OVER (PARTITION BY region ORDER BY t_idx) AS x FROM panel), d AS (SELECT region, y - x AS dy, x FROM l WHERE x IS NOT NULL), c AS (SELECT region, count(*) AS n, covar_samp(dy, x) AS sxy, var_samp(x) AS sxx, var_samp(dy) AS syy FROM d GROUP BY region)"


@plan(PANEL + _DF + " SELECT region, round(t, 3) AS df_t, t < -2.86 AS stationary FROM (SELECT region, (sxy / nullif(sxx, 0)) / nullif(sqrt(greatest((syy - sxy * sxy / nullif(sxx, 0)) * (n - 1) / nullif(n - 2, 0) / nullif(sxx * (n - 1), 0), 0)), 0) AS t FROM c)")
def profile_stationarity(spark, sf_dir):
    """Dickey-Fuller statistic from sums of products for each region, against a fixed cut."""
    w = Window.partitionBy("region").orderBy("t_idx")
    d = orders_panel(spark, sf_dir).select("region", "y", F.lag("y").over(w).alias("x")).filter("x IS NOT NULL").select("region", (F.col("y") - F.col("x")).alias("dy"), "x")
    c = d.groupBy("region").agg(F.count("*").alias("n"), F.covar_samp("dy", "x").alias("sxy"), F.var_samp("x").alias("sxx"), F.var_samp("dy").alias("syy"))
    no = lambda x: F.nullif(x, F.lit(0.0))  # noqa: E731  nothing can be said of a constant series, or of two steps
    sxy, sxx, syy, n = map(F.col, ("sxy", "sxx", "syy", "n"))
    left = (syy - sxy * sxy / no(sxx)) * (n - 1) / F.nullif(n - 2, F.lit(0)) / no(sxx * (n - 1))
    t = (sxy / no(sxx)) / no(F.sqrt(F.greatest(left, F.lit(0.0))))
    return c.select("region", t.alias("t")).select("region", F.round("t", 3).alias("df_t"), (F.col("t") < -2.86).alias("stationary"))


@plan()
def profile_stationarity_both(spark, sf_dir):
    """Augmented Dickey-Fuller and KPSS for each region, on the series and on its differences."""
    return series.stationarity(orders_panel(spark, sf_dir))
