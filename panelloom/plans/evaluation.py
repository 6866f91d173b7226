"""Backtest frames and their metrics: regression, classification, leaderboards."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelloom.operators import backtest as bt
from panelloom.operators import metrics as m
from panelloom.plans.base import PANEL, PREDS, Plans
from panelloom.sources.panels import orders_panel, tiers

plan = Plans()
QUERIES, SQL = plan.queries, plan.sql
R = lambda c, n=6: F.round(c, n) + 0.0
E = "(greatest(y_pred, 0)::DOUBLE - y_true)"
VIEW = "CASE WHEN grouping(region) = 0 AND grouping(horizon) = 0 THEN 'region_horizon' WHEN grouping(region) = 0 THEN 'region' WHEN grouping(horizon) = 0 THEN 'horizon' ELSE 'global' END"
GS = "GROUP BY GROUPING SETS ((region), (horizon), (region, horizon), ())"


def _preds(spark, sf_dir):
    return bt.long_predictions(orders_panel(spark, sf_dir))


def _views(*items: str) -> str:
    return PREDS + f" SELECT {VIEW} AS view, region, horizon, {', '.join(items)} FROM preds {GS}"


_MAE, _RMSE, _ME = f"round(avg(abs({E})), 6) AS MAE", f"round(sqrt(avg({E} * {E})), 6) AS RMSE", f"round(avg({E}), 6) + 0.0 AS ME"


@plan(_views(_MAE, _RMSE, _ME, "count(*)::BIGINT AS n"))
def eval_base_metrics(spark, sf_dir):
    return m.views(_preds(spark, sf_dir), R(m.metric("MAE")).alias("MAE"), R(m.metric("RMSE")).alias("RMSE"), R(m.metric("ME")).alias("ME"), F.count("*").alias("n"))


@plan(_views(f"round(median(abs({E})), 6) AS MedAE"))
def eval_median_error(spark, sf_dir):
    return m.views(_preds(spark, sf_dir), R(m.metric("MedAE")).alias("MedAE"))


_M = "greatest(greatest(y_pred, 0)::DOUBLE, 1e-9)"


@plan(_views(f"round(avg(2 * (CASE WHEN y_true > 0 THEN y_true * ln(y_true / {_M}) ELSE 0 END - y_true + {_M})), 4) AS PoissonDev"))
def eval_poisson_deviance(spark, sf_dir):
    return m.views(_preds(spark, sf_dir), R(m.metric("PoissonDev"), 4).alias("PoissonDev"))


@plan(_views(f"round(avg(2 * (pow(y_true, 0.5) / ((1 - 1.5) * (2 - 1.5)) - y_true * pow({_M}, 1 - 1.5) / (1 - 1.5) + pow({_M}, 0.5) / 0.5)), 2) AS TweedieDev").replace("pow(y_true, 0.5)", "pow(y_true::DOUBLE, 0.5::DOUBLE)").replace("1 - 1.5)", "-0.5::DOUBLE)").replace("(2 - 1.5)", "0.5::DOUBLE"))
def eval_tweedie_deviance(spark, sf_dir):
    return m.views(_preds(spark, sf_dir), R(m.metric("TweedieDev"), 2).alias("TweedieDev"))


@plan(_views("round(avg(CASE WHEN (y_true = 0) = (greatest(y_pred, 0) < 0.5) THEN 1 ELSE 0 END), 6) AS ZeroAcc"))
def eval_zero_accuracy(spark, sf_dir):
    return m.views(_preds(spark, sf_dir), R(m.metric("ZeroAcc")).alias("ZeroAcc"))


SCALES = ", bound AS (SELECT CAST(floor((max(t_idx)) * 0.7) AS INT) + 1 AS lim FROM panel), d7 AS (SELECT region, t_idx, y - lag(y, 7) OVER (PARTITION BY region ORDER BY t_idx) AS d FROM panel, bound WHERE t_idx < lim), scales AS (SELECT region, avg(abs(d)) AS mae_scale, sqrt(avg(d * d)) AS rmse_scale FROM d7 GROUP BY region)"


def _scales(panel):
    return m.naive_scales(panel, bt.split_after_idx(bt.length(panel), 0.7) + 1)


@plan(PANEL + SCALES + " SELECT region, round(mae_scale, 6) AS mae_scale, round(rmse_scale, 6) AS rmse_scale FROM scales")
def eval_naive_scales(spark, sf_dir):
    return _scales(orders_panel(spark, sf_dir)).select("region", R(F.col("mae_scale")).alias("mae_scale"), R(F.col("rmse_scale")).alias("rmse_scale"))


def _scaled(spark, sf_dir):
    """Predictions with each row's errors divided by its region's scales."""
    panel = orders_panel(spark, sf_dir)
    return bt.long_predictions(panel).join(F.broadcast(_scales(panel)), "region", "left")


_MASE = f"round(avg(abs({E})) / nullif(any_value(mae_scale), 0), 6) AS MASE"
_RMSSE = f"round(sqrt(avg({E} * {E})) / nullif(any_value(rmse_scale), 0), 6) AS RMSSE"


@plan(PREDS + SCALES + f" SELECT region, horizon, {_MASE}, {_RMSSE} FROM preds JOIN scales USING (region) GROUP BY region, horizon")
def eval_scaled_errors(spark, sf_dir):
    by = _scaled(spark, sf_dir).groupBy("region", "horizon")
    return by.agg(R(m.metric("MAE") / F.nullif(F.first("mae_scale"), F.lit(0.0))).alias("MASE"), R(m.metric("RMSE") / F.nullif(F.first("rmse_scale"), F.lit(0.0))).alias("RMSSE"))


@plan(PREDS + SCALES + f""" SELECT {VIEW} AS view, region, horizon, {_MAE}, {_RMSE}, {_ME}, count(*)::BIGINT AS n,
CASE WHEN grouping(region) = 0 THEN round(avg(abs({E})) / nullif(any_value(mae_scale), 0), 6) END AS MASE,
CASE WHEN grouping(region) = 0 THEN round(sqrt(avg({E} * {E})) / nullif(any_value(rmse_scale), 0), 6) END AS RMSSE FROM preds JOIN scales USING (region) {GS}""")
def eval_four_views(spark, sf_dir):
    """Per region, horizon, both, and overall; scaled errors where the region is part of the key."""
    found = m.views(_scaled(spark, sf_dir), m.metric("MAE").alias("a"), m.metric("RMSE").alias("r"), R(m.metric("ME")).alias("ME"), F.count("*").alias("n"), F.first("mae_scale").alias("ms"), F.first("rmse_scale").alias("rs"))
    keyed = lambda x, s: F.when(F.col("view").startswith("region"), R(F.col(x) / F.nullif(F.col(s), F.lit(0.0))))
    return found.select("view", "region", "horizon", R(F.col("a")).alias("MAE"), R(F.col("r")).alias("RMSE"), "ME", "n", keyed("a", "ms").alias("MASE"), keyed("r", "rs").alias("RMSSE"))


_BY_REGION = f"per AS (SELECT region, avg(abs({E})) / nullif(any_value(mae_scale), 0) AS mase, sqrt(avg({E} * {E})) / nullif(any_value(rmse_scale), 0) AS rmsse FROM preds JOIN scales USING (region) GROUP BY region)"


@plan(PREDS + SCALES + f", {_BY_REGION} SELECT round(avg(mase), 6) AS MASE_mean, round(median(mase), 6) AS MASE_median, round(avg(rmsse), 6) AS RMSSE_mean FROM per")
def eval_macro_scaled(spark, sf_dir):
    per = _scaled(spark, sf_dir).groupBy("region").agg((m.metric("MAE") / F.nullif(F.first("mae_scale"), F.lit(0.0))).alias("mase"), (m.metric("RMSE") / F.nullif(F.first("rmse_scale"), F.lit(0.0))).alias("rmsse"))
    return per.agg(R(F.avg("mase")).alias("MASE_mean"), R(F.median("mase")).alias("MASE_median"), R(F.avg("rmsse")).alias("RMSSE_mean"))


@plan(PREDS + SCALES + f" SELECT horizon, round(avg(mase), 6) AS MASE FROM (SELECT region, horizon, avg(abs({E})) / nullif(any_value(mae_scale), 0) AS mase FROM preds JOIN scales USING (region) GROUP BY region, horizon) GROUP BY horizon")
def eval_horizon_macro(spark, sf_dir):
    """Scaled error of a horizon: the mean over regions."""
    per = _scaled(spark, sf_dir).groupBy("region", "horizon").agg((m.metric("MAE") / F.nullif(F.first("mae_scale"), F.lit(0.0))).alias("mase"))
    return per.groupBy("horizon").agg(R(F.avg("mase")).alias("MASE"))


@plan(PREDS + f" SELECT tier, horizon, {_MAE}, {_RMSE}, count(*)::BIGINT AS n FROM preds JOIN tiers USING (region) GROUP BY GROUPING SETS ((tier), (tier, horizon))")
def eval_tier_views(spark, sf_dir):
    panel = orders_panel(spark, sf_dir)
    held = bt.long_predictions(panel).join(F.broadcast(tiers(panel)), "region")
    return held.groupingSets([["tier"], ["tier", "horizon"]], "tier", "horizon").agg(R(m.metric("MAE")).alias("MAE"), R(m.metric("RMSE")).alias("RMSE"), F.count("*").alias("n"))


@plan(_views(f"round(1 - sum({E} * {E}) / nullif(var_pop(y_true) * count(*), 0), 4) AS R2"))
def eval_r2(spark, sf_dir):
    e = m.error()
    return m.views(_preds(spark, sf_dir), R(1 - F.sum(e * e) / F.nullif(F.var_pop("y_true") * F.count("*"), F.lit(0.0)), 4).alias("R2"))


@plan(PREDS + f" SELECT horizon, {_MAE}, {_RMSE}, round(avg(abs({E})) FILTER (WHERE y_true > 0), 6) AS MAE_pos, round(sqrt(avg({E} * {E}) FILTER (WHERE y_true > 0)), 6) AS RMSE_pos, round(avg(2 * (y_true * ln(y_true / greatest(y_pred::DOUBLE, 1e-6)) - y_true + greatest(y_pred::DOUBLE, 1e-6))) FILTER (WHERE y_true > 0), 4) AS PoissonDev_pos, count(*) FILTER (WHERE y_true > 0)::BIGINT AS n_positive FROM preds GROUP BY horizon")
def eval_positive_metrics(spark, sf_dir):
    e, y = m.error(), F.col("y_true")
    mu = F.greatest(m.clipped(), F.lit(1e-6))
    pos = lambda c: F.when(y > 0, c)
    return _preds(spark, sf_dir).groupBy("horizon").agg(
        R(m.metric("MAE")).alias("MAE"), R(m.metric("RMSE")).alias("RMSE"), R(F.avg(pos(F.abs(e)))).alias("MAE_pos"), R(F.sqrt(F.avg(pos(e * e)))).alias("RMSE_pos"),
        R(F.avg(pos(2 * (y * F.ln(y / mu) - y + mu))), 4).alias("PoissonDev_pos"), F.count(pos(y)).alias("n_positive"),
    )


@plan(PREDS + f" SELECT region, round(1 - avg(abs({E})) / nullif(avg(abs(y_last - y_true)), 0), 6) AS skill FROM preds GROUP BY region")
def eval_skill(spark, sf_dir):
    """1 - error / the baseline's error; null where the baseline has none."""
    return _preds(spark, sf_dir).groupBy("region").agg(R(1 - m.metric("MAE") / F.nullif(m.metric("MAE", pred="y_last"), F.lit(0.0))).alias("skill"))


@plan(PREDS + f" SELECT region, {_MAE}, count(*)::BIGINT AS n FROM preds WHERE y_true > 0 GROUP BY region")
def eval_positive_only(spark, sf_dir):
    return _preds(spark, sf_dir).filter("y_true > 0").groupBy("region").agg(R(m.metric("MAE")).alias("MAE"), F.count("*").alias("n"))


@plan(PREDS + f" SELECT region, horizon, {_MAE} FROM preds WHERE region IN (SELECT region FROM tiers WHERE tier >= 2) GROUP BY region, horizon")
def join_semi_active(spark, sf_dir):
    panel = orders_panel(spark, sf_dir)
    return bt.long_predictions(panel).join(F.broadcast(tiers(panel).filter("tier >= 2")), "region", "left_semi").groupBy("region", "horizon").agg(R(m.metric("MAE")).alias("MAE"))


# --- folds and naive forecasts -------------------------------------------------------------


@plan(PREDS + " SELECT region, fold, horizon, date, y_true FROM preds")
def bt_folds(spark, sf_dir):
    return _preds(spark, sf_dir).select("region", "fold", "horizon", "date", "y_true")


@plan(PREDS + " SELECT region, fold, horizon, y_true, y_last AS y_pred FROM preds")
def naive_last(spark, sf_dir):
    return _preds(spark, sf_dir).select("region", "fold", "horizon", "y_true", F.col("y_last").alias("y_pred"))


@plan(PREDS + " SELECT region, fold, horizon, y_true, y_pred FROM preds")
def naive_weekly(spark, sf_dir):
    return _preds(spark, sf_dir).select("region", "fold", "horizon", "y_true", "y_pred")


@plan(PANEL + " SELECT region, event_date, coalesce(last_value(CASE WHEN y >= 0 THEN y END IGNORE NULLS) OVER (PARTITION BY region ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS stat FROM panel")
def naive_last_non_negative(spark, sf_dir):
    return bt.last_non_negative(orders_panel(spark, sf_dir)).select("region", "event_date", "stat")


@plan(PANEL + " SELECT region, event_date, round(coalesce(avg(CASE WHEN y >= 0 THEN y END) OVER (PARTITION BY region ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS stat FROM panel")
def naive_expanding_mean(spark, sf_dir):
    return bt.non_negative_mean(orders_panel(spark, sf_dir)).select("region", "event_date", R(F.col("stat")).alias("stat"))


@plan(PREDS + """, stats AS (SELECT region, t_idx, avg(y) OVER (PARTITION BY region ORDER BY t_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mean FROM panel),
held AS (SELECT p.*, s.mean FROM preds p JOIN stats s ON s.region = p.region AND s.t_idx = p.fold + (SELECT start FROM size))
SELECT method, horizon, round(avg(abs(v - y_true)), 6) AS MAE, count(*)::BIGINT AS n FROM (
  SELECT 'last' AS method, horizon, y_last::DOUBLE AS v, y_true FROM held UNION ALL SELECT 'last_non_negative', horizon, y_last::DOUBLE, y_true FROM held UNION ALL SELECT 'non_negative_mean', horizon, mean, y_true FROM held) GROUP BY method, horizon""")
def naive_methods_union(spark, sf_dir):
    panel = orders_panel(spark, sf_dir)
    n = bt.length(panel)
    skeleton = bt.at(panel, "y", "y_true", F.col("t0") + F.col("horizon") - 1, bt.folds(panel, int(0.8 * n), n=n))
    parts = [bt.naive(panel, skeleton, k).select(F.lit(k).alias("method"), "horizon", "y_pred", "y_true") for k in ("last", "last_non_negative", "non_negative_mean")]
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return whole.groupBy("method", "horizon").agg(R(m.metric("MAE")).alias("MAE"), F.count("*").alias("n"))


@plan(PANEL + ", b AS (SELECT max(t_idx) AS l FROM panel) SELECT region, t_idx, CASE WHEN t_idx <= CAST(floor(l * 0.7) AS INT) THEN 'train' WHEN t_idx <= CAST(floor(l * 0.7999999999999999::DOUBLE) AS INT) THEN 'val' ELSE 'test' END AS segment FROM panel, b")
def bt_split_segments(spark, sf_dir):
    panel = orders_panel(spark, sf_dir)
    return panel.select("region", "t_idx", bt.segments(bt.length(panel)).alias("segment"))


@plan(PANEL + ", b AS (SELECT CAST(floor((max(t_idx) + 1) * 0.8) AS INT) AS n FROM panel) SELECT region, t_idx, y, (t_idx >= CAST(floor(n * 0.875) AS INT)) AS scored FROM panel, b WHERE t_idx < n")
def bt_cv_view(spark, sf_dir):
    """The first 80 %, scored from seven eighths of it on."""
    panel = orders_panel(spark, sf_dir)
    n = int(bt.length(panel) * 0.8)
    return panel.filter(F.col("t_idx") < n).select("region", "t_idx", "y", (F.col("t_idx") >= int(n * 0.875)).alias("scored"))


@plan(PREDS + " SELECT DISTINCT fold, (fold // 7)::INT AS retrain_id, ((fold // 7) * 7 + start)::INT AS context_end FROM preds, size")
def bt_retrain_schedule(spark, sf_dir):
    """A model stays for seven folds; it has seen everything before its first."""
    panel = orders_panel(spark, sf_dir)
    n = bt.length(panel)
    start = int(0.8 * n)
    model = F.floor(F.col("fold") / 7).cast("int")
    return bt.folds(panel, start, n=n).select("fold", model.alias("retrain_id"), (model * 7 + start).alias("context_end")).distinct()


@plan(PREDS + f" SELECT fold, round(sum(sum(abs({E}))) OVER (ORDER BY fold) / sum(count(*)) OVER (ORDER BY fold), 6) AS mae_so_far FROM preds GROUP BY fold")
def bt_cumulative_score(spark, sf_dir):
    """The score after each fold; folds are few, so one window over them is small."""
    from pyspark.sql import Window

    per = _preds(spark, sf_dir).groupBy("fold").agg(F.sum(F.abs(m.error())).alias("s"), F.count("*").alias("n"))
    w = Window.orderBy("fold")
    return per.select("fold", R(F.sum("s").over(w) / F.sum("n").over(w)).alias("mae_so_far"))


# --- classification ---------------------------------------------------------------------------

_TP = "count(*) FILTER (WHERE y_true > 0 AND y_prob >= t)"
_FP = "count(*) FILTER (WHERE y_true <= 0 AND y_prob >= t)"
_FN = "count(*) FILTER (WHERE y_true > 0 AND y_prob < t)"
_TN = "count(*) FILTER (WHERE y_true <= 0 AND y_prob < t)"


def _ratio_sql(tp=_TP, fp=_FP, fn=_FN):
    return f"round(coalesce({tp} / nullif({tp} + {fp}, 0), 0), 6)::DOUBLE AS precision, round(coalesce({tp} / nullif({tp} + {fn}, 0), 0), 6)::DOUBLE AS recall, round(coalesce(2 * {tp} / nullif(2 * {tp} + {fp} + {fn}, 0), 0), 6)::DOUBLE AS f1"


_CONF = f"{_TP} AS TP, {_FP} AS FP, {_TN} AS TN, {_FN} AS FN, {_ratio_sql()}"


def _with_ratios(df):
    return df.select("*", *m.ratios()).withColumns({k: R(F.col(k)) for k in ("precision", "recall", "f1")})


@plan(PREDS + f" SELECT horizon, {_CONF} FROM preds, (SELECT 0.5 AS t) GROUP BY horizon")
def eval_confusion(spark, sf_dir):
    return _with_ratios(_preds(spark, sf_dir).groupBy("horizon").agg(*m.confusion(F.lit(0.5))))


def _auc_sql(keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else ""
    return f"""s AS (SELECT {lead}y_prob, count(*) FILTER (WHERE y_true > 0) AS pos, count(*) FILTER (WHERE y_true <= 0) AS neg FROM preds GROUP BY {lead}y_prob),
c AS (SELECT *, coalesce(sum(neg) OVER ({part} ORDER BY y_prob ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
  sum(pos) OVER ({part} ORDER BY y_prob DESC ROWS UNBOUNDED PRECEDING) AS tp, sum(pos + neg) OVER ({part} ORDER BY y_prob DESC ROWS UNBOUNDED PRECEDING) AS n FROM s),
auc AS (SELECT {lead}round(sum(pos * (below + neg / 2.0::DOUBLE)) / nullif(sum(pos) * sum(neg), 0), 6) AS roc_auc, round(sum(pos * tp / n) / nullif(sum(pos), 0), 6) AS pr_auc FROM c {group})"""


@plan(PREDS + f", {_auc_sql('region')} SELECT region, roc_auc FROM auc")
def eval_roc_auc(spark, sf_dir):
    return m.roc_auc(_preds(spark, sf_dir), ["region"]).select("region", R(F.col("roc_auc")).alias("roc_auc"))


@plan(PREDS + f", {_auc_sql('region')} SELECT region, pr_auc FROM auc")
def eval_pr_auc(spark, sf_dir):
    return m.pr_auc(_preds(spark, sf_dir), ["region"]).select("region", R(F.col("pr_auc")).alias("pr_auc"))


_YB = "(CASE WHEN y_true > 0 THEN 1 ELSE 0 END)"
_P = "least(greatest(y_prob, 1e-6), 1 - 1e-6)"
_BRIER = f"round(avg((y_prob - {_YB}) * (y_prob - {_YB})), 6) AS brier"
_LL = f"round(avg(-({_YB} * ln({_P}) + (1 - {_YB}) * ln(1 - {_P}))), 6) AS log_loss"
Y = lambda: (F.col("y_true") > 0).cast("int")


def brier():
    return F.avg((F.col("y_prob") - Y()) * (F.col("y_prob") - Y()))


def log_loss():
    p = F.least(F.greatest(F.col("y_prob"), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.avg(-(Y() * F.ln(p) + (1 - Y()) * F.ln(1 - p)))


@plan(_views(_BRIER))
def eval_brier(spark, sf_dir):
    return m.views(_preds(spark, sf_dir), R(brier()).alias("brier"))


@plan(_views(_LL))
def eval_log_loss(spark, sf_dir):
    return m.views(_preds(spark, sf_dir), R(log_loss()).alias("log_loss"))


@plan(PREDS + f", {_auc_sql('horizon')} SELECT p.horizon, {_CONF}, {_BRIER}, any_value(roc_auc) AS roc_auc, any_value(pr_auc) AS pr_auc FROM preds p JOIN auc USING (horizon), (SELECT 0.5 AS t) GROUP BY p.horizon")
def eval_classif_views(spark, sf_dir):
    p = _preds(spark, sf_dir)
    counts = _with_ratios(p.groupBy("horizon").agg(*m.confusion(F.lit(0.5)), R(brier()).alias("brier")))
    return counts.join(m.roc_auc(p, ["horizon"]), "horizon").join(m.pr_auc(p, ["horizon"]), "horizon").withColumns({k: R(F.col(k)) for k in ("roc_auc", "pr_auc")})


@plan(PREDS + f", swept AS (SELECT region, k / 20.0::DOUBLE AS t, {_TP.replace('>= t', '>= k / 20.0::DOUBLE')} AS tp, {_FP.replace('>= t', '>= k / 20.0::DOUBLE')} AS fp, {_FN.replace('< t', '< k / 20.0::DOUBLE')} AS fn FROM preds, (SELECT unnest(range(1, 20)) AS k) GROUP BY region, k), ranked AS (SELECT *, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM swept) SELECT region, t AS threshold, round(f1, 6) AS f1 FROM (SELECT *, row_number() OVER (PARTITION BY region ORDER BY f1 DESC, t) AS r FROM ranked) WHERE r = 1")
def tune_threshold(spark, sf_dir):
    """Of 19 thresholds the first with the largest F1; nineteen counters in one pass, no rows multiplied."""
    p = _preds(spark, sf_dir)
    swept = p.groupBy("region").agg(*[c.alias(f"{n}_{k}") for k in range(1, 20) for c, n in zip(m.confusion(F.lit(k) / 20.0), ("TP", "FP", "TN", "FN"), strict=True)])
    options = F.array(*[F.struct(F.coalesce(2 * F.col(f"TP_{k}") / F.nullif(2 * F.col(f"TP_{k}") + F.col(f"FP_{k}") + F.col(f"FN_{k}"), F.lit(0)), F.lit(0.0)).alias("f1"), (-F.lit(k) / 20.0).alias("minus")) for k in range(1, 20)])
    best = F.array_max(options)
    return swept.select("region", (-best["minus"]).alias("threshold"), R(best["f1"]).alias("f1"))


@plan(PANEL + """, b AS (SELECT max(t_idx) AS l FROM panel), seg AS (SELECT region, y, 'val' AS segment FROM panel, b WHERE t_idx > CAST(floor(l * 0.7) AS INT) AND t_idx <= CAST(floor(l * 0.7999999999999999::DOUBLE) AS INT) UNION ALL SELECT region, y, 'cv' FROM panel, b WHERE t_idx < CAST(floor((l + 1) * 0.8) AS INT))
SELECT segment, region, sum((y > 0)::INT)::BIGINT AS positives, round(avg((y > 0)::INT), 6) AS share, CASE WHEN sum((y > 0)::INT) = 0 THEN 'zero' WHEN sum((y > 0)::INT) < 5 THEN 'low' ELSE 'ok' END AS kind FROM seg GROUP BY segment, region""")
def profile_prevalence(spark, sf_dir):
    panel = orders_panel(spark, sf_dir)
    n = bt.length(panel)
    val = panel.filter((bt.segments(n) == "val")).withColumn("segment", F.lit("val"))
    cv = panel.filter(F.col("t_idx") < int(n * 0.8)).withColumn("segment", F.lit("cv"))
    pos = F.sum((F.col("y") > 0).cast("long"))
    return val.unionByName(cv).groupBy("segment", "region").agg(pos.alias("positives"), R(F.avg((F.col("y") > 0).cast("int"))).alias("share"), F.when(pos == 0, "zero").when(pos < 5, "low").otherwise("ok").alias("kind"))


@plan(PANEL + " SELECT region, round(avg((y > 0)::INT), 6) AS rate, round(avg(y), 6) AS mean, sum(y)::BIGINT AS total, count(*)::BIGINT AS n FROM panel GROUP BY region")
def profile_target_rate(spark, sf_dir):
    return orders_panel(spark, sf_dir).groupBy("region").agg(R(F.avg((F.col("y") > 0).cast("int"))).alias("rate"), R(F.avg("y")).alias("mean"), F.sum("y").alias("total"), F.count("*").alias("n"))


_BIN = "greatest(CAST(ceil(y_prob * 10) AS INT) - 1, 0)"


@plan(PREDS + f" SELECT {_BIN} AS bin, round(avg(y_prob), 6) AS mean_predicted, round(avg({_YB}), 6) AS observed, count(*)::BIGINT AS n FROM preds GROUP BY 1")
def eval_reliability(spark, sf_dir):
    p = _preds(spark, sf_dir).withColumn("bin", F.greatest(F.ceil(F.col("y_prob") * 10).cast("int") - 1, F.lit(0)))
    return p.groupBy("bin").agg(R(F.avg("y_prob")).alias("mean_predicted"), R(F.avg(Y())).alias("observed"), F.count("*").alias("n"))


@plan(PREDS + " SELECT CAST(floor(least(y_prob, 1 - 1e-9) * 10) AS INT) AS bin, count(*)::BIGINT AS n FROM preds GROUP BY 1")
def eval_prob_histogram(spark, sf_dir):
    return _preds(spark, sf_dir).groupBy(F.floor(F.least("y_prob", F.lit(1 - 1e-9)) * 10).cast("int").alias("bin")).agg(F.count("*").alias("n"))
