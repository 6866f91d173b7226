"""Forecast metrics as column expressions, grouping-set views, and rank metrics from distinct scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VIEWS = "GROUPING SETS ((region), (horizon), (region, horizon), ())"


def clipped(pred: str = "y_pred") -> Column:
    return F.greatest(F.col(pred).cast("double"), F.lit(0.0))


def error(pred: str = "y_pred", true: str = "y_true") -> Column:
    return clipped(pred) - F.col(true)


def poisson_deviance(pred: str = "y_pred", true: str = "y_true", floor: float = 1e-9) -> Column:
    y, m = F.col(true).cast("double"), F.greatest(clipped(pred), F.lit(floor))
    return F.avg(2 * (F.when(y > 0, y * F.ln(y / m)).otherwise(0.0) - y + m))


def tweedie_deviance(pred: str = "y_pred", true: str = "y_true", power: float = 1.5, floor: float = 1e-9) -> Column:
    y, m, p = F.col(true).cast("double"), F.greatest(clipped(pred), F.lit(floor)), power
    return F.avg(2 * (F.pow(y, F.lit(2 - p)) / ((1 - p) * (2 - p)) - y * F.pow(m, F.lit(1 - p)) / (1 - p) + F.pow(m, F.lit(2 - p)) / (2 - p)))


def zero_accuracy(pred: str = "y_pred", true: str = "y_true") -> Column:
    return F.avg(((F.col(true) == 0) == (clipped(pred) < 0.5)).cast("int"))


#: Metric names for callers that choose one by name; each makes an aggregate.
REGISTRY = {
    "MAE": lambda **k: F.avg(F.abs(error(**k))),
    "RMSE": lambda **k: F.sqrt(F.avg(error(**k) * error(**k))),
    "ME": lambda **k: F.avg(error(**k)),
    "MedAE": lambda **k: F.median(F.abs(error(**k))),
    "PoissonDev": poisson_deviance,
    "TweedieDev": tweedie_deviance,
    "ZeroAcc": zero_accuracy,
}


def metric(name: str, **columns) -> Column:
    if name not in REGISTRY:
        raise ValueError(f"unknown metric {name}; one of {sorted(REGISTRY)}")
    return REGISTRY[name](**columns)


def views(df: DataFrame, *aggregates: Column) -> DataFrame:
    """``view``, region, horizon and the aggregates for each region, horizon, pair of both, and overall, in one pass."""
    found = df.groupingSets([["region"], ["horizon"], ["region", "horizon"], []], "region", "horizon").agg(F.grouping_id().alias("g"), *aggregates)
    return found.withColumn("view", F.element_at(F.array(*map(F.lit, ("region_horizon", "region", "horizon", "global"))), F.col("g").cast("int") + 1)).drop("g")


def naive_scales(panel: DataFrame, last: int, season: int = 7) -> DataFrame:
    """Per region the mean absolute and root mean square of seasonal differences over steps before ``last``; null without enough steps."""
    w = Window.partitionBy("region").orderBy("t_idx")
    d = panel.filter(F.col("t_idx") < last).withColumn("d", F.col("y") - F.lag("y", season).over(w))
    return d.groupBy("region").agg(F.avg(F.abs("d")).alias("mae_scale"), F.sqrt(F.avg(F.col("d") * F.col("d"))).alias("rmse_scale"))


def confusion(threshold: Column, true: str = "y_true", prob: str = "y_prob") -> list[Column]:
    y, p = F.col(true) > 0, F.col(prob) >= threshold
    count = lambda c: F.sum(c.cast("long"))
    return [count(y & p).alias("TP"), count(~y & p).alias("FP"), count(~y & ~p).alias("TN"), count(y & ~p).alias("FN")]


def ratios() -> list[Column]:
    """Precision, recall and F1 of TP, FP, FN; 0 where nothing is predicted or there."""
    zero = lambda a, b: F.coalesce(F.col(a) / F.nullif(b, F.lit(0)), F.lit(0.0))
    tp, fp, fn = map(F.col, ("TP", "FP", "FN"))
    return [zero("TP", tp + fp).alias("precision"), zero("TP", tp + fn).alias("recall"), F.coalesce(2 * tp / F.nullif(2 * tp + fp + fn, F.lit(0)), F.lit(0.0)).alias("f1")]


def _by_score(df: DataFrame, keys: list[str], prob: str, true: str) -> DataFrame:
    """Positives and negatives of each distinct score: all that rank metrics need."""
    return df.groupBy(*keys, prob).agg(F.sum((F.col(true) > 0).cast("long")).alias("pos"), F.sum((F.col(true) <= 0).cast("long")).alias("neg"))


def roc_auc(df: DataFrame, keys: list[str], prob: str = "y_prob", true: str = "y_true") -> DataFrame:
    """Rank statistic with ties counted half; null where one class is missing."""
    below = Window.partitionBy(*keys).orderBy(prob).rowsBetween(Window.unboundedPreceding, -1)
    held = _by_score(df, keys, prob, true).withColumn("below", F.coalesce(F.sum("neg").over(below), F.lit(0)))
    wins = F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2.0))
    return held.groupBy(*keys).agg((wins / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("roc_auc"))


def pr_auc(df: DataFrame, keys: list[str], prob: str = "y_prob", true: str = "y_true") -> DataFrame:
    """Average precision over the distinct thresholds, highest first; null without positives."""
    down = Window.partitionBy(*keys).orderBy(F.desc(prob)).rowsBetween(Window.unboundedPreceding, 0)
    held = _by_score(df, keys, prob, true)
    held = held.withColumn("tp", F.sum("pos").over(down)).withColumn("n", F.sum(F.col("pos") + F.col("neg")).over(down))
    return held.groupBy(*keys).agg((F.sum(F.col("pos") * F.col("tp") / F.col("n")) / F.nullif(F.sum("pos"), F.lit(0))).alias("pr_auc"))
