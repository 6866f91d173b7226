"""Expanding-window backtests as rows: folds, segments, naive forecasts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def steps():
    return Window.partitionBy("region").orderBy("t_idx")


def length(panel: DataFrame) -> int:
    """Steps of a dense panel."""
    return panel.agg(F.max("t_idx")).first()[0] + 1


def split_after_idx(n: int, fraction: float) -> int:
    """Last index of the left part when the part ends at the fraction."""
    return int((n - 1) * fraction)


def split_before_idx(n: int, fraction: float) -> int:
    """First index of the right part when the fraction's index belongs to it."""
    return int((n - 1) * fraction)


def segments(n: int, train: float = 0.7, val: float = 0.1) -> Column:
    """train / val / test by index; the boundary sums are Python doubles, so 0.7 + 0.1 is a little under 0.8."""
    first, second = split_after_idx(n, train), split_after_idx(n, train + val)
    return F.when(F.col("t_idx") <= first, "train").when(F.col("t_idx") <= second, "val").otherwise("test")


def folds(panel: DataFrame, start: int, horizon: int = 7, stride: int = 1, n: int | None = None) -> DataFrame:
    """(region, t0, fold, horizon): forecasts made at t0 for the steps t0 .. t0 + horizon - 1."""
    n = n or length(panel)
    steps = panel.sparkSession.range(1).select(F.explode(F.expr(f"sequence({start}, {n - horizon}, {stride})")).alias("t0"))
    steps = steps.select(F.col("t0").cast("int").alias("t0"), F.floor((F.col("t0") - start) / stride).cast("int").alias("fold"), F.explode(F.expr(f"sequence(1, {horizon})")).alias("horizon"))
    return panel.select("region").distinct().crossJoin(F.broadcast(steps))  # the skeleton itself


def at(panel: DataFrame, value: str, name: str, offset: Column, skeleton: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """Join a panel's value at index ``offset`` onto a skeleton."""
    right = panel.select("region", F.col("t_idx").alias("_t"), F.col(value).alias(name), *extra)
    return skeleton.withColumn("_t", offset.cast("int")).join(right, ["region", "_t"]).drop("_t")


def naive_last(panel: DataFrame, skeleton: DataFrame) -> DataFrame:
    return at(panel, "y", "y_pred", F.col("t0") - 1, skeleton)


def naive_weekly(panel: DataFrame, skeleton: DataFrame, horizon: int = 7) -> DataFrame:
    if horizon > 7:
        raise ValueError("beyond seven steps the value a week earlier isn't known yet")
    return at(panel, "y", "y_pred", F.col("t0") - 7 + F.col("horizon") - 1, skeleton)


def last_non_negative(panel: DataFrame) -> DataFrame:
    """``stat``: the last value that isn't negative before each step, or 0."""
    return panel.withColumn("stat", F.coalesce(F.last(F.when(F.col("y") >= 0, F.col("y")), ignorenulls=True).over(steps().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("double"))


def non_negative_mean(panel: DataFrame) -> DataFrame:
    """``stat``: the mean of the values that aren't negative before each step, or 0."""
    return panel.withColumn("stat", F.coalesce(F.avg(F.when(F.col("y") >= 0, F.col("y"))).over(steps().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def naive(panel: DataFrame, skeleton: DataFrame, method: str) -> DataFrame:
    if method == "last":
        return naive_last(panel, skeleton).withColumn("y_pred", F.col("y_pred").cast("double"))
    if method not in ("last_non_negative", "non_negative_mean"):
        raise ValueError(f"unknown method {method}")
    held = last_non_negative(panel) if method == "last_non_negative" else non_negative_mean(panel)
    return at(held, "stat", "y_pred", F.col("t0"), skeleton)


def long_predictions(panel: DataFrame, horizon: int = 7, stride: int = 1, start: int | None = None) -> DataFrame:
    """(region, fold, horizon, date, y_true, y_pred, y_last, y_prob): weekly and last-value forecasts, and the smoothed share of active days."""
    if horizon > 7:
        raise ValueError("beyond seven steps the value a week earlier isn't known yet")
    w = steps()
    n = F.count("*").over(Window.partitionBy("region"))  # dense: every key has all steps
    begin = F.floor(0.8 * n).cast("int") if start is None else F.lit(start)
    share = (F.coalesce(F.sum((F.col("y") > 0).cast("int")).over(w.rowsBetween(-28, -1)), F.lit(0)) + 1) / F.lit(30.0)
    ahead = lambda h: F.struct(F.lit(h).alias("horizon"), F.lead("event_date", h - 1).over(w).alias("date"), F.lead("y", h - 1).over(w).alias("y_true"), F.lag("y", 8 - h).over(w).alias("y_pred"))
    # One window holds all that a forecast needs, so nothing is joined and the panel is read once.
    held = panel.select("region", F.col("t_idx").alias("t0"), n.alias("n"), begin.alias("start"), F.lag("y", 1).over(w).alias("y_last"), share.alias("y_prob"), F.array(*map(ahead, range(1, horizon + 1))).alias("ahead"))
    made = held.filter((F.col("t0") >= F.col("start")) & (F.col("t0") <= F.col("n") - horizon) & ((F.col("t0") - F.col("start")) % stride == 0))
    fold = F.floor((F.col("t0") - F.col("start")) / stride).cast("int").alias("fold")
    found = made.select("region", fold, "y_last", "y_prob", F.explode("ahead").alias("a")).filter("a.y_pred IS NOT NULL AND y_last IS NOT NULL")
    return found.select("region", "fold", "a.horizon", "a.date", "a.y_true", "a.y_pred", "y_last", "y_prob")
