"""Backtests of linear models from running sums, autoregression, calibration."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.shared import written

FEATURES = ("lag_1", "lag_7", "mean_28")
HORIZONS = (1, 2, 3, 4, 5, 6, 7)


def tabular(panel: DataFrame) -> DataFrame:
    """Lag features known before each step, the step's label, and calendar columns known ahead."""
    w = Window.partitionBy("region").orderBy("t_idx")
    return panel.select(
        "region", "t_idx", "event_date", F.col("y").cast("double").alias("label"), (F.col("y") > 0).cast("double").alias("active"),
        F.lag("y", 1).over(w).cast("double").alias("lag_1"), F.lag("y", 7).over(w).cast("double").alias("lag_7"),
        F.avg("y").over(w.rowsBetween(-28, -1)).alias("mean_28"), (F.weekday("event_date") >= 5).cast("double").alias("is_weekend"),
    ).filter("t_idx >= 28")


def linear_backtest(panel: DataFrame, keys: list[str], start: int, horizons: tuple[int, ...] = HORIZONS, retrain: int = 28, ridge: float | list[float] = 1e-6) -> DataFrame:
    """(region, t0, horizon, y_true, y_pred) of least squares refitted every ``retrain`` steps on all earlier rows.

    A fit needs only sums of products. They are grouped by key, horizon and the refit from which on a
    row is known, then summed up over refits: all folds, keys and horizons in two shuffles. A list of
    ridges is solved from the same sums; the column ``ridge`` tells them apart.
    """
    w = Window.partitionBy("region").orderBy("t_idx")
    names = ("one", *FEATURES)
    rows = tabular(panel).join(panel.select("region", *[k for k in keys if k not in ("region",)]).distinct(), "region") if [k for k in keys if k not in ("region", "all")] else tabular(panel)
    rows = rows.withColumn("one", F.lit(1.0)).withColumn("all", F.lit(0))
    labels = F.array(*[F.struct(F.lit(h).alias("horizon"), F.lead("label", h - 1).over(w).alias("y")) for h in horizons])
    rows = rows.withColumn("labels", labels).withColumn("l", F.explode_outer("labels")).filter("l.y IS NOT NULL").select(*dict.fromkeys(["region", *keys]), "t_idx", *names, "l.horizon", "l.y")
    known = F.greatest(F.floor((F.col("t_idx") + F.col("horizon") - 1 - start) / retrain) + 1, F.lit(0)).cast("int")
    pairs = list(combinations_with_replacement(names, 2))
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"{a}__{b}") for a, b in pairs] + [F.sum(F.col(a) * F.col("y")).alias(f"{a}__y") for a in names]
    parts = rows.groupBy(*keys, "horizon", known.alias("fit")).agg(*sums)
    up = Window.partitionBy(*keys, "horizon").orderBy("fit")
    columns = [f"{a}__{b}" for a, b in pairs] + [f"{a}__y" for a in names]
    running = parts.select(*keys, "horizon", "fit", F.array(*[F.sum(c).over(up) for c in columns]).alias("sums"))

    @F.pandas_udf("array<double>")
    def solve(sums: pd.Series, ridges: pd.Series) -> pd.Series:
        def one(s, ridge):
            xx = np.zeros((len(names), len(names)))
            for v, (a, b) in zip(s, pairs, strict=False):
                i, j = names.index(a), names.index(b)
                xx[i, j] = xx[j, i] = v
            return np.linalg.solve(xx + ridge * np.eye(len(names)), np.asarray(s[len(pairs) :])).tolist()

        return pd.Series([one(s, r) for s, r in zip(sums, ridges, strict=True)])

    several = isinstance(ridge, list)
    held = running.withColumn("ridge", F.explode(F.array(*map(F.lit, ridge))) if several else F.lit(ridge))
    fits = held.withColumn("beta", solve("sums", "ridge")).select(*keys, "horizon", "fit", "ridge", "beta")
    asked = rows.filter(F.col("t_idx") >= start).withColumn("fit", F.floor((F.col("t_idx") - start) / retrain).cast("int"))
    value = sum((F.col(n) * F.col("beta")[i] for i, n in enumerate(names)), F.lit(0.0))
    return asked.join(fits, [*keys, "horizon", "fit"]).select("region", F.col("t_idx").alias("t0"), "horizon", F.col("y").alias("y_true"), value.alias("y_pred"), *["ridge"] * several)


def autoregression(panel: DataFrame, order: int = 7, ridge: float = 1e-6) -> DataFrame:
    """(region, t_idx, y, y_pred): each step's forecast from its ``order`` last values, refitted at each step on all earlier ones by running sums.

    Null until there are more earlier rows than coefficients.
    """
    w = Window.partitionBy("region").orderBy("t_idx")
    names = ("one", *(f"x{i}" for i in range(1, order + 1)))
    held = panel.select("region", "t_idx", F.col("y").cast("double").alias("y"), F.lit(1.0).alias("one"), *[F.lag("y", i).over(w).cast("double").alias(f"x{i}") for i in range(1, order + 1)]).filter(f"x{order} IS NOT NULL")
    pairs = list(combinations_with_replacement(range(len(names)), 2))
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.sum(F.col(names[a]) * F.col(names[b])).over(past) for a, b in pairs] + [F.sum(F.col(n) * F.col("y")).over(past) for n in names]
    rows = held.select("region", "t_idx", "y", F.array(*names).alias("x"), F.array(*sums).alias("sums"))

    @F.pandas_udf("double")
    def forecast(x: pd.Series, sums: pd.Series) -> pd.Series:
        def one(v, s):
            if s[0] is None or not s[0] > len(names):
                return None
            xx = np.zeros((len(names), len(names)))
            for value, (i, j) in zip(s, pairs, strict=False):
                xx[i, j] = xx[j, i] = value
            return float(np.linalg.solve(xx + ridge * np.eye(len(names)), np.asarray(s[len(pairs) :], float)) @ np.asarray(v, float))

        return pd.Series([one(v, s) for v, s in zip(x, sums, strict=True)], dtype="float64")

    found = rows.withColumn("f", forecast("x", "sums")).select("region", "t_idx", F.when(F.col("f").isNotNull() & ~F.isnan("f"), F.col("f")).alias("y_pred"))
    return panel.select("region", "t_idx", "y").join(found, ["region", "t_idx"], "left")


def platt(preds: DataFrame, key: str = "horizon", steps: int = 12, ridge: float = 1e-4) -> DataFrame:
    """(key, a, b) of 1 / (1 + exp(-(a + b logit p))) fitted for all keys at once by Newton's method; five sums a key and step."""
    spark = preds.sparkSession
    z = F.ln(F.least(F.greatest(F.col("y_prob"), F.lit(1e-6)), F.lit(1 - 1e-6)) / (1 - F.least(F.greatest(F.col("y_prob"), F.lit(1e-6)), F.lit(1 - 1e-6))))
    # A row for each distinct score, kept: every step reads it.
    held = written(preds.groupBy(key, z.alias("z")).agg(F.sum((F.col("y_true") > 0).cast("double")).alias("pos"), F.count("*").cast("double").alias("n")))
    both = held.groupBy(key).agg(F.sum("pos").alias("p"), F.sum("n").alias("n")).filter("p > 0 AND p < n")  # one class: no calibrator
    now = {r[key]: (0.0, 1.0) for r in both.collect()}
    for _ in range(steps):
        if not now:
            break
        frame = spark.createDataFrame([(k, *v) for k, v in now.items()], f"{key} int, a double, b double")
        p = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.col("z"))))
        q = F.col("n") * p * (1 - p)
        g = held.join(F.broadcast(frame), key).groupBy(key).agg(
            F.sum(F.col("pos") - F.col("n") * p).alias("g0"), F.sum((F.col("pos") - F.col("n") * p) * F.col("z")).alias("g1"),
            F.sum(q).alias("h0"), F.sum(q * F.col("z")).alias("h1"), F.sum(q * F.col("z") * F.col("z")).alias("h2"),
        ).collect()
        for r in g:
            a, b = now[r[key]]
            step = np.linalg.solve([[r.h0 + ridge, r.h1], [r.h1, r.h2 + ridge]], [r.g0 - ridge * a, r.g1 - ridge * b])
            now[r[key]] = (a + float(step[0]), b + float(step[1]))
    return spark.createDataFrame([(k, *v) for k, v in now.items()], f"{key} int, a double, b double")


def calibrated(preds: DataFrame, fits: DataFrame, key: str = "horizon") -> DataFrame:
    """``y_cal``; where the key has no calibrator the raw probability passes."""
    p = F.least(F.greatest(F.col("y_prob"), F.lit(1e-6)), F.lit(1 - 1e-6))
    value = 1 / (1 + F.exp(-(F.col("a") + F.col("b") * F.ln(p / (1 - p)))))
    return preds.join(F.broadcast(fits), key, "left").withColumn("y_cal", F.coalesce(value, F.col("y_prob"))).drop("a", "b")


def pooled(pos: np.ndarray, n: np.ndarray) -> list:
    """Pool adjacent violators from the left, kept for every place: the blocks of cells 0 .. i as (pos, n, blocks before), linked to those before."""
    heads, head = [None], None
    for p, m in zip(pos.tolist(), n.tolist(), strict=True):
        while head is not None and head[0] * m >= p * head[1]:
            p, m, head = p + head[0], m + head[1], head[2]
        head = (p, m, head)
        heads.append(head)
    return heads


def joined_once(scores: np.ndarray, pos: np.ndarray, n: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """(p0, p1) for each asked score: the isotonic fit's value there with one negative, and with one positive, more.

    Only the new cell's own block can differ from the fits of what lies left and of what lies right of it, so it
    grows into those from the middle; they are pooled once for all scores.
    """
    left = pooled(pos, n)
    # from the right the order is turned round: what rises to the right falls to the left
    right = pooled((n - pos)[::-1], n[::-1])
    found = np.zeros((len(asked), 2))
    first, last = np.searchsorted(scores, asked, "left"), np.searchsorted(scores, asked, "right")
    for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        for y in (0.0, 1.0):
            p, m = y + float(pos[a:b].sum()), 1.0 + float(n[a:b].sum())
            l, r = left[a], right[len(scores) - b]
            while True:
                if l is not None and l[0] * m >= p * l[1]:
                    p, m, l = p + l[0], m + l[1], l[2]
                elif r is not None and (r[1] - r[0]) * m <= p * r[1]:
                    p, m, r = p + r[1] - r[0], m + r[1], r[2]
                else:
                    break
            found[k, int(y)] = p / m
    return found


def venn_abers(train: DataFrame, test: DataFrame, key: str = "horizon", grid: int = 10_000) -> DataFrame:
    """(key, score, p): each distinct test score joined once as negative and once as positive to the isotonic fit; p1 / (1 - p0 + p1).

    Scores lie on a grid, so a key's group has a bounded number of rows however long the tables; the finer
    the grid, the less two scores are taken as one.
    """
    score = F.round(F.col("y_prob") * grid) / grid
    cells = train.groupBy(key, score.alias("score")).agg(F.sum((F.col("y_true") > 0).cast("double")).alias("pos"), F.count("*").cast("double").alias("n"), F.lit(0).alias("asked"))
    asked = test.select(key, score.alias("score")).distinct().select(key, "score", F.lit(0.0).alias("pos"), F.lit(0.0).alias("n"), F.lit(1).alias("asked"))

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        known, wanted = frame[frame.asked == 0].sort_values("score"), np.sort(frame[frame.asked == 1].score.unique())
        p = joined_once(known.score.to_numpy(), known.pos.to_numpy(), known.n.to_numpy(), wanted)
        return pd.DataFrame({key: [frame[key].iloc[0]] * len(wanted), "score": wanted, "p": p[:, 1] / (1 - p[:, 0] + p[:, 1])})

    return cells.unionByName(asked).groupBy(key).applyInPandas(fit, f"{key} int, score double, p double")
