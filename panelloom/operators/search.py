"""Parameter search: every trial of every variant is a key of one backtest, and all trials share its sums."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators import expanding as ex
from panelloom.operators import metrics
from panelloom.operators.series import products, square
from panelloom.operators.shared import written


def searched(panel: DataFrame, start: int, variants: dict[str, tuple[str, ...]], trials: list[tuple[int, str, float, int]], horizons: tuple[int, ...] = ex.HORIZONS, first: int = 28) -> DataFrame:
    """(number, variant, value, ridge, retrain, best) for each of ``trials`` (number, variant, ridge, retrain): the mean over regions of the scaled
    root mean square error of linear models refitted every ``retrain`` steps; ``best`` marks each variant's winner.

    ``variants`` name sets of features. Products of all features are summed once, by horizon and by the common divisor of the trials' strides; a trial
    takes its rows and columns of them.
    """
    names = list(dict.fromkeys(f for fs in variants.values() for f in fs))
    unit = math.gcd(*[t[3] for t in trials])
    rows = written(ex.direct_rows(panel, horizons))
    last = rows.agg(F.max("t0")).first()[0]
    last = -1 if last is None or last < start else (last - start) // unit
    known = F.greatest(F.floor((F.col("t0") + F.col("horizon") - 1 - start) / unit) + 1, F.lit(0)).cast("int")
    vector = F.array("one", *[F.col(n).cast("double") for n in names], F.col("y_true").cast("double"))
    parts = products(rows.filter(F.col("t0") >= first).withColumn("unit", known).filter(F.col("unit") <= last).select("horizon", "unit", vector.alias("vector")), ["horizon", "unit"], "vector")
    cells = (len(names) + 2) * (len(names) + 3) // 2
    up = Window.partitionBy("horizon").orderBy("unit")
    grid = parts.select("horizon").distinct().select("horizon", F.explode(F.sequence(F.lit(0), F.lit(max(last, 0)))).alias("unit"))
    running = grid.join(parts, ["horizon", "unit"], "left").select("horizon", "unit", F.array(*[F.sum(F.get("sums", F.lit(i))).over(up) for i in range(cells)]).alias("sums"))

    asked = F.array(*[F.struct(F.lit(n).alias("number"), F.lit(v).alias("variant"), F.lit(float(r)).alias("ridge"), F.lit(s).alias("retrain"), F.array(*[F.lit(names.index(f) + 1) for f in variants[v]]).alias("own")) for n, v, r, s in trials])

    @F.pandas_udf("array<double>")
    def solved(sums: pd.Series, own: pd.Series, ridge: pd.Series) -> pd.Series:
        def one(s, columns, r):
            m, beta, at = square(np.asarray(s, float)), np.zeros(len(names) + 1), np.append(0, np.asarray(columns, int))
            beta[at] = np.linalg.solve(m[np.ix_(at, at)] + r * np.eye(len(at)), m[at, -1])
            return beta.tolist()

        return pd.Series([one(*x) for x in zip(sums, own, ridge, strict=True)])

    tried = running.filter(F.get("sums", F.lit(0)).isNotNull()).withColumn("t", F.explode(asked)).select("horizon", "unit", "sums", "t.*").filter(F.col("unit") * unit % F.col("retrain") == 0)
    fits = written(tried.select("number", "horizon", (F.col("unit") * unit / F.col("retrain")).cast("int").alias("fit"), solved("sums", "own", "ridge").alias("beta")))
    fits = F.broadcast(fits) if fits.count() <= ex.BROADCAST else fits
    held = rows.filter(F.col("t0") >= start).withColumn("t", F.explode(asked)).withColumns({"number": F.col("t.number"), "fit": F.floor((F.col("t0") - start) / F.col("t.retrain")).cast("int")})
    value = sum((F.col(n) * F.col("beta")[i + 1] for i, n in enumerate(names)), F.col("beta")[0])
    error = value - F.col("y_true")
    scales = metrics.naive_scales(panel, start)  # a row for each region
    each = held.join(fits, ["number", "horizon", "fit"]).groupBy("number", "region").agg(F.avg(error * error).alias("mse")).join(scales, "region")
    scored = each.groupBy("number").agg(F.avg(F.sqrt("mse") / F.nullif("rmse_scale", F.lit(0.0))).alias("value"))
    told = panel.sparkSession.createDataFrame([(n, v, float(r), s) for n, v, r, s in trials], "number int, variant string, ridge double, retrain int")
    place = F.row_number().over(Window.partitionBy("variant").orderBy(F.col("value").asc_nulls_last(), "number"))  # a row for each trial
    return told.join(scored, "number", "left").withColumn("best", place == 1)
