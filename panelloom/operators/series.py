"""Series by themselves: stationarity with augmented lags, and autoregression that differences where a key needs it.

Everything a key's regressions need is in one matrix of products of its current and lagged values. Tasks add those up for the
rows they have, keys that lie in several tasks are summed in a shuffle, and the regressions of any lag or difference are read off the sums.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators.shared import written

#: Cuts at 5 %: Dickey-Fuller with a constant, and KPSS about a level.
DF_CUT, KPSS_CUT = -2.86, 0.463
#: Most lags that a screen tries, however long the series.
MOST_LAGS = 40


def lag_limit(n: Column) -> Column:
    """The usual longest lag for n steps, and no more than leave some rows over."""
    return F.least(F.floor(12 * F.pow(n / 100.0, F.lit(0.25))), F.floor(n / 2) - 3, F.lit(float(MOST_LAGS))).cast("int")


def products(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, n, and ``sums``: the upper triangle of the sum of products of the arrays in ``vector``, row by row; summed in tasks first.

    Arrays of one key are of one length.
    """
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, own in frame.groupby(keys, dropna=False, sort=False):
                x = np.stack(own[vector].to_numpy())
                out.append((*(key if isinstance(key, tuple) else (key,)), len(own), (x.T @ x)[np.triu_indices(x.shape[1])]))
            yield pd.DataFrame(out, columns=[*keys, "n", "sums"])

    parts = rows.select(*keys, vector).mapInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", n long, sums array<double>")
    each = parts.select(*keys, "n", F.posexplode("sums").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return each.groupBy(*keys).agg(F.first("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("sums"))


def square(sums: np.ndarray) -> np.ndarray:
    """The symmetric matrix of an upper triangle."""
    size = int((np.sqrt(8 * len(sums) + 1) - 1) / 2)
    m = np.zeros((size, size))
    m[np.triu_indices(size)] = sums
    return m + m.T - np.diag(m.diagonal())


def least_squares(m: np.ndarray, design: list[int] | np.ndarray, target: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Coefficients of ``target`` on ``design``, the rest's sum of squares, and the inverse of the design's products, from products m."""
    xx, xy, yy = m[np.ix_(design, design)], m[design, target], m[target, target]
    scale = 1 / np.sqrt(np.maximum(xx.diagonal(), 1e-300))
    inverse = np.linalg.pinv(xx * scale[:, None] * scale, rcond=1e-11, hermitian=True) * scale[:, None] * scale
    beta = inverse @ xy
    left = float(yy - 2 * beta @ xy + beta @ xx @ beta)
    return beta, max(left, 0.0), inverse


def dickey_fuller(m: np.ndarray, n: int, most: int) -> tuple[float | None, int, bool]:
    """(t, lags, falls back) from products of (1, x, lagged differences 1 .. most, difference), of n rows.

    Lags are those of the least Akaike criterion, fewest first. Where a regression is exact there is no t; then the series falls
    back if the coefficient of its level is below 0.
    """
    target, best = m.shape[0] - 1, None
    spread = m[target, target] - m[0, target] ** 2 / n if n else 0.0
    for lags in range(most + 1):
        k = 2 + lags
        if n <= k + 1:
            break
        beta, left, inverse = least_squares(m, list(range(k)), target)
        if left <= 1e-10 * max(spread, 1e-300) or spread <= 0:
            return None, lags, bool(beta[1] < -1e-6)
        score = n * np.log(left / n) + 2 * k
        if best is None or score < best[0] - 1e-9:
            error = left / (n - k) * inverse[1, 1]
            best = (score, lags, beta[1] / np.sqrt(error) if error > 0 else None)
    if best is None or best[2] is None:
        return None, 0, False
    return float(best[2]), best[1], bool(best[2] < DF_CUT)


def _both(panel: DataFrame) -> DataFrame:
    """(region, differenced, t_idx, y) of the series and of their differences."""
    w = Window.partitionBy("region").orderBy("t_idx")
    raw = panel.select("region", F.lit(False).alias("differenced"), "t_idx", F.col("y").cast("double").alias("y"))
    steps = panel.select("region", F.lit(True).alias("differenced"), "t_idx", (F.col("y") - F.lag("y").over(w)).cast("double").alias("y")).filter("y IS NOT NULL")
    return raw.unionByName(steps)


def _augmented(held: DataFrame, keys: list[str]) -> DataFrame:
    """keys, df_t, lags, falls: Dickey-Fuller with a constant, and with the lagged differences that the Akaike criterion asks for."""
    order = Window.partitionBy(*keys).orderBy("t_idx")
    rows = held.withColumns({"x": F.lag("y").over(order), "at": F.row_number().over(order)}).withColumn("dy", F.col("y") - F.col("x"))
    # All of a key's candidates see the same rows: those that have the longest lag.
    before = F.reverse(F.collect_list("dy").over(order.rowsBetween(-MOST_LAGS, -1)))
    rows = rows.withColumn("before", before).filter((F.col("at") > F.col("most") + 1) & F.col("dy").isNotNull())
    vector = F.concat(F.array(F.lit(1.0), "x"), F.slice("before", F.lit(1), F.col("most")), F.array("dy"))
    sums = products(rows.select(*keys, vector.alias("vector")), keys, "vector").join(held.select(*keys, "most").distinct(), keys)

    @F.pandas_udf("df_t double, lags int, falls boolean")
    def tested(sums: pd.Series, n: pd.Series, most: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([dickey_fuller(square(np.asarray(s, float)), int(k), int(m)) for s, k, m in zip(sums, n, most, strict=True)], columns=["df_t", "lags", "falls"]).astype({"df_t": "float64"})

    return sums.withColumn("t", tested("sums", "n", "most")).select(*keys, F.nanvl("t.df_t", F.lit(None).cast("double")).alias("df_t"), "t.lags", "t.falls")


def stationarity(panel: DataFrame) -> DataFrame:
    """(region, differenced, df_t, lags, kpss, stationary) of each series and of its differences.

    Dickey-Fuller with augmented lags, cut -2.86; KPSS about a level, cut 0.463, with Bartlett weights up to a lag chosen from
    the autocovariances (Hobijn). Stationary is what the first takes for it and the second doesn't reject. Constant series are, without figures. A
    series that its own past explains exactly has no df_t and counts as the sign of its level's coefficient tells. Where the long-run variance is 0
    there is no kpss, which rejects nothing. Of fewer than eight steps nothing is said: not stationary, unless constant.
    """
    keys = ["region", "differenced"]
    ordered, whole = Window.partitionBy(*keys).orderBy("t_idx"), Window.partitionBy(*keys)
    # Each key's own range of steps; sums over it are not kept with the rows of other keys.
    e = written(_both(panel).withColumn("n", F.count("*").over(whole)).withColumn("e", F.col("y") - F.avg("y").over(whole)).withColumn("s", F.sum("e").over(ordered)))
    one = e.groupBy(*keys).agg(F.first("n").alias("n"), (F.min("y") == F.max("y")).alias("constant"), F.sum(F.col("e") * F.col("e")).alias("g0"), F.sum(F.col("s") * F.col("s")).alias("eta"))
    one = written(one)
    varied = one.filter("NOT constant AND n >= 8")

    def covariances(most: DataFrame) -> DataFrame:
        """Autocovariance sums of the lags 1 to ``most``, a column of the key."""
        left = e.join(most, keys).select(*keys, "t_idx", "e", F.explode(F.expr("sequence(1, most)")).alias("lag")).withColumn("t_idx", F.col("t_idx") + F.col("lag"))
        return left.join(e.select(*keys, "t_idx", F.col("e").alias("later")), [*keys, "t_idx"]).groupBy(*keys, "lag").agg(F.sum(F.col("e") * F.col("later")).alias("g"))

    few = varied.select(*keys, F.greatest(F.floor(F.pow("n", F.lit(2 / 9))), F.lit(1)).cast("int").alias("most"))
    moved = covariances(few).groupBy(*keys).agg(F.sum("g").alias("a"), F.sum(F.col("lag") * F.col("g")).alias("b"))
    spread = F.col("g0") + 2 * F.col("a")
    ratio = F.when(F.abs(spread) > 1e-12 * F.col("g0"), 2 * F.col("b") / F.nullif(spread, F.lit(0.0)))
    lags = F.least(F.coalesce(F.floor(1.1447 * F.pow(ratio * ratio, F.lit(1 / 3)) * F.pow("n", F.lit(1 / 3))), F.lit(0)), F.col("n") - 1).cast("int")
    chosen = varied.join(moved, keys).select(*keys, lags.alias("most"))
    weighed = covariances(chosen.filter("most > 0")).join(chosen, keys).groupBy(*keys).agg(F.sum((1 - F.col("lag") / (F.col("most") + 1)) * F.col("g")).alias("tail"))
    long_run = F.col("g0") + 2 * F.coalesce("tail", F.lit(0.0))
    kpss = F.when(~F.col("constant") & (F.col("n") >= 8) & (long_run > 1e-12 * F.col("g0")), F.col("eta") / F.col("n") / F.nullif(long_run, F.lit(0.0)))
    tested = _augmented(e.join(varied.select(*keys, lag_limit(F.col("n")).alias("most")), keys).select(*keys, "t_idx", "y", "most"), keys)
    found = one.join(weighed, keys, "left").withColumn("kpss", kpss).join(tested, keys, "left")
    stationary = F.col("constant") | F.coalesce(F.col("falls") & F.coalesce(F.col("kpss") < KPSS_CUT, F.lit(True)), F.lit(False))
    return found.select(*keys, "df_t", "lags", "kpss", stationary.alias("stationary"))


# --- autoregression ------------------------------------------------------------------------------


def _designs(order: int) -> dict[str, np.ndarray]:
    """How the regressions' columns are made of (1, y_{t-1}, .. y_{t-order-1}, y_t); the last column of each is the target."""
    size = order + 3
    y = lambda i: np.eye(size)[size - 1 if i == 0 else i]
    d = lambda i: y(i) - y(i + 1)
    one = np.eye(size)[0]
    return {
        "level": np.column_stack([one, *(y(i) for i in range(1, order + 1)), y(0)]),
        "step": np.column_stack([one, *(d(i) for i in range(1, order + 1)), d(0)]),
        "test": np.column_stack([one, y(1), *(d(i) for i in range(1, order)), d(0)]),
    }


def fit_from(m: np.ndarray, n: int, order: int, ridge: float) -> tuple[int, np.ndarray | None]:
    """Order of differencing and coefficients from products m of n rows; None without more rows than twice the coefficients."""
    if n <= 2 * (order + 2):
        return 0, None
    designs = _designs(order)
    test = designs["test"].T @ m @ designs["test"]
    still = test[-1, -1] - test[0, -1] ** 2 / n <= 0  # no difference ever: a constant
    d = 0 if still or dickey_fuller(test, n, order - 1)[2] else 1
    own = designs["step" if d else "level"]
    own = own.T @ m @ own
    return d, np.linalg.solve(own[:-1, :-1] + ridge * np.eye(order + 1), own[:-1, -1])


def forecasts(past: np.ndarray, d: int, beta: np.ndarray, horizon: int) -> list[float]:
    """The next values after ``past`` (the latest first), by recursion; differences are added up from the last value on."""
    order = len(beta) - 1
    held = list(past[:order] if d == 0 else past[:order] - past[1 : order + 1])
    out, anchor = [], float(past[0])
    for _ in range(horizon):
        value = float(beta[0] + np.dot(beta[1:], held[:order]))
        held.insert(0, value)
        anchor = anchor + value if d else value
        out.append(anchor)
    return out


def autoregressive_backtest(panel: DataFrame, start: int, order: int = 7, retrain: int = 28, horizon: int = 7, stride: int = 1, ridge: float = 1e-6) -> DataFrame:
    """(region, t0, horizon, d, y_true, y_pred) for each t0 from ``start`` on and the ``horizon`` steps from it.

    For each key and refit the order of differencing is chosen by the augmented Dickey-Fuller test and the coefficients by least squares, both on
    all steps before the refit, from running sums of one matrix of products. Between refits they are frozen and the values they are
    applied to go on. Until a key has enough steps its forecast is null.
    """
    w = Window.partitionBy("region").orderBy("t_idx")
    past = F.array(*[F.lag("y", i).over(w).cast("double") for i in range(1, order + 2)])
    truth = F.array(*[F.lead("y", h).over(w) for h in range(horizon)])
    rows = written(panel.select("region", "t_idx", F.col("y").cast("double").alias("y"), past.alias("past"), truth.alias("truth")))
    whole = rows.filter(F.get("past", F.lit(order)).isNotNull())
    last = rows.agg(F.max("t_idx")).first()[0]
    last = -1 if last is None or last < start else (last - start) // retrain
    known = F.greatest(F.floor((F.col("t_idx") - start) / retrain) + 1, F.lit(0)).cast("int")
    vector = F.concat(F.array(F.lit(1.0)), "past", F.array("y"))
    parts = products(whole.withColumn("fit", known).filter(F.col("fit") <= last).select("region", "fit", vector.alias("vector")), ["region", "fit"], "vector")
    # Every refit has a row, whether or not there are new rows before it.
    size = order + 3
    grid = parts.select("region").distinct().select("region", F.explode(F.sequence(F.lit(0), F.lit(max(last, 0)))).alias("fit"))
    up = Window.partitionBy("region").orderBy("fit")
    cells = size * (size + 1) // 2
    running = grid.join(parts, ["region", "fit"], "left").select("region", "fit", F.sum("n").over(up).alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))).over(up) for i in range(cells)]).alias("sums"))

    @F.pandas_udf("d int, beta array<double>")
    def solved(n: pd.Series, sums: pd.Series) -> pd.DataFrame:
        found = [fit_from(square(np.asarray(s, float)), int(k), order, ridge) if k == k and k is not None else (0, None) for k, s in zip(n, sums, strict=True)]
        return pd.DataFrame({"d": [d for d, _ in found], "beta": [None if b is None else b.tolist() for _, b in found]})

    @F.pandas_udf("array<double>")
    def ahead(past: pd.Series, d: pd.Series, beta: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or p is None or any(v is None or v != v for v in p) else forecasts(np.asarray(p, float), int(k), np.asarray(b, float), horizon) for p, k, b in zip(past, d, beta, strict=True)], dtype=object)

    fits = written(running.withColumn("f", solved("n", "sums")).select("region", "fit", "f.d", "f.beta"))
    asked = rows.filter((F.col("t_idx") >= start) & ((F.col("t_idx") - start) % stride == 0)).withColumn("fit", F.floor((F.col("t_idx") - start) / retrain).cast("int"))
    made = asked.join(fits, ["region", "fit"], "left").withColumn("f", ahead("past", "d", "beta"))
    each = F.posexplode(F.transform("truth", lambda y, i: F.struct(y.alias("y_true"), F.get("f", i).alias("y_pred"))))
    return made.select("region", F.col("t_idx").alias("t0"), "d", each.alias("i", "v")).filter("v.y_true IS NOT NULL").select("region", "t0", (F.col("i") + 1).alias("horizon"), "d", "v.y_true", "v.y_pred")
