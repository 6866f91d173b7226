"""Calibration of probabilities: in the folds of a backtest, out of fold, and by isotonic steps for all keys at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelloom.operators import expanding as ex
from panelloom.operators.learners import joined_once
from panelloom.operators.shared import written

#: Blocks of isotonic fits up to which they are sent to every task; beyond, a window over both finds each row's neighbours.
BLOCKS = 500_000


def logit(prob: str = "y_prob") -> Column:
    p = F.least(F.greatest(F.col(prob), F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.ln(p / (1 - p))


def _ready(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"one": F.lit(1.0), "z": logit(), "active": (F.col("y_true") > 0).cast("double")})


def _passed(model: ex.Glm, fits: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` with the calibrated value; the raw probability passes where a fit saw fewer than two classes."""
    found = ex._applied([model], fits, rows, keys, keep=True)
    total, n = F.col(f"total_{model.name}"), F.col(f"n_{model.name}")
    both = F.coalesce((total > 0) & (total < n), F.lit(False))
    return found.withColumn(model.name, F.when(both, F.col(model.name)).otherwise(F.col("y_prob"))).drop(total, n, "z", "one", "active")


def sigmoid(name: str = "y_sigmoid", steps: int = 12) -> ex.Builder:
    """A builder of calibrators 1 / (1 + exp(-(a + b logit p))) for backtests of forecasts: each refit sees forecasts whose targets were known before it."""
    model = ex.Glm("logistic", ("z",), "active", name=name, ridge=1e-4)

    def build(train: DataFrame, keys: list[str], last: int) -> Callable[[DataFrame], DataFrame]:
        fits = ex.fitted(_ready(train), keys, [model], last + 1, steps=steps)
        return lambda rows: _passed(model, fits, _ready(rows), keys)

    return build


def venn_abers(name: str = "y_venn", grid: int = 10_000) -> ex.Builder:
    """A builder of Venn-Abers calibrators: each score joined once as negative and once as positive to the isotonic fit of what the refit saw; p1 / (1 - p0 + p1).

    Scores lie on a grid, so a fit has a bounded number of rows however long the table. Where a fit saw fewer than two classes the raw probability passes, as with ``sigmoid``.
    """
    score = F.round(F.col("y_prob") * grid) / grid

    def build(train: DataFrame, keys: list[str], last: int) -> Callable[[DataFrame], DataFrame]:
        of = [*keys, "fit"]
        cells = train.groupBy(*keys, "known", score.alias("score")).agg(F.sum((F.col("y_true") > 0).cast("double")).alias("pos"), F.count("*").cast("double").alias("n"))
        cells = cells.withColumn("fit", F.explode(F.sequence("known", F.lit(max(last, 0))))).filter("known <= fit").groupBy(*of, "score").agg(F.sum("pos").alias("pos"), F.sum("n").alias("n"))

        def fit(frame: pd.DataFrame) -> pd.DataFrame:
            known, wanted = frame[frame.n > 0].sort_values("score"), np.sort(frame[frame.n == 0].score.unique())
            p = joined_once(known.score.to_numpy(), known.pos.to_numpy(), known.n.to_numpy(), wanted)
            both = 0 < known.pos.sum() < known.n.sum()
            found = {k: [frame[k].iloc[0]] * len(wanted) for k in of}
            value = p[:, 1] / (1 - p[:, 0] + p[:, 1]) if both else np.full(len(wanted), np.nan)
            return pd.DataFrame({**found, "score": wanted, name: value})

        def apply(rows: DataFrame) -> DataFrame:
            asked = rows.select(*of, score.alias("score")).distinct().withColumns({"pos": F.lit(0.0), "n": F.lit(0.0)})
            kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema.fields if f.name in of)
            fits = cells.unionByName(asked).groupBy(*of).applyInPandas(fit, f"{kinds}, score double, {name} double")
            found = rows.withColumn("score", score).join(fits, [*of, "score"], "left").drop("score")
            return found.withColumn(name, F.coalesce(F.nanvl(name, F.lit(None).cast("double")), F.col("y_prob")))

        return apply

    return build


def in_folds(preds: DataFrame, start: int, keys: tuple[str, ...] = (), retrain: int = 28) -> DataFrame:
    """Forecasts (region, t0, horizon, y_true, y_prob and others) with ``y_sigmoid`` and ``y_venn``: for each regime, horizon and refit a
    calibrator that has only seen forecasts of targets before the refit. ``start`` and ``retrain`` are those of the backtest that made them."""
    found = ex.expanding_backtest(preds, sigmoid(), start, keys, retrain, first=start)
    return ex.expanding_backtest(found, venn_abers(), start, keys, retrain, first=start)


# --- out of fold ---------------------------------------------------------------------------------


def stratified(rows: DataFrame, keys: list[str], label: str, most: int = 5, group: str | None = None) -> DataFrame:
    """``rows`` with ``folds``, their key's number of folds, and ``part``, the fold of each.

    A key has min(most, rows of its rarer class) folds; below two it has none, and both are 0. Rows of a class are dealt in turn: numbers within
    a partition go on from what the partitions before it hold, so a class's counts in two folds differ by one at most and no task
    takes a whole class. With ``group`` its values are dealt instead of rows, by whether any of their rows is positive, so rows of a group stay together.
    """
    positive = (F.col(label) > 0).cast("int")
    if group is not None:
        units = rows.groupBy(*keys, group).agg(F.max(positive).alias("_class"))
    else:
        units = rows.withColumn("_class", positive)
    order = F.xxhash64(*units.columns)
    units = written(units.withColumns({"_at": F.spark_partition_id(), "_order": order}))
    counted = units.groupBy(*keys, "_class", "_at").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*keys, "_class").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = counted.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(F.col("_class") == c, F.col("_n"))), F.lit(0)).alias(f"_n{c}") for c in (0, 1)])
    folds = F.least(F.lit(most), F.least("_n0", "_n1")).cast("int")
    sizes = sizes.select(*keys, F.when(folds >= 2, folds).otherwise(0).alias("folds"))
    offsets = counted.withColumn("_before", before).drop("_n").join(sizes, keys)
    number = F.row_number().over(Window.partitionBy(*keys, "_class", "_at").orderBy("_order")) - 1
    dealt = units.withColumn("_number", number).join(offsets, [*keys, "_class", "_at"])
    part = F.when(F.col("folds") > 0, (F.col("_before") + F.col("_number")) % F.greatest("folds", F.lit(1))).otherwise(0).cast("int")
    dealt = dealt.withColumn("part", part)
    if group is None:
        return dealt.select(*rows.columns, "folds", "part")
    return rows.join(dealt.select(*keys, group, "folds", "part"), [*keys, group])


def out_of_fold(rows: DataFrame, keys: list[str], most: int = 5, group: str | None = None, steps: int = 12) -> DataFrame:
    """``rows`` with folds, part and ``y_cal``: each calibrated by the fit on its key's other folds, or on all of the key where it has no folds.

    All keys' and folds' fits take each Newton step in one job.
    """
    dealt = written(stratified(_ready(rows), keys, "y_true", most, group))
    model = ex.Glm("logistic", ("z",), "active", name="y_cal", ridge=1e-4)
    sees = "(folds > 0 AND fit < folds AND part <> fit) OR (folds = 0 AND fit = 0)"
    fits = ex.fitted(dealt, keys, [model], most, ("folds", "part"), sees, steps)
    return _passed(model, fits, dealt.withColumn("fit", F.col("part")), keys).drop("fit")


# --- isotonic ------------------------------------------------------------------------------------


def pooled_blocks(blocks) -> list[list[float]]:
    """Neighbouring blocks (low, high, positives, rows) pooled until the shares rise; blocks that are pooled already may be pooled further."""
    held: list[list[float]] = []
    for low, high, pos, n in blocks:
        held.append([low, high, pos, n])
        while len(held) > 1 and held[-2][2] * held[-1][3] >= held[-1][2] * held[-2][3]:
            _, high, pos, n = held.pop()
            held[-1] = [held[-1][0], high, held[-1][2] + pos, held[-1][3] + n]
    return held


def isotonic(rows: DataFrame, keys: list[str], prob: str = "y_prob", true: str = "y_true") -> DataFrame:
    """(keys, low, high, value): the rising steps of each key, from the first to the last score of each.

    Tasks add up equal scores; one exchange deals them by ranges of key and score, so that a large key lies in many partitions
    and equal scores in one. Each partition pools its own violators, and what it has left, the corners of a convex hull, is pooled again by
    key. Steps of 0 and 1 labels have different fractions as values, so there are at most about 3 n^(2/3) of them for n rows.
    """
    spark = rows.sparkSession
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", low double, high double, pos double, n double"

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield frame.groupby([*keys, "low", "high"], as_index=False, dropna=False)[["pos", "n"]].sum()

    def pooled(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = [f for f in frames if len(f)]
        if not cells:
            return
        held = pd.concat(cells, ignore_index=True).groupby([*keys, "low"], as_index=False, dropna=False).agg({"high": "max", "pos": "sum", "n": "sum"})
        for _, own in held.sort_values([*keys, "low"]).groupby(keys, dropna=False):
            yield frame_of(own)

    def frame_of(own: pd.DataFrame) -> pd.DataFrame:
        found = pooled_blocks(zip(*(own[c].to_numpy() for c in ("low", "high", "pos", "n")), strict=True))
        return pd.DataFrame([(*[own[k].iloc[0] for k in keys], *b) for b in found], columns=[*keys, "low", "high", "pos", "n"])

    cells = rows.filter(F.col(prob).isNotNull()).select(*keys, F.col(prob).alias("low"), F.col(prob).alias("high"), (F.col(true) > 0).cast("double").alias("pos"), F.lit(1.0).alias("n"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    local = cells.mapInPandas(added, schema).repartitionByRange(parts, *keys, "low").mapInPandas(pooled, schema)
    whole = local.groupBy(*keys).applyInPandas(lambda own: frame_of(own.sort_values("low")), schema)
    return written(whole.select(*keys, "low", "high", (F.col("pos") / F.col("n")).alias("value")))


def stepped(rows: DataFrame, steps: DataFrame, keys: list[str], prob: str = "y_prob", name: str = "y_cal") -> DataFrame:
    """``rows`` with the value of their score: that of its step, linear between two steps, clipped outside; the raw score where the key has no steps."""
    between = lambda x, x0, y0, x1, y1: F.when(x0.isNull(), y1).when(x1.isNull() | (x1 <= x0), y0).otherwise(y0 + (y1 - y0) * (x - x0) / (x1 - x0))
    if steps.count() <= BLOCKS:
        arrays = steps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("low", "high", "value"))).alias("s"))
        arrays = arrays.select(*keys, *[F.col(f"s.{c}").alias(f"_{c}") for c in ("low", "high", "value")])

        @F.pandas_udf("double")
        def valued(score: pd.Series, low: pd.Series, high: pd.Series, value: pd.Series) -> pd.Series:
            out, seen = np.full(len(score), np.nan), {}
            for i, (x, a, b, v) in enumerate(zip(score, low, high, value, strict=True)):
                if a is None or x is None or np.isnan(x):
                    continue
                known = seen.get(a.tobytes())
                if known is None:
                    known = seen[a.tobytes()] = (np.column_stack([a, b]).ravel().astype(float), np.repeat(np.asarray(v, float), 2))
                out[i] = np.interp(x, *known)
            return pd.Series(out)

        found = rows.join(F.broadcast(arrays), keys, "left").withColumn(name, valued(F.col(prob), "_low", "_high", "_value"))
        return found.withColumn(name, F.coalesce(F.nanvl(name, F.lit(None).cast("double")), F.col(prob))).drop("_low", "_high", "_value")
    # Corners and rows in the order of their scores: each row lies between the last corner before it and the first after it.
    corner = steps.select(*keys, F.explode(F.array(*[F.struct(F.col(c).alias("_x"), F.col("value").alias("_v")) for c in ("low", "high")])).alias("c")).select(*keys, "c._x", "c._v", F.lit(None).cast(rows.select(F.struct(*rows.columns).alias("r")).schema["r"].dataType).alias("_row"))
    both = corner.unionByName(rows.select(*keys, F.col(prob).alias("_x"), F.lit(None).cast("double").alias("_v"), F.struct(*rows.columns).alias("_row")))
    point = F.when(F.col("_v").isNotNull(), F.struct("_x", "_v"))
    order = Window.partitionBy(*keys).orderBy("_x")
    left = F.last(point, ignorenulls=True).over(order.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    right = F.first(point, ignorenulls=True).over(order.rangeBetween(Window.currentRow, Window.unboundedFollowing))
    placed = both.withColumns({"_left": left, "_right": right}).filter("_row IS NOT NULL")
    value = between(F.col("_x"), F.col("_left._x"), F.col("_left._v"), F.col("_right._x"), F.col("_right._v"))
    return placed.select(*[F.col(f"_row.`{c}`").alias(c) for c in rows.columns], F.coalesce(value, F.col("_x")).alias(name))
