"""Expanding-window backtests that take the model as an argument.

The rows of a backtest hold one forecast each: made at ``t0`` for the step ``t0 + horizon - 1``, from lags before t0 and
from covariates of the target step that are known ahead. A builder gets the training rows of all refits
together, keyed by regime and horizon, each with ``known``, the first refit that may learn from it, and returns a function that adds ``y_pred`` to the rows to
forecast. So a model is fitted for all keys, horizons and refits in the same few grouped sums, and no row is repeated for
the refits: a row meets the coefficients of those that may see it while it is summed up.

Forecasts are rows again: calibrators are builders too, which learn from forecasts whose targets were known before the refit.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from panelloom.operators.shared import written

HORIZONS = (1, 2, 3, 4, 5, 6, 7)
#: Known before the forecast, and known ahead of the step that it is for.
PAST, AHEAD = ("lag_1", "lag_7", "mean_28"), ("is_weekend", "year_sin", "year_cos")
#: Sets of coefficients up to which they are sent to every task; beyond, the rows are dealt by key.
BROADCAST = 100_000
Builder = Callable[[DataFrame, list[str], int], Callable[[DataFrame], DataFrame]]


def direct_rows(panel: DataFrame, horizons: tuple[int, ...] = HORIZONS, carry: tuple[str, ...] = (), labels: tuple[str, ...] = ()) -> DataFrame:
    """One row for each region, t0 and horizon whose target step exists, by one window over the panel.

    ``y_week``: the latest value a whole number of weeks before the target that is known at t0. ``carry`` names columns of t0 to keep, ``labels``
    columns whose values at the target step are kept.
    """
    w = Window.partitionBy("region").orderBy("t_idx")
    day = 2 * np.pi * F.dayofyear("event_date") / 365.25
    known = panel.select(
        "region", *carry, F.col("t_idx").alias("t0"), "y", *labels, "t_idx", "event_date",
        F.lag("y", 1).over(w).cast("double").alias("lag_1"), F.lag("y", 7).over(w).cast("double").alias("lag_7"), F.avg("y").over(w.rowsBetween(-28, -1)).alias("mean_28"),
        (F.weekday("event_date") >= 5).cast("double").alias("is_weekend"), F.sin(day).alias("year_sin"), F.cos(day).alias("year_cos"),
    )
    step = lambda h: F.struct(
        F.lit(h).alias("horizon"),
        F.lead("y", h - 1).over(w).alias("y_true"),
        F.lag("y", 7 * -(-h // 7) - h + 1).over(w).cast("double").alias("y_week"),
        *[F.lead(c, h - 1).over(w).alias(c) for c in (*AHEAD, *labels)],
    )
    rows = known.withColumn("steps", F.array(*map(step, horizons))).withColumn("s", F.explode("steps")).filter("s.y_true IS NOT NULL")
    return rows.select("region", *carry, "t0", *PAST, "s.*", F.lit(1.0).alias("one"), (F.col("s.y_true") > 0).cast("double").alias("active"))


def expanding_backtest(rows: DataFrame, builder: Builder, start: int, keys: tuple[str, ...] = (), retrain: int = 28, stride: int = 1, first: int = 28) -> DataFrame:
    """(region, t0, horizon, y_true, y_pred, what else the builder adds) for every ``stride``-th t0 from ``start`` on.

    The model of refit k learns from targets before ``start + k * retrain`` and forecasts the t0 from there to the next refit: its coefficients are
    frozen while the lags it is applied to go on. Rows before ``first``, whose lags aren't filled, are not learned from.
    """
    # Dealt to all cores once: the rows are read by every step, and a panel's own partitions may be few.
    rows = written(rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    asked, last = _asked(rows, start, retrain, stride)
    known = F.greatest(F.floor((F.col("t0") + F.col("horizon") - 1 - start) / retrain) + 1, F.lit(0)).cast("int")
    train = rows.filter(F.col("t0") >= first).withColumn("known", known).filter(F.col("known") <= last)
    return builder(train, [*keys, "horizon"], last)(asked).drop(*PAST, *AHEAD, "one", "active", "fit", "y_week")


def _asked(rows: DataFrame, start: int, retrain: int, stride: int) -> tuple[DataFrame, int]:
    """The rows to forecast with the number of their refit, and the last of those; -1 if there are none."""
    fits = F.floor((F.col("t0") - start) / retrain).cast("int")
    asked = rows.filter((F.col("t0") >= start) & ((F.col("t0") - start) % stride == 0)).withColumn("fit", fits)
    last = asked.agg(F.max("fit")).first()[0]  # one number
    return asked, -1 if last is None else last


def weekly_naive(train: DataFrame, keys: list[str], last: int) -> Callable[[DataFrame], DataFrame]:
    """The value a week before the target; nothing to learn."""
    return lambda rows: rows.withColumn("y_pred", F.col("y_week"))


@dataclass(frozen=True)
class Glm:
    """A generalised linear model: gaussian, logistic, poisson or tweedie (power 1.5, log link). ``where`` picks the rows it learns from."""

    family: str = "gaussian"
    features: tuple[str, ...] = (*PAST, *AHEAD)
    label: str = "y_true"
    where: str | None = None
    name: str = "y_pred"
    ridge: float = 1e-3

    def __post_init__(self):
        if self.family not in ("gaussian", "logistic", "poisson", "tweedie"):
            raise ValueError(f"unknown family {self.family}")

    @property
    def names(self) -> tuple[str, ...]:
        return ("one", *self.features)

    @property
    def beta(self) -> str:
        return f"beta_{self.name}"

    def mean(self) -> Column:
        """The forecast of a row that holds the coefficients."""
        eta = F.greatest(F.least(sum((F.col(f) * F.col(self.beta)[i] for i, f in enumerate(self.names)), F.lit(0.0)), F.lit(30.0)), F.lit(-30.0))
        return {"gaussian": eta, "logistic": 1 / (1 + F.exp(-eta))}.get(self.family, F.exp(eta))

    def products(self, x: np.ndarray, y: np.ndarray, seen: np.ndarray, betas: np.ndarray) -> np.ndarray:
        """For each fit, over the rows it sees: sums of weighted products of features, then of features and what the labels differ by."""
        eta = np.clip(x @ np.nan_to_num(betas).T, -30, 30)
        if self.family == "gaussian":
            weigh, pull = np.ones_like(eta), y[:, None] - eta
        elif self.family == "logistic":
            mu = 1 / (1 + np.exp(-eta))
            weigh, pull = mu * (1 - mu), y[:, None] - mu
        else:
            mu = np.exp(eta)
            root = np.sqrt(mu) if self.family == "tweedie" else 1.0
            weigh, pull = mu / root, (y[:, None] - mu) / root
        a, b = np.triu_indices(x.shape[1])
        return np.hstack([(weigh * seen).T @ (x[:, a] * x[:, b]), (pull * seen).T @ x])

    def begin(self, total: Column, n: Column) -> Column:
        """The constant to begin with, of labels' total and number; null without any."""
        mean = total / F.nullif(n, F.lit(0.0))
        if self.family == "gaussian":
            return F.when(n > 0, F.lit(0.0))
        floor = F.greatest(mean, F.lit(1e-3))
        p = F.least(floor, F.lit(1 - 1e-3))
        return F.when(n > 0, F.ln(p / (1 - p)) if self.family == "logistic" else F.ln(floor))


def fitted(train: DataFrame, keys: list[str], models: list[Glm], fits: int | None = None, by: tuple[str, ...] = ("known",), sees: str = "known <= fit", steps: int = 8) -> DataFrame:
    """keys, and for each model its coefficients (``beta_`` and its name; null without rows), the total of its labels and their number
    (``total_``, ``n_``). All models take each Newton step together, in one job that sums products by key, which tasks combine before the shuffle:
    as matrix products in the tasks while the coefficients are few enough to be sent to all of them, beyond that by a join. Gaussian models alone take
    one step from 0, whose sums are added up over the fits after the rows have been grouped.

    With ``fits`` there are that many fits of each key, numbered in ``fit``; ``sees`` tells which fits see a row, by its columns ``by``.
    """
    seen = {m.name: F.coalesce(F.expr(m.where), F.lit(False)).cast("double") if m.where else F.lit(1.0) for m in models}
    of = [*keys, *["fit"] * (fits is not None)]
    small = train.groupBy(*keys, *(by if fits is not None else ())).agg(*[x.alias(c) for m in models for x, c in ((F.sum(F.col(m.label) * seen[m.name]), f"total_{m.name}"), (F.sum(seen[m.name]), f"n_{m.name}"))])
    if fits is not None:
        axis = F.explode(F.sequence(F.lit(0), F.lit(fits - 1))) if fits > 0 else F.explode(F.array().cast("array<int>"))
        small = small.withColumn("fit", axis).filter(sees)
    small = small.groupBy(*of).agg(*[F.sum(c).alias(c) for m in models for c in (f"total_{m.name}", f"n_{m.name}")])
    first = {m.beta: m.begin(F.col(f"total_{m.name}"), F.col(f"n_{m.name}")) for m in models}
    state = written(small.withColumns({m.beta: F.when(first[m.beta].isNotNull(), F.array(first[m.beta], *[F.lit(0.0)] * len(m.features))) for m in models}))
    steps = steps if any(m.family != "gaussian" for m in models) else 1
    few = state.count() <= BROADCAST
    held, by, sight = train, by if fits is not None else (), {}
    if few and steps > 1:  # every step reads the rows; which fits see one is told by its columns ``by``
        columns = list(dict.fromkeys([*keys, *by, *[c for m in models for c in (*m.names, m.label)]]))
        # In the order of the keys, so that a batch holds few of them.
        held = written(train.select(*columns, *[seen[m.name].alias(f"_seen_{m.name}") for m in models]).sortWithinPartitions(*keys))
        if fits:  # a row for each refit from which on rows are known, or for each fold
            sights = held.select(*by).distinct().withColumn("_sees", F.expr(f"transform(sequence(0, {fits - 1}), fit -> coalesce({sees}, false))"))
            sight = {tuple(r[c] for c in by): np.array(r["_sees"], float) for r in sights.collect()}
    for step in range(steps):
        moving = [m for m in models if m.family != "gaussian" or step == 0]
        if few and steps > 1:
            sums = _summed_in_tasks(held, keys, state, moving, fits, by, sight)
        elif steps == 1:
            sums = held.withColumns({f"mu_{m.name}": F.lit(0.0) for m in moving}).groupBy(*keys, *by).agg(*[_products(m, seen[m.name]).alias(f"sums_{m.name}") for m in moving])
            sums = sums.withColumn("fit", axis).filter(sees) if fits is not None else sums
            sums = sums.groupBy(*of).agg(*[_total(m) for m in moving])
        else:
            sent = state.select(*of, *[m.beta for m in moving])
            met = held.join(F.broadcast(sent) if few else sent, keys)
            met = met.filter(sees) if fits is not None else met
            met = met.withColumns({f"mu_{m.name}": m.mean() for m in moving})
            sums = met.groupBy(*of).agg(*[_products(m, seen[m.name]).alias(f"sums_{m.name}") for m in moving])
        state = written(state.join(F.broadcast(sums) if few else sums, of).select(*of, *[c for m in models for c in (f"total_{m.name}", f"n_{m.name}")], *[_moved(m)(m.beta, f"sums_{m.name}").alias(m.beta) if m in moving else m.beta for m in models]))
    return state


def _total(m: Glm) -> Column:
    """The arrays of sums added up, place by place."""
    return F.array(*[F.sum(F.get(f"sums_{m.name}", F.lit(i))) for i in range(len(m.names) * (len(m.names) + 3) // 2)]).alias(f"sums_{m.name}")


def _summed_in_tasks(held: DataFrame, keys: list[str], state: DataFrame, models: list[Glm], fits: int | None, by: tuple[str, ...], sight: dict) -> DataFrame:
    """As the grouped sums of ``_products``: tasks, which all get the coefficients, add up matrix products of the rows they have."""
    of = [*keys, *["fit"] * (fits is not None)]
    known: dict = {}
    for r in state.select(*of, *[m.beta for m in models]).collect():  # BROADCAST rows at most
        own = known.setdefault(tuple(r[k] for k in keys), {m.name: np.full((fits or 1, len(m.names)), np.nan) for m in models})
        for m in models:
            if r[m.beta] is not None:
                own[m.name][r["fit"] if fits is not None else 0] = r[m.beta]
    # Of values that no fit sees, the last row.
    table = np.array([*sight.values(), np.zeros(fits)]) if fits is not None else np.ones((1, 1))
    sent = held.sparkSession.sparkContext.broadcast((known, {v: i for i, v in enumerate(sight)}, table))
    kinds = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "fit int", *(f"sums_{m.name} array<double>" for m in models)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        betas, places, table = sent.value
        sums: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            column = {n: batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in {c for m in models for c in (*m.names, m.label, f"_seen_{m.name}")}}
            frame = pa.Table.from_batches([batch]).select([*keys, *by]).to_pandas()
            place = np.zeros(batch.num_rows, np.int64)
            if by:
                code, values = pd.MultiIndex.from_frame(frame[list(by)]).factorize()
                place = np.array([places.get(v, -1) for v in values])[code]
            for key, at in frame.groupby(keys, sort=False, dropna=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                if key not in betas:
                    continue
                own = sums.setdefault(key, {m.name: np.zeros((table.shape[1], len(m.names) * (len(m.names) + 3) // 2)) for m in models})
                sees = table[place[at]]
                for m in models:
                    own[m.name] += m.products(np.column_stack([column[n][at] for n in m.names]), column[m.label][at], sees * column[f"_seen_{m.name}"][at, None], betas[key][m.name])
        rows = [(key, fit, {n: x[fit] for n, x in own.items()}) for key, own in sums.items() for fit in range(fits or 1)]
        columns = [pa.array([key[i] for key, _, _ in rows], held_types[k]) for i, k in enumerate(keys)]
        columns += [pa.array([fit for _, fit, _ in rows], pa.int32()), *(pa.array([x[m.name] for _, _, x in rows], pa.list_(pa.float64())) for m in models)]
        yield pa.RecordBatch.from_arrays(columns, [*keys, "fit", *(f"sums_{m.name}" for m in models)])

    held_types = {f.name: to_arrow_type(f.dataType) for f in held.schema.fields if f.name in keys}
    parts = held.mapInArrow(run, schema)
    return parts.groupBy(*of).agg(*[_total(m) for m in models])


def _products(m: Glm, seen: Column) -> Column:
    """Sums of weighted products of features, then of features and what the labels differ by."""
    y, mu = F.col(m.label).cast("double"), F.col(f"mu_{m.name}")
    weigh, pull = {
        "gaussian": (F.lit(1.0), y - mu),
        "logistic": (mu * (1 - mu), y - mu),
        "poisson": (mu, y - mu),
        "tweedie": (F.sqrt(mu), (y - mu) / F.sqrt(mu)),
    }[m.family]
    weigh, pull = weigh * seen, pull * seen
    return F.array(*[F.sum(weigh * F.col(a) * F.col(b)) for a, b in combinations_with_replacement(m.names, 2)], *[F.sum(pull * F.col(a)) for a in m.names])


def _moved(m: Glm):
    """Coefficients after one Newton step, which is shortened where it is long."""
    size, family, ridge = len(m.names), m.family, m.ridge
    upper = np.triu_indices(size)

    @F.pandas_udf("array<double>")
    def moved(beta: pd.Series, sums: pd.Series) -> pd.Series:
        def one(b, s):
            if b is None or s is None:
                return None
            b, s, xx = np.asarray(b, float), np.asarray(s, float), np.zeros((size, size))
            xx[upper] = s[: len(upper[0])]
            xx = xx + xx.T - np.diag(xx.diagonal())
            step = np.linalg.solve(xx + ridge * np.eye(size), s[len(upper[0]) :] - ridge * b)
            return (b + (step if family == "gaussian" else step / max(1.0, np.abs(step).max() / 4))).tolist()

        return pd.Series([one(b, s) for b, s in zip(beta, sums, strict=True)], dtype=object)

    return moved


def _applied(models: list[Glm], fits: DataFrame, rows: DataFrame, keys: list[str], keep: bool = False) -> DataFrame:
    """``rows`` with the models' forecasts, 0 where there was nothing to learn from."""
    sent = F.broadcast(fits) if fits.count() <= BROADCAST else fits
    found = rows.join(sent, [*keys, "fit"], "left").withColumns({m.name: F.when(F.col(m.beta).isNotNull(), m.mean()).otherwise(F.lit(0.0)) for m in models})
    return found.drop(*[m.beta for m in models], *[c for m in models for c in (f"total_{m.name}", f"n_{m.name}") if not keep])


def glm(family: str = "gaussian", features: tuple[str, ...] = (*PAST, *AHEAD), label: str = "y_true", where: str | None = None, name: str = "y_pred", steps: int = 8, ridge: float = 1e-3) -> Builder:
    """A builder of one generalised linear model. ``where`` picks the training rows. Keys without any get the mean of none: the forecast is 0."""
    models = [Glm(family, features, label, where, name, ridge)]

    def build(train: DataFrame, keys: list[str], last: int) -> Callable[[DataFrame], DataFrame]:
        fits = fitted(train, keys, models, last + 1, steps=steps)
        return lambda rows: _applied(models, fits, rows, keys)

    return build


def hurdle(count: str = "tweedie", features: tuple[str, ...] = (*PAST, *AHEAD), steps: int = 8) -> Builder:
    """P(active) times the count expected where active: two models for the same keys, fitted together; also keeps ``y_prob`` and ``y_count``."""
    models = [Glm("logistic", features, "active", name="y_prob"), Glm(count, features, where="active = 1", name="y_count")]

    def build(train: DataFrame, keys: list[str], last: int) -> Callable[[DataFrame], DataFrame]:
        fits = fitted(train, keys, models, last + 1, steps=steps)
        return lambda rows: _applied(models, fits, rows, keys).withColumn("y_pred", F.col("y_prob") * F.col("y_count"))

    return build


def two_stage(first: str, second: str, features: tuple[str, ...] = (*PAST, *AHEAD), steps: int = 8) -> Builder:
    """P(first) times P(second where first): the second model learns from the rows on which the first happened, and both are kept as ``y_first``, ``y_given``.

    ``first`` and ``second`` are columns of 0 and 1.
    """
    models = [Glm("logistic", features, first, name="y_first"), Glm("logistic", features, second, where=f"{first} = 1", name="y_given")]

    def build(train: DataFrame, keys: list[str], last: int) -> Callable[[DataFrame], DataFrame]:
        fits = fitted(train, keys, models, last + 1, steps=steps)
        return lambda rows: _applied(models, fits, rows, keys).withColumn("y_pred", F.col("y_first") * F.col("y_given"))

    return build
