"""Sampled forecasts of hurdle models: draws by inverse distribution functions, and quantiles of draws that are never kept.

A forecast is 0 with probability 1 - p; else it is one more than a Poisson count (or a geometric one) whose mean makes the
whole's mean, where active, ``y_count``. A draw is the inverse distribution function of that mixture at a uniform number. The function
rises, so the k-th smallest draw is its value at the k-th smallest uniform number: of all draws only the
few that a quantile lies between are turned into values. Uniform numbers are hashes of seed, row and number of the draw, so they are the same twice.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Means beyond which the Poisson count is taken from its normal approximation.
LARGE = 300.0


def uniforms(keys: list[str], draws: int, seed: int) -> Column:
    """``draws`` numbers between 0 and 1 for a row, sorted."""
    number = lambda i: (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys, i), 11) + 0.5) * (2.0**-53)
    return F.array_sort(F.transform(F.sequence(F.lit(1), F.lit(draws)), number))


def poisson_steps(mean: Column) -> Column:
    """The distribution function of a Poisson count at 0, 1, 2 ... up to where it is 1 for all purposes."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 24).cast("int")
    begin = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))

    def add(state, k):
        p = state["p"] * mean / k
        return F.struct(p.alias("p"), F.concat(state["c"], F.array(F.element_at(state["c"], -1) + p)).alias("c"))

    return F.aggregate(F.sequence(F.lit(1), last), begin, add)["c"]


def normal_inverse(u: Column) -> Column:
    """The standard normal's inverse distribution function by the rational approximation of Abramowitz and Stegun, 26.2.23."""
    tail = F.sqrt(-2 * F.ln(F.least(u, 1 - u)))
    value = tail - (2.515517 + 0.802853 * tail + 0.010328 * tail * tail) / (1 + 1.432788 * tail + 0.189269 * tail * tail + 0.001308 * tail * tail * tail)
    return F.when(u < 0.5, -value).otherwise(value)


def drawn(u: Column, prob: Column, count: Column, steps: Column | None) -> Column:
    """The hurdle's inverse distribution function: ``steps`` are those of the Poisson count; None for a geometric one."""
    v = F.least((u - (1 - prob)) / prob, F.lit(1 - 2.0**-53))
    mean = F.greatest(count, F.lit(1.0)) - 1
    if steps is None:
        more = F.when(mean <= 0, F.lit(0.0)).otherwise(F.floor(F.ln(1 - v) / F.ln(mean / (mean + 1))))
    else:
        near = F.greatest(F.floor(mean + F.sqrt(mean) * normal_inverse(v) + 0.5), F.lit(0.0))
        more = F.when(mean > LARGE, near).otherwise(F.size(F.filter(steps, lambda c: c < v)))
    return F.when((prob <= 0) | (u <= 1 - prob), F.lit(0.0)).otherwise(1.0 + more).cast("double")


def sampled(preds: DataFrame, keys: list[str], levels: tuple[float, ...] = (0.1, 0.5, 0.9), draws: int = 200, seed: int = 1, count: str = "poisson") -> DataFrame:
    """``preds`` (with y_prob and y_count) and the quantiles ``y_q10``, ``y_q50`` ... of ``draws`` draws for each row, linear between two draws.

    ``keys`` tell rows apart. A null probability or count gives null quantiles.
    """
    if count not in ("poisson", "geometric"):
        raise ValueError(f"unknown count {count}")
    prob, size = F.col("y_prob"), F.col("y_count")
    mean = F.greatest(size, F.lit(1.0)) - 1
    held = preds.withColumn("_u", uniforms(keys, draws, seed))
    held = held.withColumn("_steps", poisson_steps(F.when(mean > LARGE, F.lit(0.0)).otherwise(mean))) if count == "poisson" else held
    steps = F.col("_steps") if count == "poisson" else None
    at = lambda i: drawn(F.get("_u", F.lit(i)), prob, size, steps)
    found = {}
    for level in levels:
        low = math.floor(level * (draws - 1))
        share = level * (draws - 1) - low
        value = at(low) if share == 0 else at(low) * (1 - share) + at(low + 1) * share
        found[f"y_q{round(level * 100):02d}"] = F.when(prob.isNotNull() & size.isNotNull(), value)
    return held.withColumns(found).drop("_u", "_steps")


def picked(preds: DataFrame, level: float = 0.5, mean: str = "y_pred", name: str = "y_point") -> DataFrame:
    """``name``: the quantile of a level where the table has one, else the mean."""
    column = f"y_q{round(level * 100):02d}"
    return preds.withColumn(name, F.coalesce(column, mean) if column in preds.columns else F.col(mean))
