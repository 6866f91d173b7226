"""Rolling, exponentially weighted, lag and lead columns; all share one window by region and step."""

from __future__ import annotations

import math

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

def steps():
    return Window.partitionBy("region").orderBy("t_idx")



def rolling_sum(x: str, n: int, shift: int = 0) -> Column:
    return F.sum(F.coalesce(x, F.lit(0))).over(steps().rowsBetween(-(n - 1) - shift, -shift))


def rolling_mean(x: str, n: int, shift: int = 0) -> Column:
    return F.avg(F.coalesce(x, F.lit(0))).over(steps().rowsBetween(-(n - 1) - shift, -shift))


def alpha_from_halflife(h: float) -> float:
    """Smoothing factor that halves a value's weight after h steps."""
    return 1 - 2 ** (-1 / h)


def retention_from_halflife(h: float) -> float:
    """What remains after one step: the published form."""
    return 2 ** (-1 / h)


def halflife_from_alpha(a: float) -> float:
    return -1 / math.log2(a)


def kept_steps(alpha: float, tolerance: float = 1e-12) -> int:
    """Steps after which weights fall below the tolerance."""
    return max(1, math.ceil(math.log(tolerance) / math.log(1 - alpha)))


def ewm(x: str, alpha: float, adjust: bool = True, shift: int = 0) -> Column:
    """Exponentially weighted mean over the steps whose weight counts.

    adjust: weights (1 - alpha)^i divided by their sum. Otherwise the recurrence
    s = alpha x + (1 - alpha) s from the first value, of which the frame keeps what matters.
    """
    k = kept_steps(alpha)
    held = F.collect_list(F.coalesce(F.col(x).cast("double"), F.lit(0.0))).over(steps().rowsBetween(-(k - 1) - shift, -shift))
    keep = 1 - alpha
    if adjust:
        total = F.aggregate(held, F.lit(0.0), lambda s, v: s * keep + v)
        weights = F.aggregate(held, F.lit(0.0), lambda s, v: s * keep + 1.0)
        return F.when(F.size(held) > 0, total / weights)
    rest = F.slice(held, 2, F.greatest(F.size(held) - 1, F.lit(0)))
    return F.when(F.size(held) > 0, F.aggregate(rest, F.get(held, F.lit(0)), lambda s, v: s * keep + v * alpha))
