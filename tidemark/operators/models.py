"""Baselines, naive Bayes and metrics as window and group aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.columns import log_loss, sigmoid
from ..plans.frames import Names, ordered, over, prior


def mean_regressor(y: Column, keys: Names, order: Names, initial: float = 0.0) -> Column:
    return F.coalesce(F.avg(y).over(prior(keys, order)), F.lit(float(initial)))


def last_value_regressor(y: Column, keys: Names, order: Names, initial: float = 0.0) -> Column:
    return F.coalesce(F.lag(y).over(ordered(keys, order)), F.lit(float(initial)))


def _posterior(n1: Column, n0: Column, s1: Column, s0: Column) -> Column:
    """Probability of the positive class from two log densities and counts; 0.5 for no rows, 0 or 1 for one class."""
    z = F.ln(F.when(n1 > 0, n1)) + s1 - F.ln(F.when(n0 > 0, n0)) - s0
    return F.when(n1 + n0 == 0, 0.5).when(n1 == 0, 0.0).when(n0 == 0, 1.0).otherwise(sigmoid(z))


def gaussian_nb(xs: Sequence[Column], y: Column, frame: WindowSpec | None) -> Column:
    """xs of the row against what the frame has seen of each class; a variance of 0 adds nothing."""

    def density(of: Column) -> Column:
        total = F.lit(0.0)
        for x in xs:
            m, v = over(F.avg(F.when(of, x)), frame), over(F.var_pop(F.when(of, x)), frame)
            d = -0.5 * F.ln(2 * 3.141592653589793 * F.when(v > 0, v)) - (x - m) * (x - m) / (2 * F.when(v > 0, v))
            total = total + F.coalesce(d, F.lit(0.0))
        return total

    n1, n0 = (F.coalesce(over(F.sum(F.when(c, 1)), frame), F.lit(0)) for c in (y, ~y))
    return _posterior(n1, n0, density(y), density(~y))


def bernoulli_nb(xs: Sequence[Column], y: Column, frame: WindowSpec | None, alpha: float = 1.0) -> Column:
    """Learns from x > 0.5, scores with x itself."""
    n1, n0 = (F.coalesce(over(F.sum(F.when(c, 1)), frame), F.lit(0)) for c in (y, ~y))

    def density(of: Column, n: Column) -> Column:
        total = F.lit(0.0)
        for x in xs:
            p = (F.coalesce(over(F.sum(F.when(of & (x > 0.5), 1)), frame), F.lit(0)) + alpha) / (n + 2 * alpha)
            total = total + x * F.ln(p) + (1 - x) * F.ln(1 - p)
        return total

    return _posterior(n1, n0, density(y, n1), density(~y, n0))


def multinomial_nb(xs: Sequence[Column], y: Column, frame: WindowSpec | None, alpha: float = 1.0) -> Column:
    n1, n0 = (F.coalesce(over(F.sum(F.when(c, 1)), frame), F.lit(0)) for c in (y, ~y))

    def density(of: Column) -> Column:
        sums = [F.coalesce(over(F.sum(F.when(of, x)), frame), F.lit(0.0)) for x in xs]
        whole = sum(sums[1:], sums[0])
        parts = [x * F.ln((s + alpha) / (whole + alpha * len(xs))) for x, s in zip(xs, sums)]
        return sum(parts[1:], parts[0])

    return _posterior(n1, n0, density(y), density(~y))


def mae(t: Column, p: Column, frame: WindowSpec | None = None) -> Column:
    return over(F.avg(F.abs(t - p)), frame)


def mse(t: Column, p: Column, frame: WindowSpec | None = None) -> Column:
    return over(F.avg((t - p) * (t - p)), frame)


def rmse(t: Column, p: Column, frame: WindowSpec | None = None) -> Column:
    return F.sqrt(mse(t, p, frame))


def r2(t: Column, p: Column, frame: WindowSpec | None = None) -> Column:
    n, v = over(F.count(t), frame), over(F.var_pop(t), frame)
    return F.when((n >= 2) & (v > 0), 1 - over(F.sum((t - p) * (t - p)), frame) / (v * n))


def accuracy(t: Column, p: Column, frame: WindowSpec | None = None) -> Column:
    return over(F.avg((t == p).cast("double")), frame)


def _share(top: Column, bottom: Column, frame: WindowSpec | None) -> Column:
    return over(F.sum(top.cast("double")), frame) / F.nullif(over(F.sum(bottom.cast("double")), frame), F.lit(0.0))


def precision(t: Column, p: Column, frame: WindowSpec | None = None) -> Column:
    return _share(t & p, p, frame)


def recall(t: Column, p: Column, frame: WindowSpec | None = None) -> Column:
    return _share(t & p, t, frame)


def f1(t: Column, p: Column, frame: WindowSpec | None = None) -> Column:
    return _share((t & p).cast("int") * 2, t.cast("int") + p.cast("int"), frame)


def mean_log_loss(t: Column, p: Column, frame: WindowSpec | None = None) -> Column:
    return over(F.avg(log_loss(F.when((p >= 0) & (p <= 1), p), t)), frame)
