"""Column expressions without state: finite checks, clamps, losses and their gradients."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INF = float("inf")


def finite(c: Column) -> Column:
    """Neither null, NaN nor infinite: what every operator asks of its numbers."""
    return F.coalesce(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF)), F.lit(False))


def accepted(df: DataFrame, *columns: str, on_error: str = "skip") -> DataFrame:
    """Rows whose columns are finite. on_error: "skip" leaves others out, "fail" raises at the first."""
    good = F.lit(True)
    for c in columns:
        good = good & finite(F.col(c))
    if on_error == "skip":
        return df.filter(good)
    if on_error == "fail":
        return df.filter(F.when(good, True).otherwise(F.raise_error(F.lit(f"not finite: {', '.join(columns)}")).cast("boolean")))
    raise ValueError("on_error is skip or fail")


def rejected(df: DataFrame, *columns: str) -> DataFrame:
    """The rows that accepted() leaves out, with the reason."""
    kind = F.lit(None).cast("string")
    for c in reversed(columns):
        x = F.col(c)
        kind = F.when(x.isNull(), F.lit(f"{c}: missing")).when(F.isnan(x), F.lit(f"{c}: NaN")).when(F.abs(x) == INF, F.lit(f"{c}: infinite")).otherwise(kind)
    return df.withColumn("error", kind).filter("error IS NOT NULL")


def clamp(c: Column, lo: float, hi: float) -> Column:
    if not lo <= hi:
        raise ValueError("lo is at most hi")
    return F.when(F.isnan(c), c).otherwise(F.greatest(F.least(c, F.lit(float(hi))), F.lit(float(lo))))


def constant_impute(c: Column, fill: float = 0.0) -> Column:
    return F.coalesce(F.nanvl(c, F.lit(float(fill))), F.lit(float(fill)))


def missing(c: Column) -> Column:
    return F.when(c.isNull() | F.isnan(c), 1.0).otherwise(0.0)


def with_indicators(features: Column) -> Column:
    """x0, m0, x1, m1, ... of an array."""
    return F.flatten(F.transform(features, lambda x: F.array(x, missing(x))))


def sigmoid(z: Column) -> Column:
    return F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))


def squared_loss(p: Column, t: Column) -> Column:
    return 0.5 * (p - t) * (p - t)


def squared_gradient(p: Column, t: Column) -> Column:
    return p - t


def huber_loss(p: Column, t: Column, delta: float = 1.0) -> Column:
    r = F.abs(p - t)
    return F.when(r <= delta, 0.5 * r * r).otherwise(delta * (r - 0.5 * delta))


def huber_gradient(p: Column, t: Column, delta: float = 1.0) -> Column:
    return F.greatest(F.least(p - t, F.lit(float(delta))), F.lit(-float(delta)))


def log_loss(p: Column, y: Column, eps: float = 1e-15) -> Column:
    if not 0 < eps < 0.5:
        raise ValueError("eps lies between 0 and 0.5")
    q = F.greatest(F.least(p, F.lit(1 - eps)), F.lit(eps))
    return -F.when(y, F.ln(q)).otherwise(F.ln(1 - q))


def log_loss_gradient(p: Column, y: Column) -> Column:
    return p - y.cast("double")


def linear_score(features: Column, weights: Column, intercept: Column | float = 0.0) -> Column:
    """intercept + sum(w * x) of two arrays."""
    return (intercept if isinstance(intercept, Column) else F.lit(float(intercept))) + F.aggregate(F.zip_with(features, weights, lambda x, w: x * w), F.lit(0.0), lambda a, b: a + b)


def learning_rate(level: Column, base: float = 0.01, warning: float = 2.0, drift: float = 5.0) -> Column:
    """The rate for a drift level: base, or that times what a warning or a drift asks for."""
    if not 1 <= warning <= drift:
        raise ValueError("1 <= warning <= drift")
    return F.when(level == "Drift", base * drift).when(level == "Warning", base * warning).otherwise(base)
