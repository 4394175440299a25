"""Statistics of ordered streams, as aggregates of a group (frame None) or over a window frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..functions.columns import clamp
from ..plans.frames import Names, last, over

#: The scale of the normal distribution's median absolute deviation, and its inverse.
NORMAL_MAD, INVERSE_MAD = 1.482602218505602, 0.6744897501960817
MOST_WINDOW = 65_536


def count(frame: WindowSpec | None = None) -> Column:
    return over(F.count(F.lit(1)), frame)


def total(x: Column, frame: WindowSpec | None = None) -> Column:
    return F.coalesce(over(F.sum(x), frame), F.lit(0.0))


def mean(x: Column, frame: WindowSpec | None = None) -> Column:
    return F.coalesce(over(F.avg(x), frame), F.lit(0.0))


def variance(x: Column, frame: WindowSpec | None = None, population: bool = False) -> Column:
    """Null while there are too few values: none for the population's, fewer than two for the sample's."""
    return over(F.var_pop(x) if population else F.var_samp(x), frame)


def std_dev(x: Column, frame: WindowSpec | None = None, population: bool = False) -> Column:
    return over(F.stddev_pop(x) if population else F.stddev_samp(x), frame)


def minimum(x: Column, frame: WindowSpec | None = None) -> Column:
    return over(F.min(x), frame)


def maximum(x: Column, frame: WindowSpec | None = None) -> Column:
    return over(F.max(x), frame)


def clipped_mean(x: Column, lo: float, hi: float, frame: WindowSpec | None = None) -> Column:
    return mean(clamp(x, lo, hi), frame)


def ew_mean(order: Column, x: Column, alpha: float) -> Column:
    """Exponentially weighted mean of a group: the first value, then alpha * x + (1 - alpha) * mean; 0.0 when empty."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha lies in (0, 1]")
    rows = F.sort_array(F.collect_list(F.struct(order.alias("o"), x.alias("x"))))
    step = lambda a, r: F.when(a.isNull(), r["x"]).otherwise(alpha * r["x"] + (1 - alpha) * a)
    return F.coalesce(F.aggregate(rows, F.lit(None).cast("double"), step), F.lit(0.0))


def weighted_ew_mean(order: Column, x: Column, w: Column, alpha: float) -> Column:
    """As ew_mean with alpha 1 - (1 - alpha)^w for a weight w; weights of 0 do nothing."""
    if not 0 < alpha <= 1:
        raise ValueError("alpha lies in (0, 1]")
    rows = F.sort_array(F.collect_list(F.when(w > 0, F.struct(order.alias("o"), x.alias("x"), w.alias("w")))))

    def step(a: Column, r: Column) -> Column:
        share = 1 - F.pow(F.lit(1 - alpha), r["w"])
        return F.when(a.isNull(), r["x"]).otherwise(share * r["x"] + (1 - share) * a)

    return F.aggregate(rows, F.lit(None).cast("double"), step)


def weighted_mean(x: Column, w: Column, frame: WindowSpec | None = None) -> Column:
    """Null while the weights add up to 0."""
    return over(F.sum(F.when(w > 0, x * w)), frame) / F.nullif(over(F.sum(F.when(w > 0, w)), frame), F.lit(0.0))


def weighted_variance(x: Column, w: Column, frame: WindowSpec | None = None) -> Column:
    """Of the population, by weights."""
    m = weighted_mean(x, w, frame)
    return F.greatest(weighted_mean(x * x, w, frame) - m * m, F.lit(0.0))


def weighted_mae(t: Column, p: Column, w: Column, frame: WindowSpec | None = None) -> Column:
    return weighted_mean(F.abs(t - p), w, frame)


def weighted_mse(t: Column, p: Column, w: Column, frame: WindowSpec | None = None) -> Column:
    return weighted_mean((t - p) * (t - p), w, frame)


def decayed_mean(df: DataFrame, keys: Names, time: str, x: str, decay: float, name: str = "decayed_mean") -> DataFrame:
    """keys and the mean in which a value counts exp(-decay * age) at each stream's last time (s)."""
    if decay <= 0:
        raise ValueError("decay is positive")
    end = df.groupBy(*keys).agg(F.max(time).alias("_end"))
    weight = F.exp(-decay * (F.col("_end") - F.col(time)))
    return df.join(end, list(keys)).groupBy(*keys).agg((F.sum(F.col(x) * weight) / F.sum(weight)).alias(name))


def window_values(x: Column, keys: Names, order: Names, rows: int) -> Column:
    """The last values, oldest first."""
    if rows > MOST_WINDOW:
        raise ValueError(f"a window has at most {MOST_WINDOW} values")
    return F.collect_list(x).over(last(keys, order, rows))


def _middle(xs: Column) -> Column:
    s, n = F.array_sort(xs), F.size(xs)
    return (F.get(s, F.floor((n - 1) / 2).cast("int")) + F.get(s, F.floor(n / 2).cast("int"))) / 2


def with_median_mad(df: DataFrame, x: str, keys: Names, order: Names, rows: int, least: int = 1) -> DataFrame:
    """df with median, mad, normal_mad, z_status and modified_z of the last values; null while there are fewer than least."""
    values = df.withColumn("_values", window_values(F.col(x), keys, order, rows))
    values = values.withColumn("median", F.when(F.size("_values") >= least, _middle(F.col("_values"))))
    values = values.withColumn("mad", F.when(F.col("median").isNotNull(), _middle(F.transform("_values", lambda v: F.abs(v - F.col("median"))))))
    status = F.when(F.col("mad").isNull(), "InsufficientData").when(F.col("mad") == 0, "ZeroMad").otherwise("Score")
    z = F.when(F.col("mad") != 0, INVERSE_MAD * (F.col(x) - F.col("median")) / F.col("mad"))
    return values.drop("_values").withColumns({"normal_mad": F.col("mad") * NORMAL_MAD, "z_status": status, "modified_z": z})


def with_anomalies(df: DataFrame, x: str, keys: Names, order: Names, rows: int = 20, z: float = 3.0) -> DataFrame:
    """df with rolling mean and deviation, z-score, and whether a value of a full window is more than z deviations off."""
    w = last(keys, order, rows)
    out = df.withColumns({"roll_mean": F.avg(x).over(w), "roll_std": F.stddev_samp(x).over(w), "_n": F.count(F.lit(1)).over(w)})
    score = F.when(F.col("roll_std") > 1e-9, F.abs(F.col(x) - F.col("roll_mean")) / F.col("roll_std"))
    return out.withColumn("z", score).withColumn("anomaly", F.coalesce((F.col("_n") == rows) & (F.col("z") > z), F.lit(False))).drop("_n")
