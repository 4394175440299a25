"""Change detection by windows and joins: Page-Hinkley without forgetting, adjacent-window Kolmogorov-Smirnov, levels and actions."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.frames import Names, ordered, upto

#: Actions on a drift, and those that change no model.
ACTIONS = ("ResetModel", "ReduceConfidence", "IncreaseLearningRate", "SwitchModel", "FreezeLearning", "NotifyOnly")
HARMLESS = ("NotifyOnly", "ReduceConfidence")


def page_hinkley(df: DataFrame, x: str, keys: Names, order: Names, threshold: float = 50.0, warning: float = 25.0, delta: float = 0.005, least: int = 30) -> DataFrame:
    """df with ph_stat and ph_level of upward shifts, by three stacked windows on one sort."""
    if not 0 < warning <= threshold or least < 1:
        raise ValueError("0 < warning <= threshold, and least is positive")
    w = upto(keys, order)
    out = df.withColumns({"_n": F.count(F.lit(1)).over(w), "_d": F.col(x) - F.avg(x).over(w) - delta})
    out = out.withColumn("_s", F.sum("_d").over(w))
    out = out.withColumn("ph_stat", F.col("_s") - F.least(F.lit(0.0), F.min("_s").over(w)))
    level = F.when((F.col("_n") < least) | (F.col("ph_stat") <= warning), "None").when(F.col("ph_stat") > threshold, "Drift").otherwise("Warning")
    return out.withColumn("ph_level", level).drop("_n", "_d", "_s")


def ks_statistic(a, b) -> float:
    """Largest gap of two samples' distributions; on equal values both walks take one step, so runs of ties are no textbook case."""
    a, b = np.sort(a), np.sort(b)
    i = j = 0
    top = 0.0
    while i < len(a) and j < len(b):
        x, y = a[i], b[j]
        i, j = i + (x <= y), j + (y <= x)
        top = max(top, abs(i / len(a) - j / len(b)))
    return float(top)


def ks_p_value(d: Column, n1: Column, n2: Column, terms: int = 100) -> Column:
    """The asymptotic series, in [0, 1]."""
    ne = F.sqrt(n1 * n2 / (n1 + n2))
    at = (ne + 0.12 + 0.11 / ne) * d
    series = F.aggregate(F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0), lambda a, k: a + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * at * at))
    return F.when(at < 1e-3, 1.0).otherwise(F.greatest(F.least(series, F.lit(1.0)), F.lit(0.0)))


def kswin(df: DataFrame, x: str, keys: Names, order: Names, window: int = 100, interval: int = 1, alpha: float = 0.005) -> DataFrame:
    """keys, wid, d, p_value and level at each check of two adjacent full windows of each stream."""
    if window < 1 or interval < 1 or not 0 < alpha < 1:
        raise ValueError("window and interval are positive, alpha lies between 0 and 1")

    @F.pandas_udf("double")
    def statistic(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([ks_statistic(x, y) for x, y in zip(a, b)], dtype=float)

    step = math.ceil(interval / window)
    numbered = df.withColumn("wid", F.floor((F.row_number().over(ordered(keys, order)) - 1) / window) + 1)
    full = numbered.groupBy(*keys, "wid").agg(F.collect_list(x).alias("xs")).filter(F.size("xs") == window)
    before = full.select(*keys, (F.col("wid") + 1).alias("wid"), F.col("xs").alias("ys"))
    first = max(2, step)
    pairs = full.join(before, [*keys, "wid"]).filter((F.col("wid") >= first) & ((F.col("wid") - first) % step == 0))
    out = pairs.withColumn("d", statistic("ys", "xs")).withColumn("p_value", ks_p_value(F.col("d"), F.lit(float(window)), F.lit(float(window))))
    return out.select(*keys, "wid", "d", "p_value", F.when(F.col("p_value") < alpha, "Drift").otherwise("None").alias("level"))


def is_change(level: Column) -> Column:
    return level.isin("Warning", "Drift")


def action_for(level: Column, on_warning: str = "NotifyOnly", on_drift: str = "ResetModel") -> Column:
    for a in (on_warning, on_drift):
        if a not in ACTIONS:
            raise ValueError(f"no action {a}")
    return F.when(level == "Drift", on_drift).when(level == "Warning", on_warning).otherwise("NotifyOnly")


def is_destructive(action: Column) -> Column:
    return ~action.isin(*HARMLESS)


def vote_counts(votes: DataFrame, window: Names) -> DataFrame:
    """window keys, n_warning, n_drift and n_available of (window, detector, level, available) rows."""
    there = F.col("available")
    return votes.groupBy(*window).agg(
        F.sum((there & is_change(F.col("level"))).cast("bigint")).alias("n_warning"),
        F.sum((there & (F.col("level") == "Drift")).cast("bigint")).alias("n_drift"),
        F.sum(there.cast("bigint")).alias("n_available"),
    )
