"""Feature transformers: fitted once by aggregates, or progressively over a frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from ..plans.frames import Names, prior, upto


def scaled(x: Column, frame: WindowSpec, with_mean: bool = True, with_std: bool = True, epsilon: float = 1e-12) -> Column:
    """(x - mean) / deviation of the population over the frame; a variance below epsilon, or none yet, scales by 1."""
    centre = F.coalesce(F.avg(x).over(frame), F.lit(0.0)) if with_mean else F.lit(0.0)
    v = F.coalesce(F.var_pop(x).over(frame), F.lit(0.0))
    return (x - centre) / (F.when(v < epsilon, 1.0).otherwise(F.sqrt(v)) if with_std else F.lit(1.0))


def min_max(x: Column, frame: WindowSpec, lo: float = 0.0, hi: float = 1.0) -> Column:
    """x between its least and greatest value so far on [lo, hi], not clamped; x itself before any."""
    a, b = F.min(x).over(frame), F.max(x).over(frame)
    return F.when(a.isNull(), x).when(F.abs(b - a) < 2.220446049250313e-16, (lo + hi) / 2).otherwise(lo + (x - a) / (b - a) * (hi - lo))


def mean_imputed(x: Column, keys: Names, order: Names) -> Column:
    x = F.nanvl(x, F.lit(None).cast("double"))
    return F.coalesce(x, F.avg(x).over(prior(keys, order)), F.lit(0.0))


def forward_filled(x: Column, keys: Names, order: Names) -> Column:
    x = F.nanvl(x, F.lit(None).cast("double"))
    return F.coalesce(F.last(x, ignorenulls=True).over(upto(keys, order)), F.lit(0.0))


def vocabulary(df: DataFrame, c: str) -> DataFrame:
    """One row: the sorted categories of a column (distinct per task before they meet)."""
    return df.select(F.col(c).alias("_c")).distinct().agg(F.array_sort(F.collect_set("_c")).alias("vocabulary"))


def one_hot(c: Column, vocab: Column) -> Column:
    """A vector with 1.0 at the category; an empty vocabulary gives an empty vector, an unknown category null."""
    return F.when((F.size(vocab) == 0) | F.array_contains(vocab, c), F.transform(vocab, lambda v: F.when(v == c, 1.0).otherwise(0.0)))


def ordinal(c: Column, vocab: Column) -> Column:
    at = F.array_position(vocab, c)
    return F.when(at > 0, (at - 1).cast("double"))


def with_frequency(df: DataFrame, c: str, name: str = "frequency") -> DataFrame:
    """df with each category's share of all rows, by two small aggregates that are joined back."""
    per = df.groupBy(c).agg(F.count(F.lit(1)).alias("_n"))
    whole = per.agg(F.sum("_n").alias("_all"))
    return df.join(F.broadcast(per.crossJoin(whole).select(F.col(c).alias("_c"), (F.col("_n") / F.col("_all")).alias(name))), F.col(c).eqNullSafe(F.col("_c")), "left").drop("_c")


def sparse(df: DataFrame, row: Names, feature: str, value: str, name: str = "features") -> DataFrame:
    """Rows of (feature, value) as one sorted array of structs for each row key; values of a feature that recurs are added."""
    per = df.groupBy(*row, feature).agg(F.sum(value).alias("value"))
    return per.groupBy(*row).agg(F.sort_array(F.collect_list(F.struct(F.col(feature).alias("id"), F.col("value")))).alias(name))


def sparse_get(features: Column, feature: Column) -> Column:
    """The value of a feature, null where it is absent."""
    return F.get(F.filter(features, lambda x: x["id"] == feature), 0)["value"]


def hashed(features: Column, dimension: int = 1024, seed: int = 0, signed: bool = True) -> Column:
    """A dense vector of hashed features: bucket and sign by two hashes, values that meet are added."""
    if dimension < 1:
        raise ValueError("dimension is positive")
    bucket = lambda x: F.pmod(F.xxhash64(F.lit(seed), x["id"]), F.lit(dimension)).cast("int")
    sign = lambda x: F.when(F.lit(signed) & (F.pmod(F.xxhash64(F.lit(seed + 0x517C), x["id"]), F.lit(2)) == 1), -1.0).otherwise(1.0)
    placed = F.transform(features, lambda x: F.struct(bucket(x).alias("b"), (sign(x) * x["value"]).alias("v")))
    return F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.aggregate(F.filter(placed, lambda p: p["b"] == i), F.lit(0.0), lambda a, p: a + p["v"]))


def hash_name(c: Column, seed: int = 0) -> Column:
    return F.xxhash64(F.lit(seed), c)


def merged(features: Column) -> Column:
    """Features in order of their ids; the values of ids that recur, by equal names or by names that collide, are added."""
    ids = F.array_sort(F.array_distinct(F.transform(features, lambda f: f["id"])))
    total = lambda i: F.aggregate(F.filter(features, lambda f: f["id"] == i), F.lit(0.0), lambda a, f: a + f["value"])
    return F.transform(ids, lambda i: F.struct(i.alias("id"), total(i).alias("value")))
