"""Replay logs as tables: JSON, JSON lines and CSV with a fixed schema, and the checks that a log must pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import finite

#: The columns of a replay log, in order.
SCHEMA = (
    "timestamp bigint, decision_id string, context array<double>, selected_arm int, outcome_time bigint, reward double, "
    "generation bigint, feature_schema_hash string, baseline_reward double, optimal_reward double, drift boolean"
)


def read(spark: SparkSession, path: str, lines: bool = True) -> DataFrame:
    """A log as JSON lines, or as one JSON array; rows that don't fit the schema fail the read."""
    return spark.read.schema(SCHEMA).option("mode", "FAILFAST").option("multiLine", not lines).json(path)


def faults(log: DataFrame) -> DataFrame:
    """Rows with numbers that aren't finite, or feedback before its decision, with the fault."""
    bad = F.when(F.exists("context", lambda x: ~finite(x)), "context").when(F.col("outcome_time") < F.col("timestamp"), "latency")
    for c in ("reward", "baseline_reward", "optimal_reward"):
        bad = bad.when(F.col(c).isNotNull() & ~finite(F.col(c)), c)
    return log.withColumn("fault", bad).filter("fault IS NOT NULL")


def write_json(log: DataFrame, path: str) -> None:
    log.write.option("ignoreNullFields", "false").json(path)


def write_csv(log: DataFrame, path: str) -> None:
    """The context is written as JSON."""
    log.withColumn("context", F.to_json("context")).write.option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    flat = SCHEMA.replace("context array<double>", "context string")
    return spark.read.schema(flat).option("header", True).csv(path).withColumn("context", F.from_json("context", "array<double>"))


def numeric(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns as doubles: floats are widened, other types and nulls are errors."""
    kinds = dict(df.dtypes)
    for c in columns:
        if kinds.get(c) not in ("double", "float"):
            raise TypeError(f"{c} is {kinds.get(c, 'missing')}, not a floating-point column")
    out = [F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} has a null")).cast("double")).otherwise(F.col(c).cast("double")).alias(c) for c in columns]
    return df.select(*out)
