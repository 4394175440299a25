"""Structured Streaming: keyed folds over file streams, and decisions matched with delayed feedback."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.fold import Step, run_stream

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in spark.checkpoint.dir, which driver and executors share. Only where all runs on one machine may it be unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return f"{at.rstrip('/')}/tidemark/{name}-{uuid.uuid4().hex}"


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed states go to RocksDB, so that they needn't fit in memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def file_stream(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """New Parquet files at path (a folder, or one file) as a stream; the schema is that of the files there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_per_trigger)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).getFileStatus(at).isFile():
        return reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString())
    return reader.parquet(path)


def progressive(rows: DataFrame, step: Step, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """A step's output for each row of a stream: predicted before it is learned from."""
    use_rocksdb(rows.sparkSession)
    return run_stream(rows, step, keys, order)


def matched(decisions: DataFrame, outcomes: DataFrame, delay: str, late: str = "0 seconds") -> DataFrame:
    """Decisions (id, created_at, ...) with the outcome (decision_id, observed_at, reward) that came within delay, or with none once
    the watermark has passed; times are timestamps. State is dropped as the watermarks move on."""
    d = decisions.withWatermark("created_at", late)
    o = outcomes.withWatermark("observed_at", late)
    when = (F.col("id") == F.col("decision_id")) & (F.col("observed_at") >= F.col("created_at")) & (F.col("observed_at") <= F.col("created_at") + F.expr(f"INTERVAL {delay}"))
    return d.join(o, when, "leftOuter")


def drain(stream: DataFrame, checkpoint: str, path: str | None = None, mode: str = "append") -> DataFrame:
    """Run over all that is there now, from where the checkpoint stands, and return what was written to path (or to memory)."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    spark = stream.sparkSession
    if path:
        writer.format("parquet").start(path).awaitTermination()
        return spark.read.parquet(path)
    name = f"drained_{uuid.uuid4().hex}"
    writer.format("memory").queryName(name).start().awaitTermination()
    return spark.table(name)
