"""What the corpus operators share: the shared work folder, written tables, Arrow batch limits and word rules."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The word rule shared by the operators (ASCII blanks part words).
BLANKS = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
BLANK_RUN = r"[\x20\x09-\x0D]+"

DEFAULT_BATCH_ROWS = "10000"


def session(df: DataFrame) -> SparkSession:
    return df.sparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only where all runs on one machine may it be unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.conf.get("spark.master", "")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        at = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidemark/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: lineage ends there, and a lost executor loses nothing."""
    spark = session(df)
    path = fresh_path(spark, name)
    df.write.options(**(options or {})).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidemark_path = path
    return back


def discard(df: DataFrame) -> None:
    """Remove the files of a stored() table that nothing reads any more."""
    path = getattr(df, "_tidemark_path", None)
    if path:
        jvm = session(df)._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(session(df)._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Whole texts go to Python in batches of few rows, so that long texts don't fill a worker's memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, DEFAULT_BATCH_ROWS) == DEFAULT_BATCH_ROWS:
        spark.conf.set(key, str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """What runs within sends narrow rows to Python in batches of so many."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, DEFAULT_BATCH_ROWS)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def over_texts(f: Callable[[list], dict[str, list | pa.Array]], keep: list[str], schema: "str | StructType", text: str = "text"):
    """A function for mapInArrow: f takes a batch's texts (null: "") and returns further columns; keep passes through."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema) if isinstance(schema, str) else schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = f([x or "" for x in batch.column(text).to_pylist()])
            columns = [batch.column(x.name) if x.name in keep else made[x.name] for x in fields]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, (pa.Array, pa.ChunkedArray)) and c.type == x.type else c.cast(x.type) if isinstance(c, pa.Array) else pa.array(c, x.type) for c, x in zip(columns, fields)], schema=fields)

    return run


def plain(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, with the types that the operators count on."""
    kinds = {"doc_id": "bigint", "text": "string", "lang": "string", "source": "string"}
    return docs.select(*(F.col(n).cast(kinds[n]).alias(n) for n in names))


def quoted(name: str) -> str:
    """A column's name as F.col() takes it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def free(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def words(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK_RUN), lambda w: w != "")


def share(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone, the same in every engine: 52 bits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *key).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
