"""Token ids as Parquet list columns.

The ids of each document are a list column whose pages have dictionary encoding (PLAIN of the library's ids takes 32 bits each,
the dictionary's indexes 16 at most) or, by choice, delta encoding; row groups and pages have set sizes, and Parquet's column and
offset indexes let a reader fetch single documents' pages, or the metadata without any token page. Files follow each other in
ascending doc_id order, each row says where its ids start among those of its file, and a small table has the files' totals.

Null texts count as empty: their ids are the end id alone. Null doc_ids come first; rows with equal doc_id are ordered by text.
An empty table gives an empty token table. Further columns of the input are not written.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokens import Encoder

END_ID = 2
ROW_GROUP_BYTES, PAGE_BYTES, DICTIONARY_BYTES = 32 << 20, 256 << 10, 1 << 20
SCHEMA = "part int, doc_id bigint, start_in_part bigint, n_tokens int, ids array<int>"


def parquet_options(encoding: str = "dictionary") -> dict[str, str]:
    """Writer options: row group and page sizes, and dictionary or delta encoding of the ids."""
    own = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.page.size": PAGE_BYTES, "parquet.page.row.count.limit": 2000, "compression": "zstd", "parquet.compression.codec.zstd.level": 1}
    if encoding == "dictionary":
        own |= {"parquet.enable.dictionary": "true", "parquet.dictionary.page.size": DICTIONARY_BYTES}
    elif encoding == "delta":
        own |= {"parquet.enable.dictionary": "false", "parquet.writer.version": "PARQUET_2_0"}
    else:
        raise ValueError(f"encoding is dictionary or delta, not {encoding}")
    return {k: str(v) for k, v in own.items()}


def _encoded(tokenizer: str, end_id: int):
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(SCHEMA))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = Encoder.of(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [x + end for x in encoder.ids([t or "" for t in batch.column("text").to_pylist()])]
            n = np.array([len(x) // 4 for x in ids], np.int64)
            ends = np.cumsum(n)
            flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), flat)
            columns = [pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id"), pa.array(start + ends - n), pa.array(n.astype(np.int32)), lists.cast(schema.field("ids").type)]
            start += int(ends[-1]) if len(n) else 0
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def write_tokens(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, encoding: str = "dictionary", partitions: int | None = None) -> None:
    """Encode docs(doc_id, text) and write their ids to path, in ascending doc_id order."""
    spark = common.session(docs)
    common.small_batches(spark)
    slim = common.plain(docs, "doc_id", "text")
    n = partitions or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = slim.repartitionByRange(n, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    ordered.mapInArrow(_encoded(tokenizer, end_id), SCHEMA).write.options(**parquet_options(encoding)).parquet(path)


def read_tokens(spark: SparkSession, path: str, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """The token table with each document's start among all ids; without "ids" in columns no token page is read."""
    table = spark.read.schema(SCHEMA).parquet(path)
    # One row for each file: a running sum over these, never over documents.
    parts = table.groupBy("part").agg(F.sum("n_tokens").cast("long").alias("_n"))
    bases = parts.select("part", F.coalesce(F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return table.join(F.broadcast(bases), "part").select("doc_id", (F.col("_base") + F.col("start_in_part")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), *columns)


def ids_crc32(ids: pa.Array) -> pa.Array:
    """crc32 of each list as little-endian unsigned 32-bit ids."""
    at, flat = ids.offsets.to_numpy(), np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).view(np.uint8)
    return pa.array([zlib.crc32(flat[4 * s : 4 * e]) for s, e in zip(at, at[1:])], pa.int64())


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    common.small_batches(spark)
    path = common.fresh_path(spark, "token-ids")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), path)

    def digest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("start"), b.column("n_tokens"), ids_crc32(b.column("ids"))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read_tokens(spark, path).mapInArrow(digest, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
