"""Best-fit packing of token pieces into sequences, planned on the counts of lengths.

Documents are encoded and cut into pieces of at most a sequence's length. How many pieces have each length is a table of at most
that many rows, whatever the corpus; a plan for it is made on the driver. Lengths above a third of the capacity fit at most twice
into a sequence: from the longest down, each is matched with the longest other such length that still fits. Lengths up to a third
then go, from the longest down, into the smallest gap that takes them, and open new sequences when none does. The plan says for
each length which of its pieces, by rank, go to which sequences; ranks are a piece's place in its own partition plus the counts
of the partitions before, so that no task ever sees all pieces of a length.

Null texts count as empty: one piece that holds the end id alone. Rows with equal doc_id are packed each on their own. An empty
table gives no pieces. Further columns of the input are not carried along.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common
from .tokens import Encoder

CAPACITY, END_ID = 2048, 0
#: The table of counts by partition and length is broadcast up to so many rows of 24 bytes.
MOST_BROADCAST = 500_000
PIECES = "part int, doc_id bigint, piece int, start bigint, length int, local_rank bigint, ids binary"


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[tuple[int, int], ...], int]]:
    """Kinds of sequences: ((length, how many), ...) in order, and how many sequences are of that kind."""
    left = {n: c for n, c in counts.items() if c}
    if any(not 0 < n <= capacity for n in left):
        raise ValueError(f"lengths are from 1 to {capacity}")
    gaps: dict[int, list] = {}
    open_gaps: list[int] = []

    def put(gap: int, content: tuple, many: int) -> None:
        if many:
            if gap not in gaps:
                gaps[gap] = []
                bisect.insort(open_gaps, gap)
            gaps[gap].append((content, many))

    large = sorted(n for n in left if 3 * n > capacity)
    for a in reversed(large):
        at = bisect.bisect_right(large, min(a, capacity - a)) - 1
        while left[a] and at >= 0:
            b = large[at]
            many = left[a] // 2 if a == b else min(left[a], left[b])
            if many:
                left[a] -= many
                left[b] -= many
                put(capacity - a - b, ((a, 1), (b, 1)), many)
            at -= 1
        put(capacity - a, ((a, 1),), left[a])
        left[a] = 0
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect.bisect_left(open_gaps, n)
            if at == len(open_gaps):
                content, many, gap = (), -(-left[n] // (capacity // n)), capacity
            else:
                gap = open_gaps[at]
                content, many = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], open_gaps[at]
            each = gap // n
            whole = min(many, left[n] // each)
            left[n] -= whole * each
            rest = left[n] if whole < many else 0
            left[n] -= rest
            put(gap - each * n, (*content, (n, each)), whole)
            if rest:
                put(gap - rest * n, (*content, (n, rest)), 1)
            if content:
                put(gap, content, many - whole - bool(rest))
    return [x for gap in open_gaps for x in gaps[gap]]


def slots(kinds: list[tuple[tuple[tuple[int, int], ...], int]]) -> np.ndarray:
    """A row for each length of each kind: length, first rank, how many to a sequence, first sequence, offset there; ordered."""
    ranks: dict[int, int] = {}
    rows, first = [], 0
    for content, many in kinds:
        offset = 0
        for n, each in content:
            rows.append((n, ranks.get(n, 0), each, first, offset))
            ranks[n] = ranks.get(n, 0) + each * many
            offset += n * each
        first += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """The pieces of docs(doc_id, text): their ids, and their rank among those of equal length in their partition."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = to_arrow_schema(StructType.fromDDL(PIECES))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = Encoder.of(tokenizer), TaskContext.get().partitionId()
        ranks = [0] * (capacity + 1)
        for batch in batches:
            rows = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids([t or "" for t in batch.column("text").to_pylist()])):
                ids += end
                n = len(ids) // 4
                start, stop = 0, (n - 1) % capacity + 1
                piece = 0
                while start < n:
                    length = stop - start
                    rows.append((part, doc_id, piece, start, length, ranks[length], ids[4 * start : 4 * stop]))
                    ranks[length] += 1
                    piece, start, stop = piece + 1, stop, stop + capacity
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    common.small_batches(common.session(docs))
    return common.plain(docs, "doc_id", "text").mapInArrow(run, PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID, columns: tuple[str, ...] = ("ids",)) -> DataFrame:
    """The pieces of docs with their sequence and their place in it; columns: what else of each piece to return."""
    cut = common.stored(pieces(docs, tokenizer, capacity, end_id), "pieces", {"compression": "zstd"})
    per = cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    per = common.stored(per.select("part", "length", "n", F.coalesce(before, F.lit(0)).alias("before")), "piece-counts")
    totals = {r["length"]: r["n"] for r in per.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    table = slots(plan(totals, capacity))

    bases = per.select("part", "length", "before")
    if per.count() <= MOST_BROADCAST:
        bases = F.broadcast(bases)
    ranked = cut.select("part", "doc_id", "piece", "start", "length", "local_rank", *(F.expr(c) if " " in c else F.col(c) for c in columns)).join(bases, ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("local_rank")).drop("part", "before", "local_rank")
    kept = [c for c in ranked.columns if c != "rank"]
    out = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank") + ", sequence_id bigint, offset bigint"
    keys = (table[:, 0] << 44) + table[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy().astype(np.int64), b.column("rank").to_numpy()
            row = table[np.searchsorted(keys, (length << 44) + rank, "right") - 1] if len(length) else table[:0]
            rel = rank - row[:, 1]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in kept), pa.array(row[:, 3] + rel // row[:, 2]), pa.array(row[:, 4] + rel % row[:, 2] * length)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(place, out)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    packed = pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), columns=("crc32(ids) AS ids_crc32",))
    return packed.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
