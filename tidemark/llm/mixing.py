"""Mixing sources to target weights.

Words are summed for each source, a source's target divided by its words is its repetition rate, and each document comes
floor(rate) times and once more with the rate's fraction as probability, drawn from a hash of its doc_id. Targets share the
corpus by weight, up to MOST_REPEATS times a source; what is above goes to the other sources by weight, until none is above.

Null texts have no words. Null sources are one source, the last in order. Rows with equal doc_id get equal draws. A source
without words has target 0 and rate 0. An empty table gives an empty table. Further columns are kept by mix_documents().
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import common

MOST_REPEATS = 3
WEIGHTS = (1.0, 2.0, 3.0)
#: Sources are joined by broadcast up to so many; a name of up to 1 KB each makes at most 64 MB.
MOST_BROADCAST = 65_536


def word_count(text: Column) -> Column:
    """Words of a whole text, counted without building an array."""
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS) -> DataFrame:
    """source, source_size, target, rate of each source, from (source, size) rows.

    The level of the shares is found without a loop: sources are ordered by the level at which they fill up, and the last order
    statistic at which those before are full and the others are not gives it. Windows see a row for each source only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    per = per.withColumn("_n", F.row_number().over(order) - 1)
    per = per.withColumn("_w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.col("_n") % len(weights) + 1).cast("int")))
    per = per.withColumn("_cap", F.col("source_size") * float(MOST_REPEATS))
    filled = Window.orderBy(F.col("_cap") / F.col("_w"), "_n").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumn("_full", F.coalesce(F.sum("_cap").over(filled), F.lit(0.0))).withColumn("_light", F.sum("_w").over(whole) - F.coalesce(F.sum("_w").over(filled), F.lit(0.0)))
    per = per.withColumn("_level", (F.sum("source_size").over(whole) - F.col("_full")) / F.col("_light"))
    # A source stays open at the level that holds when all before it are full; the first that does gives the level of all.
    per = per.withColumn("_level", F.min(F.when(F.col("_level") * F.col("_w") <= F.col("_cap"), F.struct((F.col("_cap") / F.col("_w")).alias("at"), F.col("_n").alias("n"), F.col("_level").alias("level")))).over(whole)["level"])
    target = F.least(F.col("_cap"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_cap")))
    return per.select("source", "source_size", target.alias("target"), F.when(F.col("source_size") > 0, target / F.col("source_size")).otherwise(0.0).alias("rate"))


def with_copies(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 10) -> DataFrame:
    """row (a row of docs), size, source_size, target and copies: how often the mix takes the row."""
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    targets = common.stored(source_targets(docs.select(source.alias("source"), word_count(text).alias("size")), weights), "mix-targets")
    side = targets.withColumnRenamed("source", "of")
    if targets.count() <= MOST_BROADCAST:
        side = F.broadcast(side)
    draw = common.share(F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    rows = docs.select(F.struct(*(F.col(common.quoted(c)) for c in docs.columns)).alias("row"), source.alias("from"), word_count(text).alias("size"), draw.alias("draw"))
    whole = F.floor("rate")
    copies = (whole + F.when(F.col("draw") < F.col("rate") - whole, 1).otherwise(0)).cast("int")
    return rows.join(side, F.col("from").eqNullSafe(F.col("of")), "left").select("row", "size", "source_size", "target", copies.alias("copies"))


def mix_documents(docs: DataFrame, weights: Sequence[float] = WEIGHTS, seed: int = 10) -> DataFrame:
    """The mixed corpus: each row of docs as often as it is taken, with the columns of docs."""
    taken = with_copies(docs, weights, seed).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    taken = with_copies(common.plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source"))
    return taken.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


#: The level by repeated sharing in a recursive query, as the contract words it.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s0 AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS n FROM d GROUP BY source),
s AS (SELECT source, source_size, CAST(n % 3 + 1 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM s0),
t AS (SELECT CAST(sum(source_size) AS DOUBLE) AS total, sum(w) AS all_w FROM s),
r AS (SELECT 0 AS i, total / all_w AS level FROM t
  UNION ALL
  SELECT i + 1, (SELECT (t.total - coalesce(sum(CASE WHEN s.cap <= r.level * s.w THEN s.cap END), 0)) / nullif(sum(CASE WHEN s.cap > r.level * s.w THEN s.w END), 0) FROM s)
  FROM r, t WHERE i < (SELECT count(*) FROM s)),
v AS (SELECT max(level) AS level FROM r),
x AS (SELECT s.*, least(cap, coalesce(v.level * w, cap)) AS target FROM s, v),
y AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate FROM x)
SELECT d.doc_id, d.size, y.source_size, y.target,
  CAST(d.size * (floor(y.rate) + CASE WHEN CAST(('0x' || substr(md5('10|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE < y.rate - floor(y.rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN y ON d.source IS NOT DISTINCT FROM y.source
"""
