"""Members of keys compared in blocks, so that links are found without rows for pairs and no key is gathered in a task.

A key's members that are in different components so far must be held against each other. The members of its largest component are
dealt over blocks of their own, apart from all others, so that no two blocks of that component meet: a few members that are still
apart cost a pass over the rest, not its square. A group is a pair of blocks; its rows follow each other in a partition, and a
function compares them there and returns links that join components, at most one for each member.

Nulls don't occur. No members, or none that are still apart, give no groups.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A group's columns in order; side is 0 or 1, and a block that meets itself has side 0 alone.
GROUP = ("key", "i", "j")


def open_groups(members: DataFrame, found: DataFrame, block: int) -> DataFrame:
    """key, i, j, side, id and component for members(key, id, weight) of keys that have several components.

    found: node and component. block: the weight that a block has on average at most, if no member weighs more.
    """
    label = F.coalesce("component", "id").alias("component")
    placed = members.join(found.withColumnRenamed("node", "id"), "id", "left").select("key", "id", "weight", label)
    each = placed.groupBy("key", "component").agg(F.sum("weight").alias("w"))
    keys = each.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("all"), F.max(F.struct("w", "component")).alias("most")).filter("n > 1")
    blocks = lambda w: F.greatest(F.ceil(w / block), F.lit(1)).cast("int")
    keys = keys.select("key", F.col("most.component").alias("largest"), blocks(F.col("all") - F.col("most.w")).alias("few"), blocks(F.col("most.w")).alias("many"))
    large = F.col("component") == F.col("largest")
    own = F.when(large, F.col("few") + F.pmod(F.xxhash64("id"), "many")).otherwise(F.pmod(F.xxhash64("id"), "few")).cast("int")
    others = F.when(large, F.sequence(F.lit(0), F.col("few") - 1)).otherwise(F.sequence(F.lit(0), F.col("few") + F.col("many") - 1))
    out = placed.join(keys, "key").select("key", own.alias("own"), F.explode(others).alias("other"), "id", "component")
    side = ((F.col("own") > F.col("other")).cast("int")).alias("side")
    return out.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), side, "id", "component")


def star_groups(pairs: DataFrame, block: int) -> DataFrame:
    """The groups of pairs(a, b): b against so many a at once. Each a is its own component, b another."""
    size = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("a"), "parts").cast("int")
    zero = F.lit(0)
    rim = pairs.join(size, "b").select(F.col("b").alias("key"), part.alias("i"), zero.alias("j"), F.lit(1).alias("side"), F.col("a").alias("id"), F.col("a").alias("component"))
    hub = size.select(F.col("b").alias("key"), F.explode(F.sequence(zero, F.col("parts") - 1)).alias("i"), zero.alias("j"), zero.alias("side"), F.col("b").alias("id"), F.col("b").alias("component"))
    return rim.unionByName(hub)


def links_in(groups: DataFrame, link: Callable[[pa.Table], tuple[pa.Array, pa.Array]], kind: str = "bigint") -> DataFrame:
    """a and b, of the type kind: what link() finds in each group; it gets the group's rows with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            at = np.array([batch.column(c).to_numpy() for c in GROUP])
            edges = [0, *(np.flatnonzero((at[:, 1:] != at[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for s, e in zip(edges, edges[1:]):
                this = tuple(at[:, s].tolist())
                if held and this != last:
                    yield pa.RecordBatch.from_arrays(list(link(pa.Table.from_batches(held).combine_chunks())), names=["a", "b"])
                    held = []
                held.append(batch.slice(s, e - s))
                last = this
        if held:
            yield pa.RecordBatch.from_arrays(list(link(pa.Table.from_batches(held).combine_chunks())), names=["a", "b"])

    return groups.repartition(*GROUP).sortWithinPartitions(*GROUP).mapInArrow(run, f"a {kind}, b {kind}")


def sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """The rows of each side; of a block that meets itself, all rows twice."""
    side = table.column("side").to_numpy()
    left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    return left, left if table.column("i")[0] == table.column("j")[0] and not len(right) else right


class Joined:
    """The components of a group's rows, while links are found."""

    def __init__(self, component: list):
        number: dict = {}
        self.label = np.array([number.setdefault(c, len(number)) for c in component], np.int64)
        self.at: list[tuple[int, int]] = []

    def join(self, x: int, y: int) -> None:
        """Row x is linked with row y."""
        if (a := self.label[x]) != (b := self.label[y]):
            self.label[self.label == max(a, b)] = min(a, b)
            self.at.append((x, y))


def weight(size: Column, least: int) -> Column:
    return (size + F.lit(least)).cast("bigint")
