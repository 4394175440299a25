"""Window frames over ordered streams, one specification for all columns of an operator so that they share a sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql.window import Window, WindowSpec

Names = Sequence[str]


def ordered(keys: Names, order: Names) -> WindowSpec:
    if not keys:
        raise ValueError("a stream needs a key: a running window without one gathers all rows in one task")
    return Window.partitionBy(*keys).orderBy(*order)


def upto(keys: Names, order: Names) -> WindowSpec:
    """All rows of the stream up to this one: an operator's value after its update."""
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def prior(keys: Names, order: Names) -> WindowSpec:
    """All rows before this one: an operator's value before its update."""
    return ordered(keys, order).rowsBetween(Window.unboundedPreceding, -1)


def last(keys: Names, order: Names, rows: int) -> WindowSpec:
    """The last so many rows, this one included."""
    if rows < 1:
        raise ValueError("a window has at least one row")
    return ordered(keys, order).rowsBetween(1 - rows, Window.currentRow)


def over(c: Column, frame: WindowSpec | None) -> Column:
    """An aggregate over a frame, or over the group at hand where frame is None."""
    return c if frame is None else c.over(frame)
