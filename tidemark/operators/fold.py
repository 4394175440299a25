"""The keyed fold: operators whose next state depends on the last one, the same step for batches and streams.

A step holds its parameters and makes states; step(state, row) changes the state it is given and returns an output tuple, or raises
Reject, which leaves the state as it was. In a batch, partitions are sorted by key and order, and a task carries the state from row
to row and from one Arrow batch to the next, so that a key of any length takes the memory of a batch; a stream keeps each key's
state in the state store. Streams are parallel by key: a key's fold is sequential by its nature.
"""

from __future__ import annotations

import copy
import pickle
from collections.abc import Iterator, Mapping, Sequence
from typing import Any, Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql.types import StructType


class Reject(Exception):
    """The row can't be used; the state stays."""


class Step(Protocol):
    out: str

    def init(self) -> Any: ...

    def step(self, state: Any, row: Any) -> tuple | None: ...


def _taken(step: Step, state: Any, row: Any) -> tuple[Any, tuple | None]:
    """The state after a row, and the row's output; as before and None for a row that is rejected."""
    trial = copy.deepcopy(state) if getattr(step, "fragile", False) else state
    try:
        got = step.step(trial, row)
    except Reject:
        return state, None
    return trial, got


def fold_rows(step: Step, state: Any, rows: pd.DataFrame) -> tuple[Any, list[tuple]]:
    """The state after rows, and each row's output with its index among rows."""
    out = []
    for i, row in enumerate(rows.itertuples(index=False)):
        state, got = _taken(step, state, row)
        if got is not None:
            out.append((i, *got))
    return state, out


def _schemas(df: DataFrame, step: Step, keys: Sequence[str], order: Sequence[str]) -> tuple[StructType, list[str]]:
    made = StructType.fromDDL(step.out)
    kept = [f for f in df.schema if f.name in (*keys, *order)]
    return StructType([*kept, *made]), [f.name for f in made]


def _framed(rows: pd.DataFrame, out: list[tuple], kept: list[str], made: list[str]) -> pd.DataFrame:
    left = rows[kept].iloc[[x[0] for x in out]].reset_index(drop=True)
    right = pd.DataFrame([x[1:] for x in out], columns=made, dtype=object)
    return pd.concat([left, right], axis=1)


def dealt(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of a key in one of as many partitions as spark.sql.shuffle.partitions says.

    Without the number Spark merges partitions by their compressed bytes, which tell neither what a sort takes nor what a step costs.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def run_batch(df: DataFrame, step: Step, keys: Sequence[str], order: Sequence[str], more: Mapping[str, Column] | None = None, final: bool = False) -> DataFrame:
    """keys, order and the step's output for each row that it doesn't reject, or (final) for the last such row of each key.

    more: further columns for the step, added after the sort so that they are neither exchanged nor sorted. A window over the same keys
    before the fold leaves its own exchange, and Spark drops the fold's: its input should be dealt too.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema, made = _schemas(df, step, keys, order)
    arrow = to_arrow_schema(schema)
    kept = schema.names[: len(schema) - len(made)]

    def framed(rows: list[pa.Array], out: list[tuple]) -> pa.RecordBatch:
        columns = zip(*out) if out else [[]] * len(made)
        rows = rows + [pa.array(list(c), arrow.field(n).type, from_pandas=True) for n, c in zip(made, columns)]
        return pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(rows, arrow)], schema=arrow)

    def picked(batch: pa.RecordBatch, at: list[int]) -> list[pa.Array]:
        return [batch.column(k).take(pa.array(at, pa.int64())) for k in kept]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = state = held = place = None  # final: the key's output so far, and its row in the batch, or None where that lies in held_row
        held_row: list[pa.Array] = []
        for batch in batches:
            at, out, first = [], [], None
            of = zip(*(batch.column(k).to_pylist() for k in keys))
            for i, (own, row) in enumerate(zip(of, batch.to_pandas().itertuples(index=False))):
                if state is None or own != key:
                    if held is not None:
                        out.append(held)
                        if place is None:
                            first = held_row
                        else:
                            at.append(place)
                    key, state, held = own, step.init(), None
                state, got = _taken(step, state, row)
                if got is not None and final:
                    held, place = got, i
                elif got is not None:
                    at.append(i)
                    out.append(got)
            rows = picked(batch, at)
            if first is not None:
                rows = [pa.concat_arrays(x) for x in zip(first, rows)]
            if held is not None and place is not None:
                held_row, place = picked(batch, [place]), None
            yield framed(rows, out)
        if held is not None:
            yield framed(held_row, [held])

    return dealt(df, keys).sortWithinPartitions(*keys, *order).withColumns(dict(more or {})).mapInArrow(fold, schema)


def run_stream(df: DataFrame, step: Step, keys: Sequence[str], order: Sequence[str], late: str = "reject") -> DataFrame:
    """As run_batch over a stream. Rows of a micro-batch are sorted; rows at or before the last order seen are left out (late)."""
    from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

    if late not in ("reject", "accept"):
        raise ValueError("late is reject or accept")
    schema, made = _schemas(df, step, keys, order)
    kept = [f.name for f in schema][: len(schema) - len(made)]

    class Fold(StatefulProcessor):
        def init(self, handle: StatefulProcessorHandle) -> None:
            self.state = handle.getValueState("state", "value binary")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
            batch = pd.concat(list(rows)).sort_values(list(order), kind="stable")
            state, last = pickle.loads(self.state.get()[0]) if self.state.exists() else (step.init(), None)
            if late == "reject" and last is not None:
                at = batch[list(order)].apply(tuple, axis=1)
                batch = batch[[x > last for x in at]]
            state, out = fold_rows(step, state, batch)
            if len(batch):
                last = tuple(batch[list(order)].iloc[-1])
            self.state.update((pickle.dumps((state, last)),))
            yield _framed(batch, out, kept, made)

        def close(self) -> None:
            pass

    return df.groupBy(*keys).transformWithStateInPandas(statefulProcessor=Fold(), outputStructType=schema, outputMode="Append", timeMode="None")
