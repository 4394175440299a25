"""Versioned model states as JSON documents, and feature schemas with a stable hash."""

from __future__ import annotations

import hashlib
import json
import math
import struct
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The format's version, its largest document, and the limits of a schema.
FORMAT_VERSION, MOST_BYTES = 1, 64 << 20
MOST_FEATURES, MOST_TEXT, MOST_METADATA = 4096, 256, 64


def to_json(model: dict) -> str:
    text = json.dumps({"format_version": FORMAT_VERSION, "model": model}, allow_nan=False, sort_keys=True)
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("the snapshot is too large")
    return text


def from_json(text: str) -> dict:
    if len(text.encode()) > MOST_BYTES:
        raise ValueError("the snapshot is too large")
    got = json.loads(text)
    if not isinstance(got, dict) or got.get("format_version") != FORMAT_VERSION or "model" not in got:
        raise ValueError("not a snapshot of this version")
    return got["model"]


def snapshots(df: DataFrame, name: str = "snapshot") -> DataFrame:
    """df's rows as snapshot documents, without leaving the JVM."""
    return df.select(F.to_json(F.struct(F.lit(FORMAT_VERSION).alias("format_version"), F.struct(*df.columns).alias("model"))).alias(name))


def restored(df: DataFrame, schema: str, name: str = "snapshot") -> DataFrame:
    """The models in snapshot documents; another version is an error."""
    got = df.select(F.from_json(name, f"format_version int, model struct<{schema}>", {"mode": "FAILFAST"}).alias("s"))
    checked = F.when(F.col("s.format_version") == FORMAT_VERSION, True).otherwise(F.raise_error(F.lit("not a snapshot of this version")).cast("boolean"))
    return got.filter(checked).select("s.model.*")


def inspect(df: DataFrame, name: str = "snapshot") -> DataFrame:
    """version, n_weights, lo and hi of documents whose model has weights."""
    got = df.select(F.get_json_object(name, "$.format_version").cast("int").alias("version"), F.from_json(F.get_json_object(name, "$.model.weights"), "array<double>").alias("w"))
    return got.select("version", F.size("w").alias("n_weights"), F.array_min("w").alias("lo"), F.array_max("w").alias("hi"))


@dataclass(frozen=True)
class Feature:
    name: str
    unit: str = ""
    transform: str = ""
    lo: float | None = None
    hi: float | None = None
    metadata: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.name or any(len(x.encode()) > MOST_TEXT for x in (self.name, self.unit, self.transform)) or len(self.metadata) > MOST_METADATA:
            raise ValueError(f"feature {self.name!r} is out of bounds")
        if any(x is not None and not math.isfinite(x) for x in (self.lo, self.hi)) or (self.lo is not None and self.hi is not None and self.lo > self.hi):
            raise ValueError(f"feature {self.name!r} has no range")

    def holds(self, c: Column) -> Column:
        """Whether a value keeps to the feature's range."""
        out = c.isNotNull()
        if self.lo is not None:
            out = out & (c >= self.lo)
        return out & (c <= self.hi) if self.hi is not None else out


def schema_hash(version: int, features: list[Feature]) -> str:
    """SHA-256 over length-prefixed fields: equal for equal schemas, whatever wrote them."""
    if not features or len(features) > MOST_FEATURES or len({f.name for f in features}) < len(features):
        raise ValueError("a schema has features of different names, within its limit")
    text = lambda s: struct.pack(">Q", len(s.encode())) + s.encode()
    edge = lambda x: b"\0" if x is None else b"\1" + struct.pack(">d", x)
    out = b"tidemark-feature-schema\0" + struct.pack(">IQ", version, len(features))
    for f in features:
        out += text(f.name) + text(f.unit) + text(f.transform) + edge(f.lo) + edge(f.hi) + struct.pack(">Q", len(f.metadata))
        out += b"".join(text(k) + text(v) for k, v in sorted(f.metadata.items()))
    return hashlib.sha256(out).hexdigest()


def ensure_schema(got: str, expected: str) -> None:
    if got != expected:
        raise ValueError("the model was made for another feature schema")
