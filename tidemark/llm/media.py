"""Media columns in ISO media containers.

A payload is stored as 8-bit mono samples in one track of a container; a media column is read by walking its nested boxes and
decoding the sample tables alone: codec, time scale, duration, and the byte ranges of keyframes (sync samples), without touching
the media data. read_payload() follows the same tables to get the samples back.

Null texts count as empty; a payload is padded with bytes 0 to a positive multiple of 64. Equal texts give equal containers. A
column that holds no container, or a damaged one, has null features and an error. Further columns are kept by
describe_media(), but for those named as its own, which give way.
An empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from . import common

UNIT, RATE, CHUNK = 64, 8000, 1 << 16
#: Boxes nested deeper are an error.
DEEPEST = 32
#: The boxes of the container format that hold other boxes.
CONTAINERS = {"moov", "trak", "mdia", "minf", "dinf", "stbl", "edts", "udta", "mvex", "moof", "traf"}


def box(kind: str, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind.encode()) + body


def full(kind: str, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(text: str) -> tuple[int, bytes]:
    """The text's bytes and their number, with bytes 0 up to a positive multiple of UNIT."""
    data = text.encode("utf-8", "surrogatepass")
    return len(data), data + bytes(-len(data) % UNIT or (0 if data else UNIT))


def encode(payload: bytes, rate: int = RATE, chunk: int = CHUNK) -> bytes:
    """A container with the payload as unsigned 8-bit mono samples, in chunks."""
    n, chunks = len(payload), max(1, -(-len(payload) // chunk))
    last = n - (chunks - 1) * chunk
    matrix = struct.pack(">9I", 1 << 16, 0, 0, 0, 1 << 16, 0, 0, 0, 1 << 30)
    entry = box("raw ", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, rate << 16))
    runs = [(1, min(chunk, last) if chunks == 1 else chunk, 1)] + ([(chunks, last, 1)] if chunks > 1 and last != chunk else [])
    head = box("ftyp", b"qt  ", struct.pack(">I", 0), b"qt  ")

    def moov(base: int) -> bytes:
        at = [base + i * chunk for i in range(chunks)]
        offsets = full("co64", struct.pack(f">I{chunks}Q", chunks, *at)) if base + n >= 1 << 32 else full("stco", struct.pack(f">I{chunks}I", chunks, *at))
        stbl = box(
            "stbl",
            full("stsd", struct.pack(">I", 1), entry),
            full("stts", struct.pack(">III", 1, n, 1)),
            full("stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            full("stsz", struct.pack(">II", 1, n)),
            offsets,
        )
        minf = box("minf", full("smhd", bytes(4)), box("dinf", full("dref", struct.pack(">I", 1), full("url ", flags=1))), stbl)
        mdia = box("mdia", full("mdhd", struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0)), full("hdlr", bytes(4), b"soun", bytes(12), b"\0"), minf)
        tkhd = full("tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), matrix, bytes(8), flags=7)
        mvhd = full("mvhd", struct.pack(">IIIIIH", 0, 0, rate, n, 1 << 16, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box("moov", mvhd, box("trak", tkhd, mdia))

    base = len(head) + len(moov(0)) + 8
    body = moov(base)
    base = len(head) + len(body) + 8  # a long file's offset table is wider
    return head + moov(base) + struct.pack(">I4s", 8 + n, b"mdat") + payload


def walk(data: bytes) -> Iterator[tuple[tuple[str, ...], int, int]]:
    """Each box: the path of kinds, and where its body starts and ends; nested ones after the box that holds them."""
    open_: list[tuple[tuple[str, ...], int, int]] = [((), 0, len(data))]
    while open_:
        path, at, end = open_.pop()
        if at + 8 > end:
            if at != end:
                raise ValueError(f"{end - at} bytes after the last box")
            continue
        size, kind = struct.unpack_from(">I4s", data, at)
        start = at + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, start)
            start += 8
        elif size == 0:
            size = end - at
        if size < start - at or at + size > end:
            raise ValueError(f"box {kind!r} at {at} ends outside of what holds it")
        if len(path) == DEEPEST:
            raise ValueError(f"boxes are nested more than {DEEPEST} deep")
        here = (*path, kind.decode("latin-1"))
        yield here, start, at + size
        open_.append((path, at + size, end))
        if here[-1] in CONTAINERS:
            open_.append((here, start, at + size))


@dataclass
class Track:
    """One track's sample tables; sizes is one number where all samples are alike."""

    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    samples: int = 0
    sizes: int | np.ndarray = 0
    per_chunk: np.ndarray = field(default_factory=lambda: np.empty((0, 3), np.int64))
    offsets: np.ndarray = field(default_factory=lambda: np.empty(0, np.int64))
    sync: np.ndarray | None = None
    times: np.ndarray = field(default_factory=lambda: np.empty((0, 2), np.int64))

    def chunk_samples(self) -> np.ndarray:
        """How many samples each chunk has."""
        first = self.per_chunk[:, 0] - 1
        return np.repeat(self.per_chunk[:, 1], np.diff(np.append(first, len(self.offsets))))

    def ranges(self, only_sync: bool = True) -> list[tuple[int, int]]:
        """Byte ranges: one of each marked sync sample; of all samples, if none are marked, those that touch as one."""
        n = self.chunk_samples()
        if int(n.sum()) != self.samples:
            raise ValueError("the chunks don't hold the samples")
        first = np.cumsum(n) - n
        alike = isinstance(self.sizes, int)
        before = None if alike else np.concatenate([[0], np.cumsum(self.sizes)])
        if only_sync and self.sync is not None:
            sample = self.sync - 1
            if len(sample) and not 0 <= sample.min() <= sample.max() < self.samples:
                raise ValueError("a sync sample is none of the samples")
            chunk = np.searchsorted(first, sample, "right") - 1
            inside = (sample - first[chunk]) * self.sizes if alike else before[sample] - before[first[chunk]]
            lengths = np.full(len(sample), self.sizes, np.int64) if alike else self.sizes[sample]
            return list(zip((self.offsets[chunk] + inside).tolist(), lengths.tolist()))
        lengths = n * self.sizes if alike else before[first + n] - before[first]
        out: list[tuple[int, int]] = []
        for s, m in zip(self.offsets.tolist(), lengths.tolist()):
            if out and sum(out[-1]) == s:
                out[-1] = (out[-1][0], out[-1][1] + m)
            elif m:
                out.append((s, m))
        return out

    def seconds(self) -> float | None:
        """The header's duration; that of the samples where it has none."""
        ticks = self.duration or int((self.times[:, 0] * self.times[:, 1]).sum())
        return ticks / self.timescale if self.timescale else None


def tracks(data: bytes) -> list[Track]:
    """The tracks of a container, from its sample tables alone."""
    found: list[Track] = []
    table = lambda at, n, k, width=4: np.frombuffer(data, f">u{width}", n * k, at).astype(np.int64).reshape(n, k)
    for path, start, end in walk(data):
        kind = path[-1]
        if kind == "moof":
            raise ValueError("fragmented: sample tables of fragments are not read")
        if kind == "trak":
            found.append(Track())
        if "trak" not in path or not found or kind in CONTAINERS:
            continue
        t, body = found[-1], start + 4
        count = struct.unpack_from(">I", data, body)[0] if end - body >= 4 else 0
        if kind == "mdhd":
            t.timescale, t.duration = struct.unpack_from(">16xIQ" if data[start] == 1 else ">8xII", data, body)
        elif kind == "hdlr":
            t.handler = data[body + 4 : body + 8].decode("latin-1")
        elif kind == "stsd":
            t.codec = data[body + 8 : body + 12].decode("latin-1")
        elif kind == "stts":
            t.times = table(body + 4, count, 2)
        elif kind == "stss":
            t.sync = table(body + 4, count, 1)[:, 0]
        elif kind == "stsc":
            t.per_chunk = table(body + 4, count, 3)
        elif kind == "stsz":
            t.samples = struct.unpack_from(">I", data, body + 4)[0]
            t.sizes = count if count else table(body + 8, t.samples, 1)[:, 0]
        elif kind == "stz2":
            bits, t.samples = data[body + 3], struct.unpack_from(">I", data, body + 4)[0]
            if bits == 4:
                both = np.frombuffer(data, np.uint8, (t.samples + 1) // 2, body + 8)
                t.sizes = np.stack([both >> 4, both & 15], 1).reshape(-1)[: t.samples].astype(np.int64)
            else:
                t.sizes = table(body + 8, t.samples, 1, bits // 8)[:, 0]
        elif kind in ("stco", "co64"):
            t.offsets = table(body + 4, count, 1, 8 if kind == "co64" else 4)[:, 0]
    return found


def describe(data: bytes | None) -> dict:
    """codec, timescale, duration (s) and keyframe ranges of the first video track, or the first of any kind; tracks: of all.

    error tells why there are none: no container, a damaged one, boxes nested too deep, or samples in fragments.
    """
    try:
        found = tracks(data or b"")
        rows = [{"codec": t.codec, "handler": t.handler, "timescale": t.timescale, "duration": t.seconds(), "samples": t.samples, "keyframes": t.ranges()} for t in found]
        return next((r for r in rows if r["handler"] == "vide"), rows[0]) | {"tracks": rows, "error": None}
    except (IndexError, ValueError, struct.error) as e:
        return dict.fromkeys(("codec", "handler", "timescale", "duration", "samples", "keyframes", "tracks")) | {"error": str(e) or type(e).__name__}


def read_payload(data: bytes) -> bytes:
    """All samples of the first track, found by its tables."""
    return b"".join(data[s : s + n] for s, n in tracks(data)[0].ranges(only_sync=False))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the media column of docs(doc_id, text)."""
    common.small_batches(common.session(docs))

    def made(texts: list[str]) -> dict:
        both = [padded(t) for t in texts]
        return {"n_bytes": [n for n, _ in both], "media": [encode(p) for _, p in both]}

    schema = "doc_id bigint, n_bytes bigint, media binary"
    return common.plain(docs, "doc_id", "text").mapInArrow(common.over_texts(made, ["doc_id"], schema), schema)


def describe_media(df: DataFrame, media: str = "media") -> DataFrame:
    """df with what describe() gives, codec to error, in place of its media column."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    track = "codec{0} string, handler{0} string, timescale{0} bigint, duration{0} double, samples{0} bigint, keyframes{0} array<struct<offset:bigint,length:bigint>>"
    own = StructType.fromDDL(f"{track.format('')}, tracks array<struct<{track.format(':')}>>, error string")
    df = df.drop(*own.names)
    names = [c for c in df.columns if c != media]
    # Names that Python workers' columns can't have come back at the end.
    plain = df.toDF(*("media" if c == media else f"c{i}" for i, c in enumerate(df.columns)))
    rest = [f for f in plain.schema if f.name != "media"]
    schema = StructType([*rest, *own])
    arrow = to_arrow_schema(schema)

    def run(batches):
        for b in batches:
            seen = [describe(x) for x in b.column("media").to_pylist()]
            for x in seen:
                for t in [x, *(x["tracks"] or ())]:
                    t["keyframes"] = t["keyframes"] and [{"offset": o, "length": n} for o, n in t["keyframes"]]
            columns = [b.column(f.name) for f in rest] + [pa.array([x[f.name] for x in seen], arrow.field(f.name).type) for f in own]
            yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    return plain.mapInArrow(run, schema).toDF(*names, *own.names)


def feature(x: dict) -> str:
    return x["error"] or f"codec={x['codec']};timescale={x['timescale']};duration={x['duration']:.6f};samples={x['samples']};keyframes=" + ",".join(f"{o}+{n}" for o, n in x["keyframes"])


def query(spark, sf_dir: str) -> DataFrame:
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    schema = "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def digests(batches):
        for b in batches:
            rows = []
            for doc_id, n, data in zip(b.column("doc_id").to_pylist(), b.column("n_bytes").to_pylist(), b.column("media").to_pylist()):
                payload = read_payload(data)
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(describe(data))))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(arrow), arrow)], schema=arrow)

    return to_media(spark.read.parquet(f"{sf_dir}/documents.parquet")).mapInArrow(digests, schema)
