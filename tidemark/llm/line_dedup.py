"""Near-duplicate lines by a segment-partition join on edit distance.

A line of length l may differ from another in threshold(l) edits (of the shorter line's length). It is split into one segment more
than that, so that a line within the threshold holds at least one segment unchanged, and near its place. Shorter lines put their
segments into an index by length, place and content; longer lines look up only the substrings that the edits before and after a
segment leave room for. Both come from one pass over the texts and meet in one exchange, where a key's index rows stand before those
that look it up. A 64-bit odd sketch of character pairs goes with each row: an edit changes four pairs at most, so lines whose
sketches differ in more bits need no look, without loss. What remains is verified by banded bit-parallel edit distance.

Links are transitive, so not all pairs on a segment are needed: each line that finds a segment is held against the least line of the
index there. Where the index has several lines for a segment and its lines are still in different components, they are compared in
blocks (blocks.py); pairs never become rows. Of each class of lines the first occurrence, by doc_id and line number, stays.

Lines are compared without the blanks around them; lines without a word are left alone. Equal lines are found by 128-bit hashes.
Null texts have no lines and stay null. Null doc_ids come first. In line_table(), rows with equal doc_id and line number count as
one occurrence; drop_lines() tells rows of one doc_id (or of none) apart by their texts. An empty table gives an empty table. A text
all of whose lines go becomes empty, its row stays. Further columns are kept by drop_lines().
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, common
from .components import components
from .near_dedup import mixed

#: Edits allowed: none below CHARS_PER_EDIT characters, then one for each so many, up to MOST_EDITS (the operators' default).
MOST_EDITS, CHARS_PER_EDIT = 2, 16
PAIRS_PER_EDIT = 4
MOST_BROADCAST = 1_000_000
#: Characters in a block, where a line counts LEAST_WEIGHT more than it has; lines that are held against one at once.
BLOCK, LEAST_WEIGHT, STAR = 200_000, 64, 1024
#: Characters whose segments are hashed at once; ids that a task remembers to send a line once; rows of keys in an Arrow batch.
CHUNK, MOST_SEEN, KEY_ROWS = 1 << 18, 1 << 20, 100_000
#: Stands for a null doc_id where rows are ordered and joined.
NO_ID = -(1 << 63)

_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)


def threshold(length: int, edits: int = MOST_EDITS) -> int:
    return min(edits, length // CHARS_PER_EDIT)


_BIT = np.uint64(1) << np.arange(64, dtype=np.uint64)
#: What stands for a character of the basic plane in sums.
_POINT = mixed(np.arange(1 << 16, dtype=np.uint64) + np.uint64(1 << 32))
_made: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """The powers 0 to n of a number; those that a chunk needs are made once."""
    if n >= len(_made.get(base, ())):
        made = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(max(n, CHUNK), base, np.uint64))])
        if n > 2 * CHUNK:
            return made[: n + 1]
        _made[base] = made
    return _made[base][: n + 1]


def _points(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lines' lengths and their code points, one after the other."""
    return np.fromiter(map(len, lines), np.int64, len(lines)), np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), "<u4")


def _sums(points: np.ndarray) -> np.ndarray:
    """Running sums of which any substring's hash is a difference."""
    each = _POINT[points] if not len(points) or points.max() < len(_POINT) else mixed(points + np.uint64(1 << 32))
    each *= _powers(_BASE, len(points))[:-1]
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(each, out=sums[1:])
    return sums


def segment_keys(lines: list[str], edits: int = MOST_EDITS, index: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Keys of lines, and the number of each key's line.

    index: a line's own segments, under which lines that are as long or longer find it. Else the substrings that may be a segment of
    a line that is as long or shorter. Substrings are hashed by differences of running sums, so each costs the same at any length.
    """
    n, points = _points(lines)
    return _segments(n, _sums(points), edits, index)


def _segments(n: np.ndarray, sums: np.ndarray, edits: int, index: bool) -> tuple[np.ndarray, np.ndarray]:
    first, back = np.cumsum(n) - n, _powers(_BACK, len(sums) - 1)
    keys, of = [np.empty(0, np.uint64)], [np.empty(0, np.int64)]
    for more in range(1 if index else edits + 1):
        shorter = n - more
        allowed = np.minimum(edits, shorter // CHARS_PER_EDIT)
        for k in range(max(1, more), edits + 1):
            line = np.flatnonzero(allowed == k)
            length, longest = shorter[line], n[line]
            short, longer = np.divmod(length, k + 1)  # the longer segments come last
            for i in range(k + 1 if len(line) else 0):
                size = short + (i >= k + 1 - longer)
                start = i * short + np.maximum(0, i - (k + 1 - longer))
                # At most i edits come before segment i of the first that match, at most k - i after it.
                for shift in [0] if index else range(max(-i, more - (k - i)), min(i, more + k - i) + 1):
                    at = start + shift
                    fits = (at >= 0) & (at + size <= longest)
                    s, e = first[line[fits]] + at[fits], first[line[fits]] + at[fits] + size[fits]
                    keys.append(mixed((sums[e] - sums[s]) * back[s] ^ mixed(length[fits].astype(np.uint64) * np.uint64(64) + np.uint64(i + 1))))
                    of.append(line[fits])
    return np.concatenate(keys).view(np.int64), np.concatenate(of)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_id(line: str) -> int:
    """Tells lines apart in the search for candidates."""
    return _signed(xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass"), 7))


def line_hash(line: str) -> bytes:
    """Lines with equal hashes count as equal."""
    return xxhash.xxh3_128_digest(line.encode("utf-8", "surrogatepass"), 7)


def pair_sketches(lines: list[str]) -> np.ndarray:
    """For each line 64 bits, of which each pair of neighbouring characters flips one."""
    return _sketches(*_points(lines))


def _sketches(n: np.ndarray, points: np.ndarray) -> np.ndarray:
    low = points.astype(np.uint16)  # the bits that are read depend on no others
    bit = (low[:-1] * np.uint16(0x79B1) + low[1:] * np.uint16(0xCA6B)) >> np.uint16(7) & np.uint16(63)
    flips = np.zeros(len(points) + 1, np.uint64)
    flips[: len(bit)] = _BIT[bit]
    ends = np.cumsum(n)
    flips[ends[n > 0] - 1] = 0  # a line's last character has no neighbour
    return np.where(n > 0, np.bitwise_xor.reduceat(flips, ends - n), np.uint64(0)).view("<i8")


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most k: bit-parallel, in a band of 2 k + 1 diagonals around the main one."""
    if len(a) > len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if m - n > k:
        return False
    s = 0
    while s < n and a[s] == b[s]:
        s += 1
    while n > s and a[n - 1] == b[m - 1]:
        n, m = n - 1, m - 1
    a, b = a[s:n], b[s:m]
    n, m = len(a), len(b)
    if not n or not k:
        return m <= k
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << i
    # Bit x of a column's window stands for row j - k + x (rows and columns from 1), so that the next column's is shifted by one.
    # plus and minus: where a step down a row adds or takes one. Rows from 0 down are as row 0: each column adds one there.
    full = (1 << 2 * k + 1) - 1
    plus, minus, value = full >> k + 1 << k + 1, 0, 0
    for j, c in enumerate(b, 1):
        plus, minus = plus >> 1 | 1 << 2 * k, minus >> 1
        same, up = rows.get(c, 0), j - k - 1
        same = (same >> up if up >= 0 else same << -up) & full
        free = ((((same & plus) + plus) ^ plus) | same | minus) & full  # a step down and right costs nothing
        adds, takes = (minus | ~(free | plus)) & full, free & plus  # what a step right does
        if j <= n:
            value += 1 - (free >> k & 1)
            if value - (m - n) > k:
                return False
        else:
            x = n - j + k
            value += (adds >> x & 1) - (takes >> x & 1)
        adds = adds << 1 | 1
        plus, minus = (takes << 1 | ~(free | adds)) & full, free & adds & full
    return value <= k


def _long_lines(texts: list[str | None]) -> Iterator[str]:
    """The lines that others may be near to."""
    for text in texts:
        for line in (text or "").split("\n"):
            line = line.strip(common.BLANKS)
            if len(line) >= CHARS_PER_EDIT:
                yield line


def _keyed(docs: DataFrame, edits: int) -> DataFrame:
    """key, id and sketch of the lines of docs(text); a line that recurs in a partition is sent once, as a rule.

    The key's last bit is 0 for the index, 1 for a line that looks it up; the other 63 are the segment's.
    """

    def rows(lines: dict[int, str]) -> pa.RecordBatch:
        n, points = _points(list(lines.values()))
        sums, ids, sketches = _sums(points), np.array(list(lines), np.int64), _sketches(n, points)
        found = [_segments(n, sums, edits, index) for index in (True, False)]
        key, of = np.concatenate([key & -2 | probe for probe, (key, _) in enumerate(found)]), np.concatenate([of for _, of in found])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (key, ids[of], sketches[of])], names=["key", "id", "sketch"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new, chars = {}, 0
            for line in _long_lines(batch.column("text").to_pylist()):
                if (i := line_id(line)) not in seen:
                    seen.add(i)
                    new[i] = line
                    chars += len(line)
                    if chars >= CHUNK:
                        yield rows(new)
                        new, chars = {}, 0
            if new:
                yield rows(new)
            if len(seen) > MOST_SEEN:
                seen.clear()

    return docs.select("text").mapInArrow(run, "key bigint, id bigint, sketch bigint")


def _meet(edits: int):
    """For rows of _keyed() in the order of their keys: the least line of the index under each key, for those that look it up.

    near: the sketches allow a link with it. many: the index has others there. Rows with neither are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # segment, least id, its sketch and largest id of the index rows of the segment that the last batch ended with
        for batch in batches:
            if not batch.num_rows:
                continue
            key, ids, sketch = (batch.column(c).to_numpy() for c in ("key", "id", "sketch"))
            segment, probe = key >> 1, (key & 1).astype(bool)
            edge = np.concatenate([[True], segment[1:] != segment[:-1]])
            starts, of = np.flatnonzero(edge), np.cumsum(edge) - 1
            lead = np.minimum.reduceat(np.where(probe, np.iinfo(np.int64).max, ids), starts)
            last = np.maximum.reduceat(np.where(probe, np.iinfo(np.int64).min, ids), starts)
            there = ~probe[starts]  # index rows stand first
            x = np.zeros(len(starts), np.int64)
            least = np.flatnonzero(~probe & (ids == lead[of]))
            x[of[least]] = sketch[least]
            if held and held[0] == segment[0]:
                if held[1] <= lead[0]:
                    lead[0], x[0] = held[1:3]
                last[0], there[0] = max(held[3], last[0]), True
            held = (segment[-1], lead[-1], x[-1], last[-1]) if there[-1] else None
            at = np.flatnonzero(probe & there[of])
            of = of[at]
            near = (np.bitwise_count((sketch[at] ^ x[of]).view(np.uint64)) <= PAIRS_PER_EDIT * edits) & (ids[at] != lead[of])
            many = lead[of] < last[of]
            kept = near | many
            if kept.any():
                at, of = at[kept], of[kept]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (segment[at], ids[at], lead[of], near[kept], many[kept])], names=["key", "id", "lead", "near", "many"])

    return run


def _line_links(edits: int):
    def link(table: pa.Table) -> tuple[pa.Array, pa.Array]:
        """Links that join components among a group's lines, verified by their edit distance; the nearest sketches first."""
        left, right = blocks.sides(table)
        lines, ids = table.column("line").to_pylist(), table.column("hash").to_pylist()
        n, sketch = np.array([len(x) for x in lines]), pair_sketches(lines).view(np.uint64)
        allowed = np.minimum(edits, n // CHARS_PER_EDIT)
        joined = blocks.Joined(table.column("component").to_pylist())
        for at, x in enumerate(left.tolist()):
            y = right[at + 1 :] if left is right else right
            y = y[joined.label[y] != joined.label[x]]
            k, flips = np.minimum(allowed[x], allowed[y]), np.bitwise_count(sketch[y] ^ sketch[x])
            near = (np.abs(n[y] - n[x]) <= k) & (flips <= PAIRS_PER_EDIT * k) & (k > 0)
            y, flips = y[near], flips[near]
            y = y[np.argsort(flips, kind="stable")]
            while len(y):
                if within(lines[x], lines[y[0]], int(min(allowed[x], allowed[y[0]]))):
                    joined.join(x, int(y[0]))
                    y = y[joined.label[y] != joined.label[x]]
                else:
                    y = y[1:]
        return tuple(pa.array([ids[pair[side]] for pair in joined.at], pa.binary()) for side in (0, 1))

    return link


def near_lines(docs: DataFrame, edits: int = MOST_EDITS) -> DataFrame:
    """node and component, by line_hash(), of the lines of docs(text) that are linked with others that differ from them."""
    if edits < 1:
        raise ValueError(f"at least one edit is allowed, not {edits}")
    spark = common.session(docs)
    common.small_batches(spark)
    rows = _keyed(docs, edits).repartition(F.shiftright("key", 1)).sortWithinPartitions("key")
    with common.batches_of(spark, KEY_ROWS):
        met = common.stored(rows.mapInArrow(_meet(edits), "key bigint, id bigint, lead bigint, near boolean, many boolean"), "line-met")
    pairs = met.filter("near").select(F.greatest("id", "lead").alias("a"), F.least("id", "lead").alias("b")).distinct()
    members = met.filter("many").select("key", "id").distinct()
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(members.select("id"))
    ids = common.stored(ids.distinct(), "line-ids")

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = list(dict.fromkeys(_long_lines(batch.column("text").to_pylist())))
            columns = [pa.array([line_id(x) for x in got], pa.int64()), pa.array([line_hash(x) for x in got], pa.binary()), pa.array(got, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "hash", "line"])

    few = ids.count() <= MOST_BROADCAST
    texts = docs.select("text").mapInArrow(lines, "id bigint, hash binary, line string").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    texts = common.stored(texts.dropDuplicates(["hash"]), "line-texts")
    found_in = lambda groups: common.stored(blocks.links_in(groups.join(texts, "id"), _line_links(edits), "binary"), "line-links")

    links = found_in(blocks.star_groups(pairs, STAR))
    found = components(links)
    label = found.join(texts.select("id", F.col("hash").alias("node")), "node").select(F.col("id").alias("node"), F.xxhash64("component").alias("component"))
    weights = texts.select("id", blocks.weight(F.length("line"), LEAST_WEIGHT).alias("weight"))
    more = found_in(blocks.open_groups(members.join(weights, "id"), label, BLOCK))
    if more.limit(1).count():
        found = components(links.unionByName(more))
    for df in (met, ids, texts, links, more):
        common.discard(df)
    return found


def _row_hash() -> Column:
    """What tells the rows of one doc_id apart."""
    return F.xxhash64(F.col("text").cast("string"))


def line_table(docs: DataFrame, by_row: bool = False, edits: int = MOST_EDITS) -> DataFrame:
    """doc_id (NO_ID for null), line (from 0), id, and near and kept, of each line with a word of docs(doc_id, text).

    by_row: with a further column, row, the hash of the text, so that rows that share a doc_id are rows of their own.
    edits: the most edits between linked lines, of which one is allowed for each CHARS_PER_EDIT characters.
    """
    common.small_batches(common.session(docs))
    row = [_row_hash().alias("row")] if by_row else []
    key = ["doc_id", "row"] if by_row else ["doc_id"]
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), *row, F.col("text").cast("string").alias("text"))

    def occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list = [[], [], []]
            for of, text in enumerate(batch.column("text").to_pylist()):
                for at, line in enumerate((text or "").split("\n")):
                    if line := line.strip(common.BLANKS):
                        out[0].append(of)
                        out[1].append(at)
                        out[2].append(line_hash(line))
            of = pa.array(out[0], pa.int64())
            keys = [batch.column(k).fill_null(NO_ID).take(of) for k in key]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(out[1], pa.int32()), pa.array(out[2], pa.binary())], names=[*key, "line", "id"])

    found = docs.mapInArrow(occurrences, ", ".join([*(f"{k} bigint" for k in key), "line int, id binary"]))
    found = common.stored(found, "line-occurrences")
    classes = near_lines(docs, edits)
    first = found.groupBy("id").agg(F.min(F.struct(*key, "line")).alias("first"))
    first = common.stored(first.join(classes.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("class"), "first"), "line-firsts")
    of_class = first.groupBy("class").agg(F.min("first").alias("class_first"))
    first = first.join(of_class, "class").select("id", "class_first", (F.col("first") != F.col("class_first")).alias("near"))
    at = F.struct(*key, "line")
    return found.join(first, "id").select(*key, "line", "id", "near", (at == F.col("class_first")).alias("kept"))


def drop_lines(docs: DataFrame, edits: int = MOST_EDITS) -> DataFrame:
    """docs with the texts of the lines that stay."""
    of, row, gone, at, parts = (common.free(docs, name) for name in ("of", "row_of", "gone", "at", "parts"))
    dropped = line_table(docs, True, edits).filter("NOT kept").groupBy(F.col("doc_id").alias(of), F.col("row").alias(row)).agg(F.collect_set("line").alias(gone))
    dropped = common.stored(dropped, "lines-gone")
    # Texts cross the join as their lines, so that each is split once.
    rest = [F.col(common.quoted(c)) for c in docs.columns if c != "text"]
    split = docs.select(*rest, F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias(at), _row_hash().alias(f"{at}_row"), F.split(F.col("text").cast("string"), "\n").alias(parts))
    joined = split.join(dropped, (F.col(at) == F.col(of)) & (F.col(f"{at}_row") == F.col(row)), "left")
    stay = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col(gone))
    lines = F.when(F.col(gone).isNull(), F.col(parts)).otherwise(F.transform(stay, lambda i: F.get(F.col(parts), i)))
    text = F.array_join(lines, "\n").alias("text")
    return joined.select(*(text if c == "text" else F.col(common.quoted(c)) for c in docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    """For each document: its lines with a word, how many go, how many of these for a line that isn't equal, and their numbers."""
    docs = common.plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    lines = line_table(docs).groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.sum((~F.col("kept")).cast("bigint")).alias("n_dropped"),
        F.sum((~F.col("kept") & F.col("near")).cast("bigint")).alias("n_near"),
        F.sort_array(F.collect_set(F.when(~F.col("kept"), F.col("line")))).alias("lines"),
    )
    ids = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias(c)
    return ids.join(lines, "doc_id", "left").select(F.nullif(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), zero("n_lines"), zero("n_dropped"), zero("n_near"), F.coalesce(F.array_join(F.transform("lines", lambda x: x.cast("string")), ","), F.lit("")).alias("dropped"))


SQL = r"""
WITH RECURSIVE o AS (SELECT doc_id, i AS line, trim(ls[i + 1], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t
  FROM (SELECT doc_id, ls, unnest(generate_series(0, len(ls) - 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents)) WHERE regexp_matches(ls[i + 1], '[^ \x09-\x0D]')),
u AS (SELECT t, length(t) AS n, least(2, length(t) // 16) AS k FROM (SELECT DISTINCT t FROM o)),
l AS (SELECT a.t AS a, b.t AS b FROM u a JOIN u b ON b.n BETWEEN a.n - 2 AND a.n + 2 AND a.t <> b.t WHERE abs(a.n - b.n) <= least(a.k, b.k) AND least(a.k, b.k) > 0
  AND levenshtein(a.t, b.t) <= least(a.k, b.k)),
r AS (SELECT a AS t, a AS node FROM l UNION SELECT r.t, l.b FROM r JOIN l ON l.a = r.node),
c AS (SELECT t, min(node) AS class FROM r GROUP BY t),
x AS (SELECT o.doc_id, o.line, o.t, coalesce(c.class, o.t) AS class FROM o LEFT JOIN c USING (t)),
f AS (SELECT doc_id, line, row_number() OVER (PARTITION BY class ORDER BY doc_id, line) = 1 AS kept, t <> first_value(t) OVER (PARTITION BY class ORDER BY doc_id, line) AS near FROM x)
SELECT d.doc_id, count(f.line) AS n_lines, CAST(coalesce(sum(CASE WHEN NOT f.kept THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_dropped, CAST(coalesce(sum(CASE WHEN NOT f.kept AND f.near THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_near,
  coalesce(string_agg(CASE WHEN NOT f.kept THEN CAST(f.line AS VARCHAR) END, ',' ORDER BY f.line), '') AS dropped
FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id GROUP BY d.doc_id
"""
