"""Near-duplicate documents by MinHash bands, odd sketches and exact confirmation.

A document's set holds its distinct shingles of five words. PERMUTATIONS MinHash samples of the set give BANDS keys of ROWS samples
each, and are folded into an odd sketch: a bitmap in which each sample flips one bit, so that the population count of two sketches'
XOR tells how many samples differ. Documents with equal sets form one class. Classes that share a band key are candidates; the
sketches drop those that are far from the threshold (so far that chance can't have put a link there), and full sets, made again
from the texts, confirm the rest.

Only components are asked for, so not all pairs in a bucket are: first each member is held against its bucket's least member. Buckets
whose members are all in one component by then are done. In the others, members that are in different components are held against
each other in blocks (blocks.py): sketches first, all at once; full sets for the pairs that pass, a pair in one of the buckets that it
shares alone. Pairs never become rows: a block's task returns links that join components. No bucket, class or component is gathered
in a task.

Chance of missing a link at the threshold itself: 5e-6 by the bands ((1 - 0.75^4)^32), 3e-7 by the sketches (five standard
deviations); less above it. Shingles are compared by 64-bit hashes.

Null, empty and blank texts have empty sets and are linked with nothing. Texts of fewer than five words have one shingle. Repeated
rows, and rows that share a doc_id, count as one document. Rows without a doc_id are linked with nothing: their component is null
and they aren't kept. An empty table gives an empty table. Further columns are kept by drop_near_duplicates().
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks, common
from .components import components

SHINGLE, PERMUTATIONS, BANDS, ROWS = 5, 128, 32, 4
#: A sketch has 64 times so many bits; a pair whose estimate is below LEAST_ESTIMATE isn't confirmed.
SKETCH_WORDS, LEAST_ESTIMATE = 8, 0.5
#: Linked are sets with 100 * intersection >= SIMILAR * union.
SIMILAR = 75
#: Shingles in a block, where a document counts LEAST_WEIGHT more than it has; members that are held against one at once.
BLOCK, LEAST_WEIGHT, STAR = 1_000_000, 200, 1024
#: So many pairs of a block are compared at once; shingles that are counted at once.
PAIRS, COLUMNS = 1 << 18, 2048
#: Ids are sent to all executors up to so many (16 MB); beyond it the texts are joined by a shuffle.
MOST_BROADCAST = 1_000_000

_M = np.uint64(0xBF58476D1CE4E5B9)
_N = np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * _M
    x = (x ^ (x >> np.uint64(27))) * _N
    return x ^ (x >> np.uint64(31))


def _numbers(seed: int, n: int) -> np.ndarray:
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed << 40))


_PLACE = _numbers(1, SHINGLE + 1) | np.uint64(1)
_FLIP, _TIMES = _numbers(2, PERMUTATIONS), _numbers(3, PERMUTATIONS) | np.uint64(1)
_BAND, _SAMPLE = _numbers(4, BANDS), _numbers(5, PERMUTATIONS)


def shingles(text: str) -> np.ndarray:
    """The set of a text, as sorted 64-bit hashes. bytes.lower() and bytes.split() keep to ASCII, as the word rule does."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.array(list(map(xxhash.xxh3_64_intdigest, words)), np.uint64)
    n = min(len(h), SHINGLE)
    total = np.full(len(h) - n + 1, n, np.uint64) * _PLACE[SHINGLE]
    for k in range(n):
        total += h[k : len(h) - n + 1 + k] * _PLACE[k]
    return np.unique(mixed(total))


def samples(s: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set that isn't empty."""
    least = np.full(PERMUTATIONS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(s), 512):
        np.minimum(least, ((s[at : at + 512, None] ^ _FLIP) * _TIMES).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    key = _BAND.copy()
    for k in range(ROWS):
        key = mixed(key ^ least[k::ROWS])
    return key.view(np.int64)


def odd_sketch(least: np.ndarray) -> np.ndarray:
    bit = mixed(least ^ _SAMPLE) % np.uint64(64 * SKETCH_WORDS)
    out = np.zeros(SKETCH_WORDS, np.uint64)
    np.bitwise_xor.at(out, (bit // np.uint64(64)).astype(np.int64), np.uint64(1) << bit % np.uint64(64))
    return out.view(np.int64)


def most_flipped(estimate: float = LEAST_ESTIMATE) -> int:
    """The population count of an XOR at which the estimated similarity is as low as this."""
    n, differ = 64 * SKETCH_WORDS, 2 * PERMUTATIONS * (1 - estimate)
    return int(n / 2 * (1 - (1 - 2 / n) ** differ))


def flipped(a: Column, b: Column) -> Column:
    """The population count of two sketches' XOR."""
    bits = [F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(SKETCH_WORDS)]
    return sum(bits[1:], bits[0])


def linked(x: np.ndarray, y: np.ndarray) -> bool:
    small, large = sorted((len(x), len(y)))
    if not small or 100 * small < SIMILAR * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * both >= SIMILAR * (len(x) + len(y) - both)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Which of left is linked with which of right: the sizes of all intersections, by products of membership tables."""
    size = [np.array([len(s) for s in side], np.int64) for side in (left, right)]
    both = np.intersect1d(*(np.unique(np.concatenate(side)) for side in (left, right)), assume_unique=True)
    shared = np.zeros((len(left), len(right)), np.int64)
    where = []  # row and column of each shingle that both sides have, by column
    for side in (left, right):
        flat, row = np.concatenate(side), np.repeat(np.arange(len(side)), [len(s) for s in side])
        at = np.searchsorted(both, flat)
        hit = at < len(both)
        hit[hit] = both[at[hit]] == flat[hit]
        order = np.argsort(at[hit], kind="stable")
        where.append((row[hit][order], at[hit][order]))
    for c in range(0, len(both), COLUMNS):
        tables = []
        for (row, at), side in zip(where, (left, right)):
            s, e = np.searchsorted(at, (c, c + COLUMNS))
            table = np.zeros((len(side), min(COLUMNS, len(both) - c)), np.float32)
            table[row[s:e], at[s:e] - c] = 1
            tables.append(table)
        shared += (tables[0] @ tables[1].T).astype(np.int64)  # exact: counts up to COLUMNS
    return 100 * shared >= SIMILAR * (size[0][:, None] + size[1][None, :] - shared)


def block_links(table: pa.Table) -> tuple[pa.Array, pa.Array]:
    """Links that join components among a group's rows: pairs of its sides whose sketches are near and whose full sets are linked."""
    left, right = blocks.sides(table)
    lists = lambda name: pc.list_flatten(table.column(name)).to_numpy().reshape(len(table), -1)
    sketch, bands, key = lists("sketch").view(np.uint64), lists("bands"), table.column("key")[0].as_py()
    earlier = bands < key if table.column("once")[0].as_py() else np.zeros_like(bands, bool)
    ids, most = table.column("id").to_pylist(), most_flipped()
    sets: dict[int, np.ndarray] = {}
    column = table.column("set")
    joined = blocks.Joined(table.column("component").to_pylist())

    def of(row: int) -> np.ndarray:
        if row not in sets:
            sets[row] = np.frombuffer(column[row].as_py(), "<u8")
        return sets[row]

    step = max(1, PAIRS // max(len(right), 1))
    for at in range(0, len(left), step):
        rows_ = left[at : at + step]
        pairs = joined.label[rows_][:, None] != joined.label[right][None, :]
        if left is right:
            pairs &= np.arange(at, at + len(rows_))[:, None] < np.arange(len(right))[None, :]
        x, y = np.nonzero(pairs)
        flips = sum(np.bitwise_count(sketch[rows_[x], w] ^ sketch[right[y], w]).astype(np.int64) for w in range(SKETCH_WORDS))
        x, y = rows_[x[flips <= most]], right[y[flips <= most]]
        if len(x) and earlier.any():  # a pair that shares an earlier bucket is left to that one
            first = np.ones(len(x), bool)
            for b in range(BANDS):
                first &= ~(earlier[x, b] & (bands[x, b] == bands[y, b]))
            x, y = x[first], y[first]
        if not len(x):
            continue
        if len(x) <= 64:
            found = [(i, j) for i, j in zip(x.tolist(), y.tolist()) if joined.label[i] != joined.label[j] and linked(of(i), of(j))]
        else:
            some, other = np.unique(x), np.unique(y)
            yes = linked_pairs([of(i) for i in some.tolist()], [of(j) for j in other.tolist()])
            found = [(i, j) for i, j, ok in zip(x.tolist(), y.tolist(), yes[np.searchsorted(some, x), np.searchsorted(other, y)].tolist()) if ok]
        for i, j in found:
            joined.join(i, j)
    return pa.array([ids[i] for i, _ in joined.at], pa.int64()), pa.array([ids[j] for _, j in joined.at], pa.int64())


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_hash, bands and sketch of docs(doc_id, text); the last three are null for empty sets."""
    common.small_batches(common.session(docs))
    schema = "doc_id bigint, n_shingles bigint, set_hash binary, bands array<bigint>, sketch array<bigint>"

    def signed(texts: list[str]) -> dict:
        out: dict = {"n_shingles": [], "set_hash": [], "bands": [], "sketch": []}
        for text in texts:
            s = shingles(text)
            least = samples(s) if len(s) else None
            out["n_shingles"].append(len(s))
            out["set_hash"].append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
            out["bands"].append(None if least is None else band_keys(least))
            out["sketch"].append(None if least is None else odd_sketch(least))
        return out

    return common.plain(docs, "doc_id", "text").mapInArrow(common.over_texts(signed, ["doc_id"], schema), schema)


def sets_of(ids: DataFrame, docs: DataFrame) -> DataFrame:
    """id and set, once for each of ids(id), written to the shared folder."""
    schema = "id bigint, set binary"
    few = ids.count() <= MOST_BROADCAST
    texts = common.plain(docs, "doc_id", "text").withColumnRenamed("doc_id", "id").join(F.broadcast(ids) if few else ids, "id", "left_semi")
    made = texts.mapInArrow(common.over_texts(lambda x: {"set": [shingles(t).tobytes() for t in x]}, ["id"], schema), schema)
    # Rows of one id have one text here: only rows that repeat go.
    return common.stored(made.groupBy("id").agg(F.min("set").alias("set")), "sets", {"compression": "zstd"})


def _numbered(docs: DataFrame) -> tuple[DataFrame, DataFrame] | None:
    """Where rows of one doc_id differ in text: docs with a doc_id of its own for each such text, in the order of the old ones, and
    the table of own and was, the old ones. None if there are no such rows. Null doc_ids stay."""
    of, row, own = (common.free(docs, name) for name in ("of", "row_of", "own"))
    at, text = F.col("doc_id").cast("bigint"), F.xxhash64(F.col("text").cast("string"))
    shared = docs.select(at.alias(of)).filter(F.col(of).isNotNull()).groupBy(of).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if not shared.limit(1).count():
        return None
    rows = docs.select(at.alias(of), text.alias(row)).filter(F.col(of).isNotNull()).distinct()
    # Numbers grow along the sorted partitions.
    ids = common.stored(rows.orderBy(of, row).withColumn(own, F.monotonically_increasing_id()), "own-ids")
    side = F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids
    out = docs.join(side, (at == F.col(of)) & (text == F.col(row)), "left")
    out = common.stored(out.select(*((F.col(own).alias(c) if c == "doc_id" else F.col(common.quoted(c))) for c in docs.columns)), "own-rows")
    return out, ids.select(F.col(own).alias("own"), F.col(of).alias("was"))


def _renamed(df: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """df with the old doc_ids for those that _numbered() gave, in a column."""
    own, was = (common.free(df, name) for name in ("own", "was"))
    ids = ids.select(F.col("own").alias(own), F.col("was").alias(was))
    out = df.join(F.broadcast(ids) if ids.count() <= MOST_BROADCAST else ids, F.col(column) == F.col(own), "left")
    return out.select(*((F.col(was).cast(df.schema[c].dataType).alias(c) if c == column else F.col(common.quoted(c))) for c in df.columns))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of each row of docs(doc_id, text)."""
    docs = common.plain(docs, "doc_id", "text")
    if numbered := _numbered(docs):
        return _renamed(_renamed(_near_duplicates(numbered[0]), numbered[1], "doc_id"), numbered[1], "component_id")
    return _near_duplicates(docs)


def _near_duplicates(docs: DataFrame) -> DataFrame:
    """near_duplicates() of docs in which rows of one doc_id have one text."""
    signed = common.stored(signatures(docs), "signatures")
    classes = signed.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_hash")
    classes = classes.agg(F.min("doc_id").alias("id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"), F.first("n_shingles").alias("n"))
    classes = common.stored(classes, "classes")
    members = classes.select("id", F.explode("bands").alias("key"), blocks.weight(F.col("n"), LEAST_WEIGHT).alias("weight"))
    buckets = members.groupBy("key").agg(F.min("id").alias("least"), F.max("id").alias("last")).filter("least < last").select("key", "least")
    members = common.stored(members.join(buckets, "key"), "members")
    side = lambda name: classes.select(F.col("id").alias(name), F.col("sketch").alias(f"{name}_sketch"))

    def found_in(groups: DataFrame, once: bool) -> DataFrame:
        """The links in groups of ids, whose sketches, bands and sets are put beside them."""
        groups = common.stored(groups, "groups")
        sets = sets_of(groups.select("id").distinct(), docs)
        rows = groups.join(sets.join(classes.select("id", "sketch", "bands"), "id"), "id").withColumn("once", F.lit(once))
        out = common.stored(blocks.links_in(rows, block_links), "found-links")
        for df in (groups, sets):
            common.discard(df)
        return out

    pairs = members.filter("id <> least").select(F.col("id").alias("a"), F.col("least").alias("b")).distinct()
    pairs = pairs.join(side("a"), "a").join(side("b"), "b").filter(flipped(F.col("a_sketch"), F.col("b_sketch")) <= most_flipped()).select("a", "b")
    links = found_in(blocks.star_groups(common.stored(pairs, "star-pairs"), STAR), False)
    found = components(links)
    more = found_in(blocks.open_groups(members, found, BLOCK), True)
    if more.limit(1).count():
        found = components(links.unionByName(more))
    common.discard(members)

    label = F.coalesce("component", "id")
    of_class = classes.select("set_hash", "id").join(found.withColumnRenamed("node", "id"), "id", "left").select("set_hash", label.alias("component"))
    out = signed.select("doc_id", "n_shingles", "set_hash").join(of_class, "set_hash", "left")
    alone = F.when((F.col("n_shingles") == 0) | F.col("doc_id").isNull(), F.col("doc_id"))
    return out.select("doc_id", "n_shingles", F.coalesce(alone, F.when(F.col("doc_id").isNotNull(), F.col("component"))).alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay: of each component the document with the least doc_id, once; all with empty sets."""
    if numbered := _numbered(docs):
        kind = docs.schema["doc_id"].dataType
        kept = _renamed(_drop_near_duplicates(numbered[0]), numbered[1], "doc_id")
        return kept.withColumn("doc_id", F.col("doc_id").cast(kind))
    return _drop_near_duplicates(docs)


def _drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """drop_near_duplicates() of docs in which rows of one doc_id have one text."""
    found = common.stored(_near_duplicates(docs), "components")
    gone = common.stored(found.filter("component_id IS NULL OR component_id <> doc_id").select("doc_id").distinct(), "gone")
    again = found.filter("n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("doc_id")
    again = common.stored(again, "again")
    key = common.free(docs, "key")
    fits = lambda df: F.broadcast(df) if df.count() <= MOST_BROADCAST else df
    at = F.col("doc_id").cast("bigint")
    rest = docs.join(fits(gone.withColumnRenamed("doc_id", key)), at == F.col(key), "left_anti")
    if again.limit(1).count():
        side = fits(again.withColumnRenamed("doc_id", key))
        rest = rest.join(side, at == F.col(key), "left_anti").unionByName(rest.join(side, at == F.col(key), "left_semi").dropDuplicates(["doc_id"]))
    return rest


def query(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g'), '[^ ]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS x FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 75 * (na.n + nb.n - c)),
r AS (SELECT a AS doc_id, a AS node FROM l UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.node),
m AS (SELECT doc_id, min(node) AS component_id FROM r GROUP BY doc_id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(m.component_id, d.doc_id) AS component_id, d.doc_id = coalesce(m.component_id, d.doc_id) AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)
"""
