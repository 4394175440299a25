"""Languages of texts and of spans in mixed-language texts.

Character trigrams of each language are counted on a bounded sample of labelled rows. A word's script leaves the languages that
write in it; each word is scored for these by its trigrams, and Viterbi's algorithm over the words, with a penalty for each switch
of language, labels spans. A text's language is the one with most letters, its score the share of letters that it has.

Null texts and texts without letters are "und" with score 0. Rows with null lang are never learned from; with nothing to learn
from, all texts are "und". Equal texts get equal results. An empty table gives an empty table; only the columns named are read.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Trigrams are counted in so many buckets. The sample has about so many rows of each language, by a hash of doc_id.
BUCKETS, SAMPLE_PER_LANGUAGE = 1 << 16, 1500
#: What a switch costs, in nats; added to each count; a script that has less than this share of a language's letters isn't its own.
SWITCH, SMOOTH, LEAST_SCRIPT = 14.0, 0.5, 0.01
BLOCK = 1 << 20
NEVER = -60.0

# Unicode blocks of scripts, as first and last code point.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xFF21, 0xFF5A)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF), (0xFB1D, 0xFB4F)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)],
    "devanagari": [(0x900, 0x97F), (0xA8E0, 0xA8FF)],
    "bengali": [(0x980, 0x9FF)],
    "gurmukhi": [(0xA00, 0xA7F)],
    "gujarati": [(0xA80, 0xAFF)],
    "tamil": [(0xB80, 0xBFF)],
    "telugu": [(0xC00, 0xC7F)],
    "kannada": [(0xC80, 0xCFF)],
    "malayalam": [(0xD00, 0xD7F)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF), (0x1C90, 0x1CBF), (0x2D00, 0x2D2F)],
    "hangul": [(0x1100, 0x11FF), (0x3130, 0x318F), (0xA960, 0xA97F), (0xAC00, 0xD7FF)],
    "kana": [(0x3040, 0x30FF), (0x31F0, 0x31FF)],
    "han": [(0x2E80, 0x2FDF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)],
}
NAMES = ("other", *SCRIPTS)


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower case if it is a letter or a mark, else 0; and the number of its script."""
    low = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        if unicodedata.category(c := chr(i))[0] in "LM":
            low[i] = ord(x) if len(x := c.lower()) == 1 else i
    script = np.zeros(0x110000, np.uint8)
    for k, blocks in enumerate(SCRIPTS.values(), 1):
        for a, b in blocks:
            script[a : b + 1] = k
    return low, script


@cache
def letters_only() -> np.ndarray:
    """Which code points are letters, not marks."""
    return np.array([unicodedata.category(chr(i))[0] == "L" for i in range(0x110000)])


@dataclass
class Words:
    """The words of a block of texts: where letters are, and each word's first letter, script, length and text."""

    keys: np.ndarray
    first: np.ndarray
    script: np.ndarray
    size: np.ndarray
    start: np.ndarray
    text: np.ndarray


def read_words(texts: list[str]) -> Words:
    low, scripts = tables()
    points = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    letters = low[points]
    proper = letters_only()[points]
    if (marks := (letters > 0) & ~proper).any():  # marks make no word without a letter
        runs = np.flatnonzero(np.diff(np.concatenate([[0], letters > 0, [0]]).astype(np.int8)))
        for s, e in zip(runs[::2].tolist(), runs[1::2].tolist()):
            if marks[s] and not proper[s:e].any():
                letters[s:e] = 0
    starts_at = np.cumsum([0, *(len(t) + 1 for t in texts)])
    before, after = np.concatenate([[0], letters[:-1]]), np.concatenate([letters[1:], [0]])
    where = np.flatnonzero(letters)
    a, b, c = (x[where].astype(np.uint32) for x in (before, letters, after))
    keys = (a * np.uint32(0x9E3779B1) + b * np.uint32(0x85EBCA6B) + c * np.uint32(0xC2B2AE35)) * np.uint32(0x27D4EB2F) >> np.uint32(16)
    first = np.flatnonzero(a == 0)
    start = where[first]
    text = np.searchsorted(starts_at, start, "right") - 1
    size = np.diff(np.append(first, len(where)))
    return Words(keys, first, scripts[points[start]], size, start - starts_at[text], text)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # buckets x languages: log probability of a trigram
    allowed: np.ndarray  # scripts x languages
    switch: float = SWITCH

    def word_scores(self, w: Words) -> np.ndarray:
        out = np.zeros((len(w.first), len(self.languages)), np.float32)
        for lo in range(0, len(w.first), BLOCK // 8):
            hi = min(lo + BLOCK // 8, len(w.first))
            a, b = w.first[lo], w.first[hi] if hi < len(w.first) else len(w.keys)
            for part in range(a, b, BLOCK):  # a word of any length is summed in parts
                end = min(part + BLOCK, b)
                x = np.searchsorted(w.first[lo:hi], part, "right") - 1
                own = np.maximum(w.first[lo + x : hi], part)
                own = own[own < end]
                out[lo + x : lo + x + len(own)] += np.add.reduceat(self.scores[w.keys[part:end]], own - part, axis=0)
        out -= out.max(axis=1, keepdims=True)
        open_to = self.allowed[w.script]
        return np.where(open_to | ~open_to.any(axis=1, keepdims=True), np.maximum(out, NEVER), 2 * NEVER)

    def path(self, s: np.ndarray) -> np.ndarray:
        """The labels of a text's words that score best with the penalties."""
        top = int(s.sum(axis=0).argmax())
        if s.shape[1] == 1:
            return np.zeros(len(s), np.int32)
        rest = np.delete(s, top, axis=1).max(axis=1) - s[:, top]
        gain = np.concatenate([[0.0], np.cumsum(rest, dtype=np.float64)])
        if (gain - np.minimum.accumulate(gain)).max() <= self.switch:
            return np.full(len(s), top, np.int32)  # no run of words is worth a switch
        value, back = s[0].astype(np.float64), np.empty(s.shape, np.int32)
        stay = np.arange(s.shape[1])
        for t in range(1, len(s)):
            best = int(value.argmax())
            moved = value[best] - self.switch
            back[t] = np.where(value >= moved, stay, best)
            value = np.maximum(value, moved) + s[t]
        labels = np.empty(len(s), np.int32)
        labels[-1] = int(value.argmax())
        for t in range(len(s) - 1, 0, -1):
            labels[t - 1] = back[t, labels[t]]
        return labels

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[str, int, int]]]]:
        """Of each text: language, score, and spans (language, start, end) of the words."""
        out: list = [("und", 0.0, [])] * len(texts)
        if not self.languages:
            return out
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= BLOCK):
                size += len(texts[hi])
                hi += 1
            w = read_words(texts[lo:hi])
            scores = self.word_scores(w) if len(w.first) else np.empty((0, 1))
            cuts = np.searchsorted(w.text, np.arange(hi - lo + 1))
            for k in range(hi - lo):
                a, b = cuts[k], cuts[k + 1]
                if a == b:
                    continue
                labels = self.path(scores[a:b])
                share = np.bincount(labels, w.size[a:b], len(self.languages))
                top = int(share.argmax())
                turns = np.flatnonzero(np.diff(labels)) + 1
                edges = [0, *turns.tolist(), b - a]
                ends = w.start[a:b] + w.size[a:b]
                spans = [(self.languages[labels[x]], int(w.start[a + x]), int(ends[y - 1])) for x, y in zip(edges, edges[1:])]
                out[lo + k] = (self.languages[top], float(share[top] / share.sum()), spans)
            lo = hi
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """A model from docs(doc_id, text, lang), from rows that aren't held out."""
    common.small_batches(common.session(docs))
    known = docs.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros((len(NAMES), 0), bool))
    rates = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, int(min(1.0, per_language / n) * (1 << 30)))))
    sample = known.filter(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) < rates[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                n = seen.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                w = read_words([text])
                n[:BUCKETS] += np.bincount(w.keys, minlength=BUCKETS)
                n[BUCKETS:] += np.bincount(w.script, w.size, len(NAMES)).astype(np.int64)
        for lang, n in seen.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], names=["lang", "bucket", "n"])

    # At most BUCKETS and a few rows for each language, however large the corpus.
    rows = sample.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    languages = sorted(sizes)
    n = np.zeros((BUCKETS + len(NAMES), len(languages)))
    at = {lang: i for i, lang in enumerate(languages)}
    n[rows["bucket"].to_numpy(), [at[x] for x in rows["lang"].to_pylist()]] = rows["n"].to_numpy()
    grams, scripts = n[:BUCKETS] + SMOOTH, n[BUCKETS:]
    allowed = scripts >= LEAST_SCRIPT * np.maximum(scripts.sum(axis=0), 1)
    return Model(languages, np.log(grams / grams.sum(axis=0)).astype(np.float32), allowed)


def label_documents(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score and spans of docs(doc_id, text)."""
    spark = common.session(docs)
    common.small_batches(spark)
    sent = spark.sparkContext.broadcast(model)  # BUCKETS x languages numbers
    schema = "doc_id bigint, lang_pred string, score double, spans array<struct<lang:string,start:int,end:int>>"

    def labelled(texts: list[str]) -> dict:
        got = sent.value.label(texts)
        return {"lang_pred": [x[0] for x in got], "score": [x[1] for x in got], "spans": [[dict(zip(("lang", "start", "end"), y)) for y in x[2]] for x in got]}

    return common.plain(docs, "doc_id", "text").mapInArrow(common.over_texts(labelled, ["doc_id"], schema), schema)


def query(spark, sf_dir: str) -> DataFrame:
    docs = common.plain(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "lang")
    found = label_documents(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
