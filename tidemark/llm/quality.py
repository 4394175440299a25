"""Quality rules as a short-circuit cascade, in DataFrame functions only.

Each rule is a condition that rejects a text. A bounded sample shows what share of texts each rule rejects, and how much work it does
there: the characters that its patterns read, the matches and words that they make, the windows hashed, and what is sorted where a
window recurs, all counted on the sample's texts. The unit is one character read; the units of the other steps are constants. The
rules run in the order of rejections per work: a row that one rule rejects is not looked at by the later ones. The order changes
the time, never the verdict, which is that no rule rejects.

Null and blank texts have no words, fail the base rule and are rejected. Rows with equal texts get equal results; further
columns are kept by filter_documents(). An empty table gives an empty table. Windows of words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Words in a window, the least number of words, and the largest share (in %) of words in repeated windows.
WINDOW, LEAST_WORDS, MOST_REPEATED = 8, 20, 30
#: A bounded sample for rejections: about so many rows, by a hash of doc_id.
SAMPLE_ROWS = 2_000
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value) with value computed once: inside a lambda, a plain reference would be computed for each element."""
    return F.element_at(F.transform(F.array(value), f), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of words that occur twice or more in the text."""

    def windows(h: Column) -> Column:
        n = F.size(h) - window
        return F.when(n < 0, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(window)))))

    def covered(g: Column) -> Column:
        ordered = F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        twice = let(ordered, lambda s: F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"])))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
        step = lambda a, p: F.struct((a["n"] + p + window - F.greatest(p, a["end"])).alias("n"), (p + window).alias("end"))
        return F.aggregate(starts, zero, step)["n"]

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return let(hashes, lambda h: let(windows(h), lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(covered(g)))).cast("long")


def counts(text: Column) -> dict[str, Column]:
    """The counts that the rules compare, each of the whole text."""
    text = F.coalesce(text, F.lit(""))
    w = common.words(text)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    without = lambda pattern: F.char_length(text) - F.char_length(F.regexp_replace(text, pattern, ""))
    return {
        "chars": F.char_length(text).cast("long"),
        "n_words": F.regexp_count(text, F.lit(common.WORD)).cast("long"),
        "word_chars": F.char_length(F.regexp_replace(text, common.BLANK_RUN, "")).cast("long"),
        "n_symbols": without(f"{SYMBOLS}+").cast("long"),
        "n_lines": F.size(lines).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_repeat_words": repeated_words(w),
        "n_echoes": let(w, lambda x: F.size(F.filter(x, lambda y, i: y == F.get(x, i - 1)))).cast("long"),
        "n_shouts": without("[!?]+").cast("long"),
        "n_upper": without("\\p{Lu}+").cast("long"),
    }


#: Units of work, a character read being one: a match of a pattern, a word of an array, a window hashed, an element compared in a sort.
MATCH, ITEM, HASH, COMPARE = 4, 8, 10, 3


def _scan(*matched: str) -> Callable[[dict[str, Column]], Column]:
    """The work of reading a text once for each of these counts."""
    return lambda c: sum((c["chars"] + MATCH * c[n] for n in matched[1:]), c["chars"] + MATCH * c[matched[0]])


def _windows(c: dict[str, Column]) -> Column:
    n = F.greatest(c["n_words"] - WINDOW + 1, F.lit(0))
    return _scan("n_words", "n_words")(c) + ITEM * c["n_words"] + HASH * n + F.when(c["n_repeat_words"] > 0, COMPARE * n * F.log2(n + 1)).otherwise(0)


@dataclass(frozen=True)
class Rule:
    """rejects: a condition on the counts; reads: the counts it takes; work: what it does to a text, from the text's counts."""

    name: str
    rejects: Callable[[dict[str, Column]], Column]
    reads: tuple[str, ...]
    work: Callable[[dict[str, Column]], Column]


BASE = (
    Rule("few_words", lambda c: c["n_words"] < LEAST_WORDS, ("n_words",), _scan("n_words")),
    Rule("repeats", lambda c: 100 * c["n_repeat_words"] > MOST_REPEATED * c["n_words"], ("n_words", "n_repeat_words"), _windows),
)
RULES = (
    *BASE,
    Rule("symbols", lambda c: 10 * c["n_symbols"] > c["n_words"], ("n_words", "n_symbols"), _scan("n_words", "n_symbols")),
    Rule("word_length", lambda c: (c["word_chars"] < 2 * c["n_words"]) | (c["word_chars"] > 20 * c["n_words"]), ("n_words", "word_chars"), _scan("n_words", "n_words")),
    Rule("same_lines", lambda c: (c["n_dup_lines"] >= 4) & (100 * c["n_dup_lines"] > 30 * c["n_lines"]), ("n_lines", "n_dup_lines"), lambda c: _scan("n_lines")(c) + ITEM * c["n_lines"]),
    Rule("echoes", lambda c: 100 * c["n_echoes"] > 30 * c["n_words"], ("n_words", "n_echoes"), lambda c: _scan("n_words", "n_words")(c) + ITEM * c["n_words"]),
    Rule("shouts", lambda c: 10 * c["n_shouts"] > 3 * c["n_words"], ("n_words", "n_shouts"), _scan("n_words", "n_shouts")),
    Rule("capitals", lambda c: 100 * c["n_upper"] > 60 * c["word_chars"], ("word_chars", "n_upper"), _scan("n_words", "n_upper")),
)


def order(docs: DataFrame, rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[tuple[Rule, float, float]]:
    """Rules by rejections per work on the sample, each with its share of rejections and its mean work for a row."""
    total = docs.count()
    share = min(1.0, sample_rows / max(total, 1))
    sample = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30)))
    c = counts(F.col("text"))
    sums = [F.coalesce(F.sum(r.rejects(c).cast("int")), F.lit(0)).alias(f"r{i}") for i, r in enumerate(rules)]
    sums += [F.coalesce(F.sum(r.work(c).cast("double")), F.lit(0.0)).alias(f"w{i}") for i, r in enumerate(rules)]
    seen = sample.agg(F.count(F.lit(1)).alias("n"), *sums).first()
    n = max(seen["n"], 1)
    found = [(r, seen[f"r{i}"] / n, max(seen[f"w{i}"], 1.0) / n) for i, r in enumerate(rules)]
    return sorted(found, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def first_rejection(text: Column, rules: list[Rule]) -> Column:
    """The first rule in the given order that rejects the text, null if none does; later rules aren't evaluated."""
    c, out = counts(text), F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(c), rule.name).otherwise(out)
    return out


def judged(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base counts, base_failed and kept of docs(doc_id, text)."""
    docs = common.plain(docs, "doc_id", "text")
    ordered = [r for r, _, _ in order(docs, rules)]
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    c = counts(F.col("text"))
    out = docs.select("doc_id", "text", *(c[n].alias(f"_{n}") for n in names))
    known = c | {n: F.col(f"_{n}") for n in names}
    base = F.lit(False)
    for rule in BASE:
        base = base | rule.rejects(known)
    verdict = F.lit(True)
    for rule in reversed([r for r in ordered if r not in BASE]):
        verdict = F.when(rule.rejects(known), False).otherwise(verdict)
    out = out.withColumn("base_failed", base)
    return out.select("doc_id", *(F.col(f"_{n}").alias(n) for n in names), "base_failed", F.when(F.col("base_failed"), False).otherwise(verdict).alias("kept"))


def filter_documents(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of docs that no rule rejects, with all their columns."""
    ordered = [r for r, _, _ in order(common.plain(docs, "doc_id", "text"), rules)]
    return docs.filter(first_rejection(F.col("text"), ordered).isNull())


def query(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws FROM d),
g AS (SELECT r, unnest(generate_series(1, len(ws) - 7)) AS i, ws FROM w WHERE len(ws) >= 8),
k AS (SELECT r, i, array_to_string(ws[i:i + 7], ' ') AS win FROM g),
m AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM k),
p AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM m WHERE c >= 2),
rep AS (SELECT r, sum(least(8, coalesce(nx - i, 8))) AS n FROM p GROUP BY r),
l AS (SELECT r, unnest(string_split(text, chr(10))) AS line FROM d),
u AS (SELECT r, ws, unnest(generate_series(2, len(ws))) AS i FROM w),
e AS (SELECT r, count(*) AS n FROM u WHERE ws[i] = ws[i - 1] GROUP BY r),
dup AS (SELECT r, count(*) AS lines, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
c AS (SELECT d.r, doc_id, len(ws) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
  length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(dup.lines, 0) AS n_lines, coalesce(rep.n, 0) AS n_repeat_words, coalesce(e.n, 0) AS n_echoes,
  length(text) - length(regexp_replace(text, '[!?]', '', 'g')) AS n_shouts, length(text) - length(regexp_replace(text, '\p{Lu}', '', 'g')) AS n_upper
  FROM d JOIN w USING (r) LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN e USING (r)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR (n_dup_lines >= 4 AND 100 * n_dup_lines > 30 * n_lines) OR 100 * n_echoes > 30 * n_words OR 10 * n_shouts > 3 * n_words OR 100 * n_upper > 60 * word_chars) AS kept
FROM b
"""
