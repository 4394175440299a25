"""Small tables for the corpus operators: odd rows, near copies, and DuckDB over the same rows."""

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, size int, spans string, blob string, key int"


def words(r, n, vocabulary=400):
    return " ".join(f"w{r.randrange(vocabulary)}x" for _ in range(n))


def odd_rows():
    """Nulls in each column, empty and blank texts, ties, repeated rows, a very long text, and columns that operators use too."""
    r = random.Random(3)
    long = words(r, 30_000, 5_000)
    texts = [None, "", " \n\t ", "one", "a b c d", words(r, 60), long, "Line of words that is long enough\n" * 3 + words(r, 40), "x" * 5_000, "é ñ 日本語 \U0001f600 " + words(r, 30)]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None) for i, t in enumerate(texts)]
    rows += [(5, texts[5], "en", "s2"), (20, texts[5], None, None), (21, texts[5] + " tail", "en", "s0"), (None, texts[5], "en", "s1")]
    return [(i, t, lang, s, None if t is None else len(t), "row", 7, "spans", "blob", 1) for i, t, lang, s in rows]


def odd(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def near_rows(seed=1, groups=12):
    """Documents with copies of 1 to 12 changed words."""
    r = random.Random(seed)
    rows = []
    for _ in range(groups):
        base = words(r, r.randint(30, 120)).split()
        for _ in range(r.randint(1, 5)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4, 12])):
                t[r.randrange(len(t))] = f"new{r.randrange(999)}"
            lines = [" ".join(t[i : i + 12]) for i in range(0, len(t), 12)]
            rows.append((len(rows), "\n".join(lines), "en", f"s{r.randrange(3)}"))
    r.shuffle(rows)
    return rows


def table(spark, rows):
    return spark.createDataFrame([(*row, len(row[1] or ""), None, None, None, None, None) for row in rows], SCHEMA)


def saved(df, tmp_path):
    """df as a data folder's documents table."""
    df.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def by_sql(sql, tmp_path):
    import duckdb

    c = duckdb.connect()
    c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = c.execute(sql)
    names = sorted(x[0] for x in got.description)
    at = [[x[0] for x in got.description].index(n) for n in names]
    return sorted(map(repr, (tuple(_plain(row[i]) for i in at) for row in got.fetchall())))


def _plain(x):
    return round(x, 6) if isinstance(x, float) else int(x) if type(x).__name__ == "Decimal" else x


def by_spark(df):
    names = sorted(df.columns)
    return sorted(map(repr, (tuple(_plain(row[n]) for n in names) for row in df.collect())))


def vocabulary():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return public_tokenizers.path("byte_bpe_50k.json")
