import random

from tidemark.llm import line_dedup, near_dedup
from tidemark.llm.components import components

from . import fixtures as fx


def test_op7_against_sql(spark, tmp_path):
    at = fx.saved(fx.table(spark, fx.near_rows(2, 14)), tmp_path)
    assert fx.by_spark(near_dedup.query(spark, at)) == fx.by_sql(near_dedup.SQL, tmp_path)


def test_chains_and_large_buckets_keep_every_link(spark, tmp_path):
    r = random.Random(4)
    base = fx.words(r, 200).split()
    rows = []
    for i in range(60):  # each differs a little from the one before, the ends share less
        base[(7 * i) % 200] = f"step{i}"
        rows.append((i, " ".join(base), "en", "a"))
    at = fx.saved(fx.table(spark, rows), tmp_path)
    assert fx.by_spark(near_dedup.query(spark, at)) == fx.by_sql(near_dedup.SQL, tmp_path)


def test_odd_rows(spark):
    docs = fx.odd(spark)
    got = {(r.doc_id, r.n_shingles): r.component_id for r in near_dedup.near_duplicates(docs).collect()}
    assert got[(0, 0)] == 0 and got[(1, 0)] == 1 and got[(2, 0)] == 2  # null, empty, blank
    assert got[(3, 1)] == 3 and got[(4, 1)] == 4  # fewer than five words
    assert {c for (i, _), c in got.items() if i in (5, 20, 21)} == {5}
    assert next(c for (i, _), c in got.items() if i is None) is None
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [r.doc_id for r in left.collect()]
    assert sorted(i for i in ids if i is not None) == [0, 1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert near_dedup.near_duplicates(fx.empty(spark)).count() == 0


def test_sketches_estimate_and_never_drop_links():
    r = random.Random(5)
    for _ in range(40):
        a = [f"w{r.randrange(10**6)}" for _ in range(300)]
        b = a[: r.randint(0, 300)] + [f"v{r.randrange(10**6)}" for _ in range(30)]
        x, y = near_dedup.shingles(" ".join(a)), near_dedup.shingles(" ".join(b))
        flips = sum(bin((int(p) ^ int(q)) & (1 << 64) - 1).count("1") for p, q in zip(near_dedup.odd_sketch(near_dedup.samples(x)), near_dedup.odd_sketch(near_dedup.samples(y))))
        if near_dedup.linked(x, y):
            assert flips <= near_dedup.most_flipped()


def test_components_against_union_find(spark):
    r = random.Random(6)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(180)] + [(i, i + 1) for i in range(1000, 1100)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {row.node: row.component for row in components(spark.createDataFrame(links + [(None, 1)], "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, a, most, alphabet):
    b = list(a)
    for _ in range(r.randint(0, most)):
        i, how = r.randint(0, len(b)), r.random()
        if how < 0.33:
            b.insert(i, r.choice(alphabet))
        elif b and how < 0.66:
            b.pop(i % len(b))
        elif b:
            b[i % len(b)] = r.choice(alphabet)
    return "".join(b)


def test_banded_distance_against_the_full_table():
    r = random.Random(7)
    for _ in range(8000):
        a = "".join(r.choice("abc"[: r.randint(1, 3)]) for _ in range(r.randint(0, 14)))
        b = changed(r, a, 4, "abc")
        for k in range(4):
            assert line_dedup.within(a, b, k) == (edits(a, b) <= k)


def test_lines_within_the_threshold_share_a_key_and_near_sketches():
    r = random.Random(8)
    for _ in range(8000):
        a = "".join(r.choice("ab ") for _ in range(r.randint(10, 60)))
        s, t = sorted((a, changed(r, a, 2, "abc")), key=len)
        k = line_dedup.threshold(len(s))
        if k and line_dedup.within(s, t, k):
            assert set(line_dedup.segment_keys([s], index=True)[0]) & set(line_dedup.segment_keys([t])[0])
            x, y = map(int, line_dedup.pair_sketches([s, t]))
            assert bin((x ^ y) & (1 << 64) - 1).count("1") <= 8


def test_op8_against_sql(spark, tmp_path):
    r = random.Random(9)
    lines = ["".join(r.choice("abcdefg ") for _ in range(r.randint(5, 50))) for _ in range(40)]
    rows = [(i, "\n".join(changed(r, r.choice(lines), 2, "abcdefg") for _ in range(r.randint(0, 6))), "en", "a") for i in range(60)] + [(100, None, "en", "a"), (101, "", "en", "a")]
    at = fx.saved(fx.table(spark, rows), tmp_path)
    assert fx.by_spark(line_dedup.query(spark, at)) == fx.by_sql(line_dedup.SQL, tmp_path)


def test_dropped_lines_leave_the_rest(spark):
    docs = fx.table(spark, [(1, "first line of some words\n\nsecond", "en", "a"), (2, "second\nthird\nfirst line of some wordz", "en", "b"), (3, None, None, None)])
    out = line_dedup.drop_lines(docs)
    assert out.columns == docs.columns
    assert {x.doc_id: x.text for x in out.collect()} == {1: "first line of some words\n\nsecond", 2: "third", 3: None}
    odd = fx.odd(spark)
    assert line_dedup.drop_lines(odd).count() == odd.count()
    assert line_dedup.drop_lines(fx.empty(spark)).count() == 0


def test_rows_that_share_an_id_keep_their_own_lines_and_texts(spark):
    r = random.Random(10)
    line = lambda: fx.words(r, 12, 10**6)
    same, own = line(), [line() for _ in range(9)]
    rows = [(None, f"{own[0]}\n{own[1]}", "en", "a"), (None, f"{own[2]}\n{same}", "en", "a"), (None, f"{own[3]}\n{same}", "en", "b"), (7, f"{own[4]}\n{own[5]}", "en", "a"), (7, f"{own[6]}\n{own[6]}", "en", "a"), (7, None, "en", "c")]
    texts = sorted(x.text or "" for x in line_dedup.drop_lines(fx.table(spark, rows)).collect())
    first = min((1, 2), key=lambda i: (own[i + 1] + "\n" + same) not in texts)
    last = own[4 - first]
    assert texts == sorted([rows[0][1], rows[first][1], last, rows[3][1], own[6], ""])

    copy, other, third = line(), line(), line()
    rows = [(3, copy, "en", "a"), (5, copy, "en", "a"), (5, other, "en", "a"), (5, third, "en", "b"), (5, third, "en", "c"), (9, other, "en", "a"), (5, None, "en", "a"), (None, other, "en", "a")]
    docs = fx.table(spark, rows)
    left = near_dedup.drop_near_duplicates(docs)
    assert left.columns == docs.columns and left.schema["doc_id"].dataType == docs.schema["doc_id"].dataType
    assert sorted((x.doc_id or 0, x.text or "") for x in left.collect()) == sorted([(3, copy), (5, other), (5, third), (5, ""), (0, other)])
    found = sorted((x.doc_id or 0, x.component_id or 0, x.n_shingles) for x in near_dedup.near_duplicates(docs).collect())
    assert found == sorted([(3, 3, 8), (5, 3, 8), (5, 5, 8), (5, 5, 8), (5, 5, 8), (9, 5, 8), (5, 5, 0), (0, 0, 8)])


def test_blocks_of_sets_are_compared_as_pairs_are():
    import numpy as np

    r = random.Random(11)
    sets = []
    for _ in range(60):
        base = sets[r.randrange(len(sets))].tolist() if sets and r.random() < 0.7 else [r.randrange(1 << 63) for _ in range(r.randint(1, 4000))]
        kept = [x for x in base if r.random() < r.choice([0.8, 0.9, 0.98])]
        sets.append(np.unique(np.array(kept + [r.randrange(1 << 63) for _ in range(r.randint(1, 30))], np.uint64)))
    got = near_dedup.linked_pairs(sets[:25], sets[25:])
    assert got.tolist() == [[near_dedup.linked(x, y) for y in sets[25:]] for x in sets[:25]]
    assert got.any() and not got.all()


def test_a_group_of_copies_near_the_threshold_against_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 5_000)  # some 15 documents
    monkeypatch.setattr(near_dedup, "STAR", 7)
    r = random.Random(12)
    base = fx.words(r, 120, 10**6).split()
    rows = []
    for i in range(90):
        t = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5, 6])):
            t[r.randrange(len(t))] = f"new{r.randrange(10**6)}"
        rows.append((i, " ".join(t), "en", "a"))
    at = fx.saved(fx.table(spark, rows), tmp_path)
    got = fx.by_spark(near_dedup.query(spark, at))
    assert got == fx.by_sql(near_dedup.SQL, tmp_path)


def test_segment_keys_do_not_depend_on_the_lines_beside():
    r = random.Random(13)
    lines = ["".join(r.choice("abc \U0001f600é") for _ in range(r.randint(16, 90))) for _ in range(50)]
    for index in (False, True):
        keys, of = line_dedup.segment_keys(lines, 3, index)
        for i, line in enumerate(lines):
            assert sorted(keys[of == i].tolist()) == sorted(line_dedup.segment_keys([line], 3, index)[0].tolist())
            if index:
                assert (of == i).sum() == line_dedup.threshold(len(line), 3) + 1


def test_numbered_lines_are_found_without_rows_for_pairs(spark, monkeypatch):
    made = {}
    stored = line_dedup.common.stored
    monkeypatch.setattr(line_dedup.common, "stored", lambda df, name, *a: made.setdefault(f"{name}{len(made)}", stored(df, name, *a)))
    monkeypatch.setattr(line_dedup.common, "discard", lambda df: None)
    n = 20_000
    docs = spark.range(n).selectExpr("id AS doc_id", "concat('Page ', lpad(cast(id AS string), 6, '0'), ' of the collected annual reports') AS text")
    got = line_dedup.near_lines(docs)
    assert got.count() == n - 1 and got.select("component").distinct().count() == 1
    assert max(df.count() for df in made.values()) <= 40 * n  # pairs are n * n / 2


def test_more_edits_by_choice_against_the_full_table(spark):
    r = random.Random(14)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randint(50, 120))).strip() for _ in range(8)]
    lines = list(dict.fromkeys(changed(r, r.choice(base), 6, "abcdefgh").strip() for _ in range(80)))
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[:i]:
            k = line_dedup.threshold(min(len(a), len(b)), 5)
            if k and edits(a, b) <= k:
                root[find(a)] = find(b)
    want = {}
    for x in lines:
        want.setdefault(find(x), set()).add(line_dedup.line_hash(x))
    got = {}
    for row in line_dedup.near_lines(fx.table(spark, [(i, x, "en", "a") for i, x in enumerate(lines)]), 5).collect():
        got.setdefault(bytes(row.component), {bytes(row.component)}).add(bytes(row.node))
    assert sorted(map(sorted, got.values())) == sorted(sorted(x) for x in want.values() if len(x) > 1)


def test_odd_names_and_repeated_rows_against_sql(spark, tmp_path):
    r = random.Random(15)
    line = lambda: "".join(r.choice("abcdefg ") for _ in range(40)).strip()
    own = [line() for _ in range(12)]
    rows = [(i, "\n".join(changed(r, r.choice(own), 2, "abc") for _ in range(5)), "en", "a") for i in range(30)]
    rows += [(50, "x" * 3_000 + "\n" + own[0], "en", "a"), (51, "x" * 2_999 + "y\n" + own[1], None, None), (52, None, None, "a"), (53, " \n\t\n", "en", "a")]
    at = fx.saved(fx.table(spark, rows), tmp_path)
    assert fx.by_spark(line_dedup.query(spark, at)) == fx.by_sql(line_dedup.SQL, tmp_path)
    docs = spark.createDataFrame([(1, "a line of some words\nb", 5), (2, "a line of some wordz", 6)], "doc_id bigint, text string, `a.b``c` int")
    assert line_dedup.drop_lines(docs).columns == docs.columns == ["doc_id", "text", "a.b`c"]
    assert sorted((x[0], x[1], x[2]) for x in line_dedup.drop_lines(docs).collect()) == [(1, "a line of some words\nb", 5), (2, "", 6)]


def test_lines_and_the_index_meet_in_one_exchange(spark, monkeypatch):
    plans = {}
    stored = line_dedup.common.stored

    def seen(df, name, *a):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return stored(df, name, *a)

    monkeypatch.setattr(line_dedup.common, "stored", seen)
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    docs = fx.table(spark, [(1, "first line of some words", "en", "a"), (2, "first line of some wordz", "en", "b")])
    assert line_dedup.near_lines(docs).count() == 1
    assert plans["line-met"].count("Exchange hashpartitioning") == 1 and "Join" not in plans["line-met"]
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") in (size, "1000")


def test_lines_meet_the_least_of_the_index_wherever_batches_end():
    import pyarrow as pa

    r = random.Random(16)
    for _ in range(300):
        sketch = [r.choice([0, 1, -1, 255, (1 << 40) - 1]) for _ in range(12)]
        rows = sorted({(2 * r.randint(-2, 2) + r.randint(0, 1), r.randint(-5, 5)) for _ in range(r.randint(1, 40))}, key=lambda x: (x[0], r.random()))
        rows += rows[-1:]  # a line may come from two partitions
        index = {k >> 1: sorted(i for key, i in rows if key == k) for k, _ in rows if not k & 1}
        want = []
        for key, i in rows:
            if key & 1 and (ids := index.get(key >> 1)):
                near = i != ids[0] and bin((sketch[i + 5] ^ sketch[ids[0] + 5]) & (1 << 64) - 1).count("1") <= 8
                if near or ids[0] < ids[-1]:
                    want.append((key >> 1, i, ids[0], near, ids[0] < ids[-1]))
        table = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*((k, i, sketch[i + 5]) for k, i in rows))], names=["key", "id", "sketch"])
        step = r.choice([1, 2, 3, 7, 100])
        batches = [table.slice(s, step) for s in range(0, len(rows), step)]
        got = [tuple(x.values()) for b in line_dedup._meet(2)(iter([table.slice(0, 0), *batches])) for x in b.to_pylist()]
        assert got == want


def test_sketches_and_sums_of_any_characters():
    r = random.Random(17)
    lines = ["".join(r.choice("ab é日\U0001f600\ud800") for _ in range(n)) for n in (0, 1, 2, 0, 16, 40, 1, 0)]
    got = line_dedup.pair_sketches(lines)
    for line, x in zip(lines, got.tolist()):
        flips = 0
        for a, b in zip(line, line[1:]):
            flips ^= 1 << ((ord(a) * 0x9E3779B1 + ord(b) * 0x85EBCA6B) >> 7 & 63)
        assert x & (1 << 64) - 1 == flips
    assert line_dedup.pair_sketches([]).tolist() == []
    assert line_dedup._powers(3, 4).tolist() == [1, 3, 9, 27, 81]
