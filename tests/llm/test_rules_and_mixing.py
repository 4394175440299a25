from pyspark.sql import functions as F

from tidemark.llm import mixing, quality

from . import fixtures as fx


def test_op2_against_sql(spark, tmp_path):
    rows = fx.near_rows() + [(900 + i, t, "en", "a") for i, t in enumerate(["a b " * 40, "### " * 30 + fx.words(fx.random.Random(1), 20), "SHOUT!! " * 30, "te te te te te su su su su su " * 1 + "ka " * 15, None, "", "same line of words here\n" * 9])]
    at = fx.saved(fx.table(spark, rows).unionByName(fx.odd(spark)).unionByName(fx.odd(spark).filter("doc_id = 5")), tmp_path)
    assert fx.by_spark(quality.query(spark, at)) == fx.by_sql(quality.SQL, tmp_path)


def test_repeated_words_against_brute_force(spark):
    rows = [("a b c d e f g h " * 3,), ("a " * 20,), ("x " + "a b c d e f g h " * 2 + "y",), ("a b c",), ("",)]
    got = [r.n for r in spark.createDataFrame(rows, "text string").select(quality.counts(F.col("text"))["n_repeat_words"].alias("n")).collect()]
    for (text,), n in zip(rows, got):
        w = text.split()
        wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        assert n == len({i + k for i, x in enumerate(wins) if wins.count(x) > 1 for k in range(8)})


def test_rules_run_by_rejections_for_their_work_and_keep_all_columns(spark):
    docs = fx.odd(spark)
    found = quality.order(docs.select("doc_id", "text"))
    assert [x[1] / x[2] for x in found] == sorted((x[1] / x[2] for x in found), reverse=True)
    kept = quality.filter_documents(docs)
    assert kept.columns == docs.columns
    judged = {r.doc_id: r.kept for r in quality.judged(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {i for i, k in judged.items() if k}
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.filter_documents(fx.empty(spark)).count() == 0


def test_the_work_of_rules_is_counted_on_the_sample(spark):
    by_name = {r.name: r for r in quality.RULES}
    same = [quality.Rule(n, lambda c: c["n_words"] > 0, (), by_name[n].work) for n in ("symbols", "capitals", "few_words", "repeats")]
    names = lambda texts: [r.name for r, _, _ in quality.order(fx.table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), tuple(same))]
    assert names(["### ### word " * 9] * 5) == ["few_words", "capitals", "symbols", "repeats"]
    assert names(["ABC DEF word " * 9] * 5) == ["few_words", "symbols", "capitals", "repeats"]
    shares = lambda texts: {r.name: w for r, _, w in quality.order(fx.table(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]), tuple(same))}
    short, long = shares(["a b c d e f g h i j " * 9] * 5), shares(["abcdefghij klmnopqrst " * 9] * 5)
    assert short["repeats"] / short["few_words"] > 1.5 * long["repeats"] / long["few_words"]


def test_op10_against_sql(spark, tmp_path):
    at = fx.saved(fx.odd(spark).dropDuplicates(["doc_id"]), tmp_path)
    assert fx.by_spark(mixing.query(spark, at)) == fx.by_sql(mixing.SQL, tmp_path)


def test_targets_share_the_whole_and_stop_at_three_times(spark):
    sizes = spark.createDataFrame([("a", 1000), ("b", 10), ("c", 500), (None, 20), ("z", 0)], "source string, size bigint")
    t = {r.source: r for r in mixing.source_targets(sizes).collect()}
    assert abs(sum(x.target for x in t.values()) - 1530) < 1e-6
    assert all(x.target <= 3 * x.source_size + 1e-9 for x in t.values())
    assert t["b"].target == 30 and t["z"].target == 0


def test_mix_repeats_rows_with_their_columns(spark):
    docs = fx.odd(spark)
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sorted(map(repr, mixed.collect())) == sorted(map(repr, mixing.mix_documents(docs).collect()))
    want = {}
    for r in mixing.with_copies(docs).collect():
        want[repr(r.row)] = want.get(repr(r.row), 0) + r.copies
    got = {}
    for r in mixed.collect():
        got[repr(r)] = got.get(repr(r), 0) + 1
    assert got == {k: n for k, n in want.items() if n}
    assert mixing.mix_documents(fx.empty(spark)).count() == 0
    names = spark.createDataFrame([(1, "a b", "s", 5)], "doc_id bigint, text string, source string, `a.b``c` int")
    assert mixing.mix_documents(names).columns == names.columns
