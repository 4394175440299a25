import corpus_pipeline
from tidemark.llm import common, near_dedup, quality

from . import fixtures as fx


def stages(spark, docs, sf_dir):
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, common.stored(stage(spark, docs, sf_dir), name)
        yield name, before, docs


def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    docs = fx.table(spark, fx.near_rows(3, 10)).unionByName(fx.odd(spark))
    columns = docs.columns
    for name, before, after in stages(spark, docs, str(tmp_path)):
        ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
        assert ids(after) <= ids(before)
        if name != "best_fit_packing":
            assert after.columns == columns
        if name == "quality_rules":
            assert ids(after) == {r.doc_id for r in quality.judged(before).collect() if r.kept}
        if name == "line_dedup":
            assert after.count() == before.count()
        if name == "near_dedup":
            found = near_dedup.near_duplicates(before).collect()
            assert {r.doc_id for r in found if r.doc_id is not None and r.doc_id == r.component_id} == ids(after) - {None}
        if name == "best_fit_packing":
            n = {r.doc_id: r.n for r in before.groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
            first = {r.doc_id: r.n for r in after.filter("piece = 0").groupBy("doc_id").count().withColumnRenamed("count", "n").collect()}
            assert first == n


def test_an_empty_corpus_passes_all_stages(spark, tmp_path):
    docs = fx.empty(spark)
    for _, _, docs in stages(spark, docs, str(tmp_path)):
        assert docs.count() == 0
