import corpus_pipeline as cp
from carrel.llm import jaccard, linededup, quality
from carrel.llm.common import stored
from tests.conftest import SMALL
from tests.llm.test_jaccard import brute


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in cp.STAGES] == ["quality", "line dedup", "near duplicates", "mix", "pack"]
    columns, before, kept = docs.columns, docs, {}
    for name, stage in cp.STAGES:
        after = stored(stage(spark, before, SMALL), "test")
        if name != "pack":
            assert after.columns == columns and after.dtypes == docs.dtypes
        kept[name] = after
        if name == "quality":
            model = quality.train(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))
            good = {r.doc_id for r in quality.scored(docs, model).where("predicted = 1").collect()}
            assert {r.doc_id for r in after.collect()} == good
        if name == "line dedup":
            assert {r.doc_id: r.text for r in linededup.without_recurring(before).collect()} == {r.doc_id: r.text for r in after.collect()}
            assert all(r.n_chars == len(r.text) for r in after.collect())
        if name == "near duplicates":
            comps = brute([(r.doc_id, r.text) for r in before.collect()])
            assert sorted(r.doc_id for r in after.collect()) == sorted(i for i, (n, c) in comps.items() if n == 0 or i == c)
        if name == "mix":
            words = lambda df: sum(len(r.text.split()) for r in df.collect())
            assert abs(words(after) - words(before)) <= 25
        before = after
    pieces = kept["pack"].collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in kept["mix"].collect()}
    assert cp.run(spark, SMALL).count() == len(pieces)


def test_near_duplicates_module_is_what_the_stage_uses(spark, docs):
    assert jaccard.keep_one(docs).columns == docs.columns
