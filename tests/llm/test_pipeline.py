"""The whole pipeline over the small tables, and stages on their own."""

import hashlib

import corpus_pipeline
from pyspark.sql import functions as F
from tabsmith.llm import quality, queries

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_of_documents(spark, docs):
    small = docs.where("doc_id < 12 or doc_id is null").drop("quality")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, small, SF).columns == small.columns


def test_run(spark):
    texts = {r.doc_id: r.text for r in queries.documents(spark, SF).collect()}
    quality = {r.doc_id: r.quality for r in queries.table(spark, SF, "labels").collect()}
    got = corpus_pipeline.run(spark, SF).collect()
    kept = {r.doc_id for r in got}
    assert len(got) == len(kept) > len(texts) // 2
    good = {i for i, q in quality.items() if q}
    bad = set(quality) - good
    assert len(kept & bad) <= len(bad) * 0.1
    same = sum(r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() for r in got)
    assert same >= len(got) * 0.9 and all(r.n_tokens == len(r.ids) for r in got)


def test_first_stage_is_the_decision_of_the_classifier(spark):
    sf = "/root/testdata/sf0.1"
    docs = queries.documents(spark, sf)
    scored = quality.score(docs, quality.fit(docs, queries.table(spark, sf, "labels"), F.lit(True))).select("doc_id", "score", "predicted").collect()
    assert any(0.1 <= r.score < 0.5 for r in scored)
    assert {r.doc_id for r in corpus_pipeline.good_quality(spark, docs, sf).collect()} == {r.doc_id for r in scored if r.predicted == 1}
