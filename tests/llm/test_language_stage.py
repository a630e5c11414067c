"""The language stage of the pipeline drops what another language knows better, and keeps short and unheard ones."""

import random

import corpus_pipeline

WORDS = {"en": "the thing other weather whether then these though brother rather".split(), "fr": "les eaux leurs beaucoup oiseau peuvent toujours jour heureux lieu".split()}


def test_documents_of_another_language_go(spark):
    rng = random.Random(4)
    text = lambda lang, n=40: " ".join(rng.choice(WORDS[lang]) for _ in range(n))
    rows = [(i, text(lang), lang) for i, lang in enumerate(["en", "fr"] * 40)]
    rows += [(100, text("en"), "fr"), (101, text("fr"), "en"), (102, "12 34", "en"), (103, None, "en"), (104, text("fr"), None),
             (105, " ".join("zq" + rng.choice("xjkw") * 3 for _ in range(40)), "en"), (106, "fjord kvinde hvilken", "da")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()}
    assert kept == {*range(80), 104, 106}  # 100, 101, 105 stayed before
