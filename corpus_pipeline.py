"""The training-data pipeline: quality, language, near duplicates, benchmark passages, tokens.

Each stage takes (spark, docs, sf_dir), works on all rows of ``docs`` and returns a DataFrame; all but the last return
the columns of documents.  ``run`` writes each stage's rows as Parquet and reads them again for the next, in the folder
that spark.checkpoint.dir names.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.session import ensure_checkpoint_dir
from tabsmith.llm import bpe, decontaminate, langid, ngram_join, quality
from tabsmith.llm.queries import table
from tabsmith.llm.text import small_batches

# No stage but the join and the passages can be said in SQL, so neither can the pipeline.
ORACLE_SQL = None
# A document goes if the classifier predicts label 0, or if another language than its own knows its n-grams best, or its
# own knows less than half of them.
LEAST_QUALITY, LEAST_KNOWN = 0.5, 0.5


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    model = quality.fit(docs, table(spark, sf_dir, "labels"), F.lit(True))
    return quality.score(docs, model, least=LEAST_QUALITY).select(*docs.columns)


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each half of the texts is judged by filters of the other half, since filters know all n-grams that taught them.

    Where the other half has nothing of a document's language, nothing speaks against it.
    """
    small_batches(spark)
    half, letters = F.pmod(F.xxhash64("text"), F.lit(2)), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    kept = []
    for side in (0, 1):
        model = langid.train(docs.where(half != side), F.lit(True), least=1)
        judged = langid.predict(docs.where(half == side), model, given="lang")
        agrees = (F.col("score") >= LEAST_KNOWN) & F.coalesce(F.col("lang_pred") == F.col("lang"), F.col("lang_pred") != "und")
        unheard = F.col("lang").isNotNull() & ~F.coalesce(F.col("lang").isin(model.languages), F.lit(False))
        kept.append(judged.where(letters & (agrees | unheard)).select(*docs.columns))
    return kept[0].unionAll(kept[1])


def one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return ngram_join.keep_one(docs, width=5, percent=75)


def no_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"), window=10)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded_sha256): the token ids, and the digest of the bytes that they decode to."""
    small_batches(spark)
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coded = bpe.encode(docs, path, public_tokenizers.PATTERN, back=True)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality classifier", good_quality), ("language ID", known_language), ("n-gram Jaccard join", one_of_similar),
    ("benchmark decontamination", no_test_items), ("byte-level BPE", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4()}"
    docs = table(spark, sf_dir, "documents")
    for place, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{place}")
        docs = spark.read.parquet(f"{folder}/{place}")
    return docs
