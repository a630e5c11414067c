"""Local surrogates: rows are dealt out by key once, and weights are ranked inside the row."""

import math

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsmith.operators import explain
from tabsmith.plans.catalogue.explaining import COEFS, FixedLinear


def _rows(spark):
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(rng.normal(size=(90, 3)))], ["row", *COEFS])
    return VectorAssembler(inputCols=list(COEFS), outputCol="features").transform(df)


def test_one_shuffle_and_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(explain, "TASK_SUMS", 9)
    out = explain.local_surrogate(FixedLinear(), _rows(spark), list(COEFS), ["row"], [1.0, 0.1, 0.1], samples=20)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Window" not in plan  # two and a window before
    parts = out.select(F.spark_partition_id().alias("part"), "row").groupBy("part").agg(F.countDistinct("row").alias("n"))
    assert sum(r["n"] for r in parts.collect()) == 90 and out.rdd.getNumPartitions() == math.ceil(90 * 3 / 9)


def test_ranks(spark):
    out = explain.local_surrogate(FixedLinear(), _rows(spark), list(COEFS), ["row"], [1.0, 0.1, 0.1], samples=20, features=2)
    assert out.columns == ["row", "output", "feature", "weight", "rank"]
    got = {}
    for r in out.collect():
        got.setdefault(r["row"], {})[r["rank"]] = (r["feature"], r["weight"])
    assert len(got) == 90
    for ranks in got.values():
        assert sorted(ranks) == [1, 2] and abs(ranks[1][1]) >= abs(ranks[2][1])


def test_null_and_nan_weights(spark):
    class Odd:
        """No output where the first feature is large, not a number where it is small."""

        def transform(self, df):
            x = F.get(explain.vector_to_array("features"), F.lit(0))
            return df.withColumn("prediction", F.when(x < -0.5, F.lit(float("nan"))).otherwise(x))
    out = explain.local_surrogate(Odd(), _rows(spark), list(COEFS), ["row"], [0.01, 0.1, 0.1], samples=20)
    for r in out.groupBy("row").agg(F.sort_array(F.collect_list("rank")).alias("ranks")).collect():
        assert r["ranks"] == [1, 2, 3]
