"""Exact Shapley values of trees against sums over all coalitions."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.classification import OneVsRest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabsmith.operators import tree_shapley as ts
from tabsmith.operators.boosting import Boosting, fit_boosting
from tabsmith.operators.models import Task, registry
from tabsmith.operators.trees import Tree

NAMES = [f"x{j}" for j in range(6)]


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=(300, 6)), 1)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 2] > 0)).astype(float)
    data = [(i, Vectors.dense(a), float(b), float(a[0] * 2 + a[3])) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, ["id", "features", "label", "number"]).repartition(3).persist()


def expected_in(tree, x, inside, node=0):
    """The tree's output when only the features ``inside`` are known."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    sides = tree.left[node], tree.right[node]
    if f in inside:
        return expected_in(tree, x, inside, sides[0] if tree.goes_left(node, x[f:f + 1])[0] else sides[1])
    share = tree.cover[sides[0]] / tree.cover[list(sides)].sum() if tree.cover[list(sides)].sum() else 0.5
    return share * expected_in(tree, x, inside, sides[0]) + (1 - share) * expected_in(tree, x, inside, sides[1])


def enumerated(trees, x):
    m = len(x)
    said = {s: sum(expected_in(t, x, s) for t in trees) for k in range(m + 1) for s in combinations(range(m), k)}
    out = []
    for j in range(m):
        rest = [f for f in range(m) if f != j]
        out.append(sum(math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) * (said[tuple(sorted((*s, j)))] - said[s])
                       for k in range(m) for s in combinations(rest, k)))
    return np.array(out)


def check(spark, rows, model, score, ids=(0, 7, 50, 123)):
    """Values of some rows equal the sums over coalitions; those of all rows add up to the score."""
    found = ts.ensemble_of(spark, model)
    values = ts.tree_shapley(model, rows, NAMES, ["id"])
    at = {r["id"]: np.array(r["features"]) for r in rows.where(F.col("id").isin(*ids)).collect()}
    got = {(r["id"], r["output"], r["feature"]): r["value"] for r in values.where(F.col("id").isin(*ids)).collect()}
    for i in ids:
        want = enumerated(found.trees, at[i])
        assert np.allclose([[got[i, k, n] for k in range(want.shape[1])] for n in NAMES], want, atol=1e-9)
    expected = found.expected()
    sums = values.groupBy("id", "output").agg(F.sum("value").alias("s")).collect()
    assert len(sums) == 300 * len(expected)
    said = {r["id"]: r["s"] for r in rows.select("id", score.alias("s")).collect()} if not hasattr(score, "columns") else {r["id"]: r["s"] for r in score.collect()}
    for r in sums:
        assert abs(r["s"] + expected[r["output"]] - np.atleast_1d(said[r["id"]])[r["output"]]) < 1e-8


def test_forest_and_tree_probabilities(spark, rows):
    for cls, more in ((mlc.RandomForestClassifier, {"numTrees": 4}), (mlc.DecisionTreeClassifier, {})):
        model = cls(maxDepth=5, seed=3, **more).fit(rows)
        check(spark, rows, model, model.transform(rows).select("id", vector_to_array("probability").alias("s")))


def test_boosted_and_forest_regression(spark, rows):
    for model in (mlr.GBTRegressor(maxIter=3, maxDepth=4, seed=1, labelCol="number").fit(rows),
                  mlr.RandomForestRegressor(numTrees=3, maxDepth=6, seed=1, labelCol="number", subsamplingRate=0.5).fit(rows)):
        check(spark, rows, model, model.transform(rows).select("id", F.array("prediction").alias("s")))


def test_boosters_of_classes(spark, rows):
    two = rows.withColumn("label", (F.col("label") > 0).cast("double"))
    model = mlc.GBTClassifier(maxIter=3, maxDepth=3, seed=1).fit(two)
    check(spark, two, model, model.transform(two).select("id", F.array(F.get(vector_to_array("rawPrediction"), F.lit(1))).alias("s")))
    ours = fit_boosting(rows, 3, Boosting(rounds=3, depth=4, leaves=7))
    at = {r["id"]: ours.margins(np.array([r["features"]]))[0].tolist() for r in rows.collect()}
    check(spark, rows, ours, spark.createDataFrame(list(at.items()), "id long, s array<double>"))


def test_stumps_and_one_against_rest(spark, rows):
    vote = registry(True)["adaboost"].fit(rows, Task(True, 3), {"rounds": 3, "max_depth": 2})
    check(spark, rows, vote, vote.transform(rows).select("id", vector_to_array("probability").alias("s")))
    each = OneVsRest(classifier=mlc.GBTClassifier(maxIter=2, maxDepth=2, seed=1)).fit(rows)
    assert len(ts.ensemble_of(spark, each).base) == 3
    with pytest.raises(ValueError):
        ts.ensemble_of(spark, mlc.LogisticRegression(maxIter=1).fit(rows))


def test_categories_zero_cover_and_parts(spark, rows, monkeypatch):
    """A categorical split, a node that no training row reached, features met twice, trees sent in parts."""
    monkeypatch.setattr(ts, "PART_NODES", 10)
    tree = Tree(np.array([0, 1, 0, -1, -1, -1, 2, -1, -1]), np.array([0.0, 0.3, 0.5, 0, 0, 0, 0, 0, 0]), np.array([1, 3, 5, -1, -1, -1, 7, -1, -1]),
                np.array([2, 4, 6, -1, -1, -1, 8, -1, -1]), np.array([[0, 0], [0, 0], [0, 0], [1, 2], [3, 0], [0, 5], [0, 0], [7, 1], [2, 2]], float),
                np.array([10, 6, 4, 0, 6, 4, 0, 0, 0], float), categories={1: [0.1, 0.2, -0.5]})
    model = ts.Ensemble([tree, tree, tree], [1.0, 2.0])
    x = {r["id"]: np.array(r["features"]) for r in rows.collect()}
    score = [(i, (model.base + sum(t.scores(a[None])[0] for t in model.trees)).tolist()) for i, a in x.items()]
    check(spark, rows, model, spark.createDataFrame(score, "id long, s array<double>"))
    assert ts.tree_shapley(model, rows.where("id < 0"), NAMES, ["id"]).count() == 0


def test_deep_ways():
    """A chain over twelve features, more patterns than rows."""
    rng = np.random.default_rng(1)
    m = 12
    n = 2 * m + 1
    feature, left, right = np.full(n, -1), np.full(n, -1), np.full(n, -1)
    for j in range(m):
        feature[2 * j], left[2 * j], right[2 * j] = j, 2 * j + 1, 2 * j + 2
    cover = np.zeros(n)
    cover[0] = 1000.0
    for j in range(m):
        cover[2 * j + 1] = cover[2 * j] * rng.uniform(0.1, 0.9)
        cover[2 * j + 2] = cover[2 * j] - cover[2 * j + 1]
    tree = Tree(feature, np.zeros(n), left, right, rng.normal(size=(n, 1)), cover)
    x = rng.normal(size=(5, m))
    for row, got in zip(x, ts.tree_values(tree, x)):
        assert np.allclose(got, enumerated([tree], row), atol=1e-10)
