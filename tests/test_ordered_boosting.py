"""Ordered target statistics by brute force, level trees, and held-out scores on tables with categories."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabsmith.operators import ordered_boosting as ob
from tabsmith.operators import tree_shapley
from tabsmith.operators.boosting import Boosting, fit_boosting, gradients
from tabsmith.operators.models import Task, registry, requested_families
from tabsmith.operators.trees import LevelTree
from tabsmith.sources import runs as run_store


@pytest.fixture(scope="module")
def table(spark):
    """A hot category with half of the rows, rare ones, nulls, ties in the order."""
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        kind = None if i % 11 == 0 else "hot" if i % 2 else f"k{rng.integers(0, 40)}"
        rows.append((i, kind, "ab"[i % 2 * (i % 3)% 2], float(rng.normal()) if i % 13 else None, float(i % 5), int(rng.integers(0, 300))))
    return spark.createDataFrame(rows, "id long, kind string, side string, x double, y double, place long").repartition(4).persist()


@pytest.mark.parametrize("bucket_rows", [10, 1000])
def test_statistics_by_brute_force(table, bucket_rows):
    got = {r["id"]: r for r in ob.ordered_statistics(table, ["kind", "side"], {"y": F.col("y"), "z": F.col("y") * 2}, F.col("place"), 300, 1.5, bucket_rows).collect()}
    rows = table.collect()
    mean = sum(r["y"] for r in rows) / len(rows)
    assert len(got) == len(rows)
    for r in rows:
        for c in ("kind", "side"):
            before = [o["y"] for o in rows if o[c] == r[c] and o["place"] < r["place"]]
            want = (sum(before) + 1.5 * mean) / (len(before) + 1.5)
            assert abs(got[r["id"]][f"{c}~y"] - want) < 1e-9 and abs(got[r["id"]][f"{c}~z"] - 2 * want) < 1e-9
    assert set(table.columns) < set(got[0].asDict())


def naive_levels(x, g, h, depth, l2):
    """Level by level the split that gains most over all nodes together."""
    node, levels = np.zeros(len(x), int), []
    value = lambda m: (g[m].sum() ** 2 / (h[m].sum() + l2)) if m.any() else 0.0
    for _ in range(depth):
        best = (1e-9,)
        for j in range(x.shape[1]):
            for t in np.unique(x[:, j])[:-1]:
                left = x[:, j] <= t
                gain = 0.5 * sum(value((node == k) & left) + value((node == k) & ~left) - value(node == k) for k in np.unique(node))
                if gain > best[0] + 1e-9:
                    best = (gain, j, t)
        if len(best) == 1:
            break
        levels.append(best[1:])
        node = 2 * node + ~(x[:, best[1]] <= best[2])
    return levels, np.array([-g[node == k].sum() / (h[node == k].sum() + l2) for k in node])


@pytest.mark.parametrize("classes", [0, 3])
def test_level_trees_equal_naive_growth(spark, classes):
    rng = np.random.default_rng(2)
    x = np.round(rng.normal(size=(200, 3)), 1)
    y = (x[:, 0] * 2 - x[:, 2]) if not classes else ((x[:, 0] > 0).astype(float) + (x[:, 1] > 0.3))
    rows = spark.createDataFrame([(Vectors.dense(a), float(b)) for a, b in zip(x, y)], ["features", "label"]).repartition(3)
    model = fit_boosting(rows, classes, Boosting(rounds=2, depth=3, rate=1.0, l2=1.0, bins=200, oblivious=True))
    margin = np.tile(model.base, (200, 1)).astype(float)
    for group in model.rounds:
        g, h = gradients(margin, y, np.ones(200), classes)
        for k, tree in enumerate(group):
            levels, values = naive_levels(x, g[:, k], h[:, k], 3, 1.0)
            assert isinstance(tree, LevelTree) and [f for f, _ in tree.levels] == [f for f, _ in levels]
            assert np.allclose([t for _, t in tree.levels], [t for _, t in levels]) and np.allclose(tree.scores(x)[:, 0], values)
            assert np.array_equal(tree.leaves(x), super(LevelTree, tree).leaves(x)) and tree.cover[0] == 200
        margin += np.column_stack([t.scores(x)[:, 0] for t in group])
    values = tree_shapley.tree_shapley(model, rows.withColumn("id", F.monotonically_increasing_id()), ["a", "b", "c"], ["id"])
    expected = tree_shapley.ensemble_of(spark, model).expected()
    sums = sorted(r["s"] + expected[r["output"]] for r in values.groupBy("id", "output").agg(F.sum("value").alias("s")).collect())
    assert np.allclose(sums, np.sort(model.margins(x).ravel()))


def test_own_rows_are_not_seen(spark):
    """Categories of one row each say nothing; statistics of all rows would give the target away, ordered ones do not."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 800).astype(float)
    x = np.where(rng.random(800) < 0.8, y, 1 - y)
    df = spark.createDataFrame([(i, f"only{i}", float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, name string, x double, y double").repartition(3)
    train, test = df.where("id < 500"), df.where("id >= 500")
    model = ob.fit_ordered_boosting(train, ["x"], ["name"], "y", 2, Boosting(rounds=5, depth=2, rate=0.5, l2=1.0, oblivious=True), key=["id"])
    out = model.transform(test)
    assert out.columns == [*test.columns, "prediction", "probability"]
    assert out.agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0] > 0.74
    assert dict(zip(model.names, model.featureImportances.toArray()))["x"] > 0.8


def test_classes_unknown_categories_and_gaps(table):
    labelled = table.withColumn("label", F.when(F.col("kind") == "hot", 2).when(F.col("side") == "a", 0).otherwise(1).cast("double"))
    labelled = labelled.withColumn("label", F.when(F.col("id") % 50 != 0, F.col("label")))
    model = ob.fit_ordered_boosting(labelled, ["x"], ["kind", "side"], "label", 3, Boosting(rounds=4, depth=3, rate=0.5, oblivious=True), key=["id"])
    out = model.transform(labelled)
    assert out.where("label is not null").agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0] > 0.9
    new = labelled.limit(3).withColumn("kind", F.lit("never seen")).withColumn("x", F.lit(None).cast("double"))
    assert model.transform(new).where("prediction is null").count() == 0
    assert ob.fit_ordered_boosting(labelled.where("id < 0"), ["x"], ["kind"], "label", 2).transform(labelled.where("id < 0")).count() == 0


def test_family_and_saved_trees(spark, table, tmp_path):
    assert list(requested_families(["catboost"], True)) == ["level_boosting"]
    rows = spark.createDataFrame([(Vectors.dense([i % 7, i % 3]), float(i % 7 > 3)) for i in range(80)], ["features", "label"])
    model = registry(True)["level_boosting"].fit(rows, Task(True, 2), {"trees": 2, "max_depth": 2, "learning_rate": 0.5, "oblivious": True})
    run_store.save_model(spark, model, str(tmp_path / "m"))
    x = np.array([[i % 7, i % 3] for i in range(20)], float)
    again = run_store.load_model(spark, str(tmp_path / "m"))
    assert np.allclose(again.margins(x), model.margins(x)) and isinstance(again.rounds[0][0], LevelTree)
