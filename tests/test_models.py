"""End-to-end runs, ensembles, explanations, saved bundles, streams."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsmith import AutoTable
from tabsmith.operators import explain
from tabsmith.operators.models import Task, VotingModel, registry, requested_families, score
from tabsmith.plans.autotable import TableScorer
from tabsmith.plans.catalogue.explaining import COEFS, FixedLinear
from tabsmith.plans.search import default_plan
from tabsmith.sources import runs as run_store
from tabsmith.streaming.scoring import score_stream

ONE = (("median", "robust", "onehot"),)
LIGHT = {"random_forest": {"trees": 5, "max_depth": 4}, "adaboost": {"rounds": 4}}


@pytest.fixture(scope="module")
def flowers(spark):
    rng = np.random.default_rng(42)
    kind = rng.integers(0, 3, 150)
    pdf = pd.DataFrame({
        "key": range(150),
        "petal": rng.normal(kind * 2.0, 0.4), "sepal": rng.normal(5.8 - kind, 0.8), "noise": rng.normal(size=150),
        "soil": rng.choice(["clay", "sand"], 150), "when": ["2024-01-0%d" % (1 + i % 9) for i in range(150)],
        "species": np.array(["setosa", "versicolor", "virginica"])[kind]})
    pdf.loc[pdf["key"] % 10 == 0, "petal"] = np.nan
    return spark.createDataFrame(pdf).persist()


@pytest.fixture(scope="module")
def fitted(flowers):
    return AutoTable(flowers, "Species", key=["key"], trials=0, grid=ONE, params=LIGHT,
                     models=["linear", "random_forest", "naive_bayes"]).run()


def test_leaderboard_and_prediction(fitted, flowers):
    assert fitted.target == "species" and fitted.problem_type == "classification"
    names = [r["model_name"] for r in fitted.leaderboard().collect()]
    assert {"voting_ensemble", "stacking_ensemble"} <= set(names) and len(names) == 5
    out = fitted.scorer.predict(flowers.drop("species")).join(flowers.select("key", "species"), "key")
    assert out.where("prediction = species").count() > 120
    assert out.where("confidence > 1 or confidence < 0").count() == 0


def test_missing_columns_are_filled(fitted, flowers):
    out = fitted.scorer.predict(flowers.select("key", "petal", "sepal"))
    assert out.count() == 150 and "soil" in out.columns
    with pytest.raises(ValueError, match="lacks columns"):
        fitted.scorer.predict(flowers.select("key"), fill=False)


def test_saved_bundle_scores_the_same(spark, fitted, flowers, tmp_path):
    fitted.save(str(tmp_path / "bundle"), str(tmp_path / "runs"), "flowers")
    back = TableScorer.load(spark, str(tmp_path / "bundle"))
    a = fitted.scorer.predict(flowers).select("key", F.col("prediction").alias("a"))
    assert back.predict(flowers).join(a, "key").where("prediction <> a").count() == 0
    assert run_store.completed_runs(spark, str(tmp_path / "runs")).first()["best_model"] == fitted.entries[0].model_name
    every = {e.model_name: e.model for e in fitted.entries}
    for name in ("voting_ensemble", "stacking_ensemble"):
        run_store.save_model(spark, every[name], str(tmp_path / name))
        again = run_store.load_model(spark, str(tmp_path / name))
        val = fitted.prepared.val
        assert score(again, val).select("prediction").collect() == score(every[name], val).select("prediction").collect()


def test_adaboost_and_neighbours(spark, fitted, tmp_path):
    p = fitted.prepared
    for name, params in (("adaboost", {"rounds": 6}), ("knn", {"k": 3, "weights": "distance"})):
        model = registry(True)[name].fit(p.train, p.task, params)
        scored = score(model, p.val)
        assert scored.where("label = prediction").count() > 0.6 * p.val.count()
        run_store.save_model(spark, model, str(tmp_path / name))
        back = score(run_store.load_model(spark, str(tmp_path / name)), p.val)
        assert back.where("label = prediction").count() == scored.where("label = prediction").count()


def test_vote_of_one_is_the_model(fitted):
    p = fitted.prepared
    e = next(e for e in fitted.entries if e.model_name == "naive_bayes")
    alone = score(e.model, p.val).select("prediction").collect()
    assert score(VotingModel([("a", e.model)], p.task.classes), p.val).select("prediction").collect() == alone


def test_shapley_values_add_up(fitted):
    p = fitted.prepared
    e = next(e for e in fitted.entries if e.model_name == "random_forest")
    names = fitted.names
    base = explain.vector_means(p.val)
    values = explain.shapley_values(e.model, p.val, names, ["_order"], 3, permutations=4, base=base)
    sums = values.groupBy("_order", "output").agg(F.sum("value").alias("s")).where("output = 0")
    from pyspark.ml.functions import array_to_vector, vector_to_array
    at_base = score(e.model, p.val.limit(1).select(array_to_vector(F.array(*[F.lit(float(b)) for b in base])).alias("features")))
    f0 = float(at_base.first()["probability"][0])
    got = score(e.model, p.val).select("_order", vector_to_array("probability")[0].alias("f")).join(sums, "_order")
    assert got.where(F.abs(F.col("f") - f0 - F.col("s")) > 1e-9).count() == 0


def test_sampled_shapley_is_exact_for_a_linear_model(spark):
    x = np.random.default_rng(0).normal(size=(50, 3))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list(COEFS)).assign(row=range(50)))
    vec = VectorAssembler(inputCols=list(COEFS), outputCol="features").transform(df)
    got = explain.shapley_values(FixedLinear(), vec, list(COEFS), ["row"], permutations=2).where("feature = 'l_tax'").orderBy("row")
    assert [r["value"] for r in got.collect()] == pytest.approx((50.0 * (x[:, 2] - x[:, 2].mean())).tolist())


def test_counterfactuals_really_flip(fitted, flowers):
    rows = fitted.counterfactuals(flowers, ["key"]).collect()
    assert rows and all(r["base_prediction"] != r["new_prediction"] and r["rank"] <= 3 for r in rows)


def test_regression_end_to_end(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 4))
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(target=3 * x[:, 0] - 2 * x[:, 1] + rng.normal(0, 0.5, 200))
    auto = AutoTable(spark.createDataFrame(pdf), "target", trials=0, grid=(("mean", "standard", "onehot"),), models=["ridge"],
                     ensembles=False, keep_share=1.0).run()
    assert auto.problem_type == "regression" and auto.entries[0].metrics["r2"] > 0.9
    assert [r["feature"] for r in auto.importance().collect()][:2] == ["a", "b"]


def test_requested_families():
    assert list(requested_families(["lgbm", "xgboost", "linear"], True)) == ["leafwise_boosting", "histogram_boosting", "logistic_regression"]
    assert set(requested_families(["unheard_of"], False)) == set(registry(False))
    plan = default_plan({"rows": 100, "task": "classification", "cat_feats": 5, "missing_pct": 0.0, "high_skew": [], "classes": 2})
    assert plan["models"][0] == "gradient_boosting" and plan["trials"] == 12 and plan["metric"] == "roc_auc"


def test_stream_scores_like_a_batch(spark, fitted, flowers, tmp_path):
    flowers.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(flowers.schema).parquet(str(tmp_path / "in"))
    run = score_stream(stream, lambda df: fitted.scorer.predict(df).select("key", "prediction"), str(tmp_path / "out"),
                       str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    want = fitted.scorer.predict(flowers).select("key", F.col("prediction").alias("w"))
    assert got.join(want, "key").where("prediction = w").count() == 150


def test_ridge_equals_the_closed_form(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 2))
    y = x @ [1.5, -2.0] + rng.normal(0, 0.1, 120)
    df = spark.createDataFrame(pd.DataFrame({"a": x[:, 0], "b": x[:, 1], "label": y}))
    vec = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(df)
    model = registry(False)["ridge"].fit(vec, Task(False, rows=120, width=2, label_std=float(y.std())), {"alpha": 5.0})
    xc, yc = x - x.mean(axis=0), y - y.mean()
    assert model.coefficients.toArray() == pytest.approx(np.linalg.solve(xc.T @ xc + 5.0 * np.eye(2), xc.T @ yc), abs=1e-8)


def test_exact_shapley_of_the_winner(flowers):
    auto = AutoTable(flowers, "species", key=["key"], trials=0, grid=ONE, params=LIGHT, models=["random_forest"], ensembles=False).run()
    values = auto.exact_shapley()
    rows, outputs = auto.prepared.val.count(), 3
    assert values.count() == rows * outputs * len(auto.names)
    top = values.groupBy("feature").agg(F.avg(F.abs("value")).alias("v")).orderBy(F.desc("v")).first()["feature"]
    assert top in ("petal", "sepal")
