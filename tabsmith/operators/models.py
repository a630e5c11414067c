"""Model families behind one small interface.

A family turns (training rows, parameters) into a fitted model whose ``transform`` adds
``prediction`` and, where the family has them, ``probability``.  Training rows have
``features`` (vector), ``label`` (double) and optionally ``weight``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.ml import classification as mlc
from pyspark.ml import regression as mlr
from pyspark.ml.classification import OneVsRest
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.session import cut_lineage
from tabsmith.functions.space import Choice, Real, Space, Whole
from tabsmith.operators.boosting import BoostedModel, Boosting, fit_boosting
from tabsmith.operators.kernel import KernelMachine, fit_kernel_machine
from tabsmith.operators.knn import knn_join
from tabsmith.operators.network import Network, fit_network

KEEP = ("prediction", "probability")


@dataclass
class Task:
    """What a family must know about the training rows."""

    classification: bool
    classes: int = 0
    rows: int = 0
    width: int = 0
    label_std: float = 1.0
    weighted: bool = False


@dataclass
class Family:
    """``space`` has the ranges that a search draws from; without one the defaults are used."""

    name: str
    fit: Callable[[DataFrame, Task, dict], Any]
    defaults: dict = field(default_factory=dict)
    space: Space | None = None
    slow: bool = False


def _weights(task: Task) -> dict:
    return {"weightCol": "weight"} if task.weighted else {}


def _fit_logistic(df: DataFrame, task: Task, p: dict):
    reg = 1.0 / (p["C"] * max(task.rows, 1))
    return mlc.LogisticRegression(regParam=reg, standardization=False, maxIter=p.get("max_iter", 100), **_weights(task)).fit(df)


def _fit_ridge(df: DataFrame, task: Task, p: dict):
    reg = p["alpha"] * task.label_std / max(task.rows, 1)
    solver = "normal" if task.width <= 4000 else "l-bfgs"
    return mlr.LinearRegression(regParam=reg, elasticNetParam=0.0, solver=solver, standardization=False).fit(df)


def _fit_forest(df: DataFrame, task: Task, p: dict):
    common = dict(numTrees=p["trees"], maxDepth=min(30, p["max_depth"]), minInstancesPerNode=p.get("min_rows", 1),
                  featureSubsetStrategy=p.get("max_features", "sqrt"), seed=42, **_weights(task))
    cls = mlc.RandomForestClassifier if task.classification else mlr.RandomForestRegressor
    return cls(**common).fit(df)


def _fit_boosting(df: DataFrame, task: Task, p: dict):
    common = dict(maxIter=p["trees"], maxDepth=p["max_depth"], stepSize=p["learning_rate"],
                  subsamplingRate=p.get("subsample", 1.0), seed=42)
    if not task.classification:
        return mlr.GBTRegressor(**common, **_weights(task)).fit(df)
    if task.classes <= 2:
        return mlc.GBTClassifier(**common, **_weights(task)).fit(df)
    # The booster separates two classes, so each class gets one.
    return OneVsRest(classifier=mlc.GBTClassifier(**common), parallelism=min(4, task.classes), **_weights(task)).fit(df)


def _fit_histogram(df: DataFrame, task: Task, p: dict) -> BoostedModel:
    """One booster for all classes; levels alone bound the tree unless ``leaves`` is given."""
    return fit_boosting(df, max(2, task.classes) if task.classification else 0, Boosting(
        p["trees"], p["max_depth"], p.get("leaves") or 2 ** p["max_depth"], p["learning_rate"], l1=p.get("l1", 0.0), l2=p.get("l2", 1.0),
        min_rows=p.get("min_rows", 1), rows=p.get("subsample", 1.0), columns=p.get("columns", 1.0), oblivious=p.get("oblivious", False)))


def _fit_svm(df: DataFrame, task: Task, p: dict):
    svc = mlc.LinearSVC(regParam=1.0 / (p["C"] * max(task.rows, 1)), maxIter=100, standardization=False)
    if task.classes <= 2:
        return svc.copy({svc.weightCol: "weight"}).fit(df) if task.weighted else svc.fit(df)
    return OneVsRest(classifier=svc, parallelism=min(4, task.classes), **_weights(task)).fit(df)


def _fit_kernel(df: DataFrame, task: Task, p: dict) -> KernelMachine:
    return fit_kernel_machine(df, max(2, task.classes) if task.classification else 0, p["C"], p["kernel"], p.get("epsilon", 0.1), p.get("landmarks", 256))


def _fit_mlp(df: DataFrame, task: Task, p: dict):
    layers = [task.width, *p["hidden"], max(2, task.classes)]
    return mlc.MultilayerPerceptronClassifier(layers=layers, maxIter=p.get("max_iter", 100), seed=42).fit(df)


def _fit_network(df: DataFrame, task: Task, p: dict) -> Network:
    return fit_network(df, max(2, task.classes) if task.classification else 0, p["hidden"], p["penalty"], p["rate"], p.get("epochs", 40), p.get("batches", 8))


def _fit_bayes(df: DataFrame, task: Task, p: dict):
    return mlc.NaiveBayes(modelType="gaussian", **_weights(task)).fit(df)


class AdaBoostModel:
    """Weighted vote of stumps (SAMME)."""

    def __init__(self, stumps: list, alphas: list[float], classes: int):
        self.stumps, self.alphas, self.classes = stumps, alphas, classes

    def transform(self, df: DataFrame) -> DataFrame:
        votes = [F.lit(0.0)] * self.classes
        out = df
        for i, (stump, alpha) in enumerate(zip(self.stumps, self.alphas)):
            out = stump.copy({stump.predictionCol: f"_p{i}"}).transform(out).drop("probability", "rawPrediction")
            votes = [v + F.when(F.col(f"_p{i}") == k, F.lit(alpha)).otherwise(0.0) for k, v in enumerate(votes)]
        total = sum(self.alphas) or 1.0
        out = out.withColumn("_v", F.array(*[v / F.lit(total) for v in votes]))
        best = F.array_position("_v", F.array_max("_v")) - 1
        out = out.withColumn("prediction", best.cast("double")).withColumn("probability", array_to_vector("_v"))
        return out.drop("_v", *[f"_p{i}" for i in range(len(self.stumps))])


def _fit_adaboost(df: DataFrame, task: Task, p: dict) -> AdaBoostModel:
    """Row weights are a column updated by expressions; a checkpoint every few rounds keeps
    the plan short and survives lost executors."""
    k = max(2, task.classes)
    rows = df.select("features", "label", (F.col("weight") if task.weighted else F.lit(1.0)).cast("double").alias("_w"))
    stumps, alphas = [], []
    for i in range(p["rounds"]):
        total = rows.agg(F.sum("_w")).first()[0]
        rows = rows.withColumn("_w", F.col("_w") / F.lit(total))
        stump = mlc.DecisionTreeClassifier(maxDepth=p.get("max_depth", 1), weightCol="_w", seed=42).fit(rows)
        scored = stump.transform(rows).select(
            "features", "label", "_w", (F.col("prediction") != F.col("label")).alias("_miss"))
        error = scored.agg(F.sum(F.when(F.col("_miss"), F.col("_w")).otherwise(0.0))).first()[0]
        if error >= 1.0 - 1.0 / k:
            if not stumps:
                stumps, alphas = [stump], [1.0]
            break
        alpha = math.log((1.0 - error) / max(error, 1e-12)) + math.log(k - 1.0)
        stumps.append(stump)
        alphas.append(alpha)
        if error <= 1e-12:
            break
        rows = scored.select("features", "label", F.when(
            F.col("_miss"), F.col("_w") * F.lit(math.exp(min(alpha, 500.0)))).otherwise(F.col("_w")).alias("_w"))
        if i % 5 == 4:
            rows = cut_lineage(rows)
    return AdaBoostModel(stumps, alphas, k)


class KnnModel:
    """Exact k nearest training rows.  Equal vectors get equal predictions, so each distinct
    vector is looked up once and joined back by its fingerprint."""

    def __init__(self, train: DataFrame, k: int, weights: str, classes: int):
        self.train, self.k, self.weights, self.classes = train, k, weights, classes

    def transform(self, df: DataFrame) -> DataFrame:
        vec = vector_to_array("features")
        keyed = df.withColumn("_qid", F.concat_ws(":", F.xxhash64(F.lit(1), vec), F.xxhash64(F.lit(2), vec, vec)))
        queries = keyed.select(F.col("_qid").alias("id"), vec.alias("vec")).dropDuplicates(["id"])
        donors = self.train.select(
            F.xxhash64(vec, "label").alias("id"), vec.alias("vec"), F.col("label").cast("double").alias("value"))
        near = knn_join(queries, donors, self.k).withColumnRenamed("value", "label")
        w = F.when(F.col("distance") == 0, F.lit(1e12)).otherwise(1.0 / F.nullif("distance", F.lit(0.0))) \
            if self.weights == "distance" else F.lit(1.0)
        near = near.withColumn("_w", w)
        if self.classes:
            sums = [F.sum(F.when(F.col("label") == c, F.col("_w")).otherwise(0.0)) for c in range(self.classes)]
            votes = near.groupBy("q_id").agg(F.array(*sums).alias("_v"))
            total = F.aggregate("_v", F.lit(0.0), lambda a, x: a + x)
            out = votes.select(F.col("q_id").alias("_qid"),
                               (F.array_position("_v", F.array_max("_v")) - 1).cast("double").alias("prediction"),
                               array_to_vector(F.transform("_v", lambda x: x / total)).alias("probability"))
        else:
            out = near.groupBy(F.col("q_id").alias("_qid")).agg((F.sum(F.col("_w") * F.col("label")) / F.sum("_w")).alias("prediction"))
        return keyed.join(out, "_qid", "left").drop("_qid")


def _fit_knn(df: DataFrame, task: Task, p: dict) -> KnnModel:
    return KnnModel(df.select("features", "label"), p["k"], p.get("weights", "uniform"), task.classes)


HIDDEN = ((64,), (128,), (256,), (128, 64), (256, 128))


def registry(classification: bool, fast: bool = False) -> dict[str, Family]:
    """Families by name; ``fast`` leaves out the slow ones.  The ranges of the search spaces are fixed values."""
    rate, share, penalty = Real(1e-3, 0.3, log=True), Real(0.5, 1.0), Real(1e-8, 10.0, log=True)
    fams = [
        Family("logistic_regression", _fit_logistic, {"C": 1.0}, {"C": Real(1e-4, 100.0, log=True)})
        if classification else
        Family("ridge", _fit_ridge, {"alpha": 1.0}, {"alpha": Real(1e-3, 100.0, log=True)}),
        Family("random_forest", _fit_forest, {"trees": 50, "max_depth": 10}, {
            "trees": Whole(50, 400, step=50), "max_depth": Whole(3, 25), "min_rows": Whole(1, 10), "max_features": Choice(("sqrt", "log2"))}),
        Family("gradient_boosting", _fit_boosting, {"trees": 50, "max_depth": 3, "learning_rate": 0.1}, {
            "trees": Whole(50, 300, step=50), "max_depth": Whole(2, 7), "learning_rate": rate, "subsample": share}),
        Family("histogram_boosting", _fit_histogram, {"trees": 100, "max_depth": 6, "learning_rate": 0.3}, {
            "trees": Whole(100, 500, step=100), "max_depth": Whole(3, 9), "learning_rate": rate, "subsample": share, "columns": share, "l1": penalty}, slow=True),
        Family("leafwise_boosting", _fit_histogram, {"trees": 100, "max_depth": 9, "leaves": 31, "learning_rate": 0.1, "l2": 0.0, "min_rows": 20}, {
            "trees": Whole(100, 500, step=100), "max_depth": Whole(3, 9), "learning_rate": rate, "leaves": Whole(20, 150), "subsample": share, "l1": penalty}, slow=True),
        Family("level_boosting", _fit_histogram, {"trees": 100, "max_depth": 6, "learning_rate": 0.1, "l2": 3.0, "oblivious": True}, {
            "trees": Whole(100, 500, step=100), "max_depth": Whole(3, 8), "learning_rate": rate, "l2": Real(1.0, 10.0)}, slow=True),
        Family("kernel_svm", _fit_kernel, {"C": 1.0, "kernel": "rbf"}, {"C": Real(1e-3, 100.0, log=True), "kernel": Choice(("rbf", "poly"))}, slow=True),
        Family("network", _fit_network, {"hidden": (64,), "penalty": 1e-4, "rate": 1e-3}, {
            "hidden": Choice(HIDDEN), "penalty": Real(1e-5, 1e-1, log=True), "rate": Real(1e-4, 1e-2, log=True)}, slow=True),
        Family("knn", _fit_knn, {"k": 5}, {"k": Whole(3, 30), "weights": Choice(("uniform", "distance"))}),
    ]
    if classification:
        fams += [
            Family("adaboost", _fit_adaboost, {"rounds": 100}),
            Family("naive_bayes", _fit_bayes),
            Family("linear_svm", _fit_svm, {"C": 1.0}, {"C": Real(1e-3, 100.0, log=True)}, slow=True),
            Family("mlp", _fit_mlp, {"hidden": (64,)}, {"hidden": Choice(HIDDEN)}, slow=True),
        ]
    return {f.name: f for f in fams if not (fast and f.slow)} | {
        n: f for n, f in CUSTOM.items() if f.name not in {x.name for x in fams}}


CUSTOM: dict[str, Family] = {}


def register_model(family: Family) -> None:
    """Add a family of your own to every registry."""
    CUSTOM[family.name] = family


# Names that users give to the families.
ALIASES = {
    "neural_net": "network", "neural_network": "network", "mlp": "network", "gradient_boosting": "gradient_boosting",
    "xgboost": "histogram_boosting", "lightgbm": "leafwise_boosting", "lgbm": "leafwise_boosting",
    "catboost": "level_boosting", "random_forest": "random_forest", "extra_trees": "random_forest",
    "adaboost": "adaboost", "svm": "kernel_svm", "knn": "knn", "naive_bayes": "naive_bayes",
    "logistic_regression": "linear", "linear": "linear", "linear_regression": "linear", "lasso": "linear", "ridge": "linear",
}


def requested_families(names, classification: bool, fast: bool = False) -> dict[str, Family]:
    """The named families in the given order; no match means all."""
    fams = registry(classification, fast)
    if not names:
        return fams
    linear = "logistic_regression" if classification else "ridge"
    wanted = [ALIASES.get(n, n) for n in names]
    wanted = [linear if n == "linear" else n for n in wanted]
    picked = {n: fams[n] for n in dict.fromkeys(wanted) if n in fams}
    return picked or fams


def score(model, df: DataFrame) -> DataFrame:
    """``df`` with the model's prediction (and probability), nothing else added."""
    drop = [c for c in (*KEEP, "rawPrediction") if c in df.columns]
    out = model.transform(df.drop(*drop))
    return out.drop("rawPrediction")


def has_probability(df: DataFrame) -> bool:
    return "probability" in df.columns


class VotingModel:
    """Mean probability (or mean prediction) of the members; hard votes when a member has no
    probabilities.  Members score the same rows one after the other, so nothing is joined."""

    def __init__(self, members: list[tuple[str, Any]], classes: int):
        self.members, self.classes = members, classes

    def transform(self, df: DataFrame) -> DataFrame:
        out, soft = df, True
        for i, (_, m) in enumerate(self.members):
            out = score(m, out).withColumnRenamed("prediction", f"_p{i}")
            if has_probability(out):
                out = out.withColumn(f"_q{i}", vector_to_array("probability")).drop("probability")
            else:
                soft = False
        n = len(self.members)
        if not self.classes:
            total = F.col("_p0")
            for i in range(1, n):
                total = total + F.col(f"_p{i}")
            out = out.withColumn("prediction", total / float(n))
        else:
            votes = []
            for c in range(self.classes):
                parts = [F.get(f"_q{i}", F.lit(c)) if soft else (F.col(f"_p{i}") == c).cast("double") for i in range(n)]
                total = parts[0]
                for x in parts[1:]:
                    total = total + x
                votes.append(total / float(n))
            out = out.withColumn("_v", F.array(*votes))
            out = out.withColumn("prediction", (F.array_position("_v", F.array_max("_v")) - 1).cast("double"))
            if soft:
                out = out.withColumn("probability", array_to_vector("_v"))
            out = out.drop("_v")
        return out.drop(*[f"_p{i}" for i in range(n)], *[f"_q{i}" for i in range(n)])


class StackingModel:
    """A final linear model on the members' outputs next to the original features."""

    def __init__(self, members: list[tuple[str, Any]], final, classes: int):
        self.members, self.final, self.classes = members, final, classes

    def transform(self, df: DataFrame) -> DataFrame:
        out = stack_features(self.members, df, self.classes).withColumnRenamed("features", "_plain")
        out = score(self.final, out.withColumnRenamed("_stacked", "features"))
        return out.drop("features").withColumnRenamed("_plain", "features")


def stack_features(members: list[tuple[str, Any]], df: DataFrame, classes: int) -> DataFrame:
    """Add ``_stacked``: original features followed by each member's outputs."""
    out, arrays = df, [vector_to_array("features")]
    for i, (_, m) in enumerate(members):
        out = score(m, out)
        if classes and has_probability(out):
            q = vector_to_array("probability")
            value = F.slice(q, 2, 1) if classes == 2 else q
        else:
            value = F.array(F.col("prediction"))
        out = out.withColumn(f"_m{i}", value).drop("prediction", "probability")
        arrays.append(F.col(f"_m{i}"))
    out = out.withColumn("_stacked", array_to_vector(F.concat(*arrays)))
    return out.drop(*[f"_m{i}" for i in range(len(members))])
