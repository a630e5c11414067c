"""Saved models and the tables that record runs."""

from __future__ import annotations

import datetime as dt
import json

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.operators.boosting import BoostedModel
from tabsmith.operators.kernel import KernelMachine, KernelMap
from tabsmith.operators.models import AdaBoostModel, KnnModel, StackingModel, VotingModel
from tabsmith.operators.network import Network
from tabsmith.operators.trees import LevelTree, Tree

TREES = ("round int, output int, feature array<long>, threshold array<double>, left array<long>, right array<long>, value array<array<double>>, "
         "cover array<double>, gain array<double>, levels array<struct<feature: long, threshold: double>>")
RUNS = ("run_id string, dataset string, status string, problem_type string, target string, n_rows long, n_cols int, "
        "best_model string, best_score double, recipe string, seconds double, created_at timestamp")


def _put(spark: SparkSession, path: str, facts: dict) -> None:
    spark.createDataFrame([(json.dumps(facts),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def _get(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_model(spark: SparkSession, model, path: str) -> None:
    """Save a fitted model, ensembles with all their members."""
    if isinstance(model, (VotingModel, StackingModel)):
        names = [n for n, _ in model.members]
        kind = "voting" if isinstance(model, VotingModel) else "stacking"
        for i, (_, m) in enumerate(model.members):
            save_model(spark, m, f"{path}/member{i}")
        if kind == "stacking":
            save_model(spark, model.final, f"{path}/final")
        _put(spark, f"{path}/facts", {"kind": kind, "members": names, "classes": model.classes})
    elif isinstance(model, AdaBoostModel):
        PipelineModel([s.copy({s.predictionCol: f"_p{i}", s.probabilityCol: f"_q{i}", s.rawPredictionCol: f"_r{i}"})
                       for i, s in enumerate(model.stumps)]).write().overwrite().save(f"{path}/stumps")
        _put(spark, f"{path}/facts", {"kind": "adaboost", "alphas": model.alphas, "classes": model.classes})
    elif isinstance(model, KnnModel):
        model.train.write.mode("overwrite").parquet(f"{path}/train")
        _put(spark, f"{path}/facts", {"kind": "knn", "k": model.k, "weights": model.weights, "classes": model.classes})
    elif isinstance(model, Network):
        _put(spark, f"{path}/facts", {"kind": "network", "flat": model.flat.tolist(), "sizes": model.sizes, "classes": model.classes, "losses": model.losses})
    elif isinstance(model, KernelMachine):
        _put(spark, f"{path}/facts", {"kind": "kernel", "landmarks": model.to.landmarks.tolist(), "kernel": model.to.kernel, "gamma": model.to.gamma,
                                      "weights": model.weights.tolist(), "classes": model.classes, "sigmoids": model.sigmoids})
    elif isinstance(model, BoostedModel):
        rows = [(i, k, *(getattr(t, f).tolist() for f in ("feature", "threshold", "left", "right", "value", "cover", "gain")),
                 [(int(f), float(x)) for f, x in t.levels] if isinstance(t, LevelTree) else None)
                for i, group in enumerate(model.rounds) for k, t in enumerate(group)]
        spark.createDataFrame(rows, TREES).write.mode("overwrite").parquet(f"{path}/trees")
        _put(spark, f"{path}/facts", {"kind": "boosted", "base": model.base, "classes": model.classes, "width": model.width})
    else:
        PipelineModel([model]).write().overwrite().save(f"{path}/model")
        _put(spark, f"{path}/facts", {"kind": "single"})


def load_model(spark: SparkSession, path: str):
    facts = _get(spark, f"{path}/facts")
    kind = facts["kind"]
    if kind in ("voting", "stacking"):
        members = [(n, load_model(spark, f"{path}/member{i}")) for i, n in enumerate(facts["members"])]
        if kind == "voting":
            return VotingModel(members, facts["classes"])
        return StackingModel(members, load_model(spark, f"{path}/final"), facts["classes"])
    if kind == "adaboost":
        stumps = PipelineModel.load(f"{path}/stumps").stages
        stumps = [s.copy({s.probabilityCol: "probability", s.rawPredictionCol: "rawPrediction"}) for s in stumps]
        return AdaBoostModel(stumps, facts["alphas"], facts["classes"])
    if kind == "knn":
        return KnnModel(spark.read.parquet(f"{path}/train"), facts["k"], facts["weights"], facts["classes"])
    if kind == "network":
        return Network(np.array(facts["flat"]), facts["sizes"], facts["classes"], facts["losses"])
    if kind == "kernel":
        to = KernelMap(np.array(facts["landmarks"]), facts["kernel"], facts["gamma"])
        return KernelMachine(to, np.array(facts["weights"]), facts["classes"], facts["sigmoids"])
    if kind == "boosted":
        rounds: dict[int, list[Tree]] = {}
        for r in sorted(spark.read.parquet(f"{path}/trees").collect(), key=lambda r: (r["round"], r["output"])):
            arrays = [np.array(x) for x in r[2:-1]]
            rounds.setdefault(r["round"], []).append(
                Tree(*arrays) if r["levels"] is None else LevelTree(*arrays, levels=[(x["feature"], x["threshold"]) for x in r["levels"]]))
        return BoostedModel(list(rounds.values()), facts["base"], facts["classes"], facts["width"])
    return PipelineModel.load(f"{path}/model").stages[0]


def append_run(spark: SparkSession, root: str, run: dict, leaderboard: DataFrame, importance: DataFrame,
               classes: list[tuple[str, int]], missing: list[tuple[str, float]]) -> None:
    """Append one finished run to the run tables under ``root``."""
    rid = F.lit(run["run_id"]).alias("run_id")
    row = tuple(run.get(f.split()[0]) for f in RUNS.split(", "))
    row = (*row[:-1], row[-1] or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None))
    leaderboard.select(rid, "*").write.mode("append").parquet(f"{root}/leaderboard")
    importance.select(rid, "*").write.mode("append").parquet(f"{root}/importance")
    spark.createDataFrame(classes, "class string, n long").select(rid, "*").write.mode("append").parquet(f"{root}/classes")
    spark.createDataFrame(missing, "column string, pct double").select(rid, "*").write.mode("append").parquet(f"{root}/missing")
    spark.createDataFrame([row], RUNS).write.mode("append").partitionBy("status").parquet(f"{root}/runs")


def completed_runs(spark: SparkSession, root: str) -> DataFrame:
    """Completed runs; the filter prunes the partitions of the others."""
    return spark.read.parquet(f"{root}/runs").where("status = 'completed'")


def save_bundle(spark: SparkSession, path: str, prep: PipelineModel, model, facts: dict) -> None:
    prep.write().overwrite().save(f"{path}/preprocessor")
    save_model(spark, model, f"{path}/predictor")
    _put(spark, f"{path}/metadata", facts)


def load_bundle(spark: SparkSession, path: str) -> tuple[PipelineModel, object, dict]:
    return PipelineModel.load(f"{path}/preprocessor"), load_model(spark, f"{path}/predictor"), _get(spark, f"{path}/metadata")
