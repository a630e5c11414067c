"""Model search: tuning, leaderboard, ensembles, cross-validation, adaptive search."""

from __future__ import annotations

import time
import warnings
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import numeric_columns, ref, row_key
from tabsmith.operators.encode import LabelEncode, LabelModel
from tabsmith.operators.evaluate import evaluate, primary_metric
from tabsmith.operators.features import engineer_features
from tabsmith.operators.impute import Fill
from tabsmith.operators.models import (
    ALIASES, Family, StackingModel, Task, VotingModel, registry, requested_families, score, stack_features,
)
from tabsmith.operators.profile import TableProfile
from tabsmith.operators.roles import ColumnRoles, detect_id_columns, detect_problem_type, drop_all_unique_strings, split_columns
from tabsmith.operators.split import assign_folds, assign_split
from tabsmith.plans import parzen
from tabsmith.plans.recipe import FAILED, GRID, FittedRecipe, best_recipe

ORDER = "_order"  # repeatable hash of the row, carried along for splits and folds
LEADERBOARD = ("model_name string, model_type string, metric string, score double, cv_score double, seconds double, "
               "metrics map<string,double>, params map<string,string>")


@dataclass
class Entry:
    model_name: str
    metrics: dict[str, float]
    params: dict
    seconds: float
    model: Any
    model_type: str = "base"
    cv_score: float | None = None

    def primary(self, classification: bool) -> float:
        return self.metrics.get(primary_metric(classification), FAILED)


@dataclass
class Prepared:
    """A table ready for training: split, label and fitted recipe."""

    train: DataFrame
    val: DataFrame
    task: Task
    roles: ColumnRoles
    recipe: FittedRecipe
    recipe_scores: dict[str, float]
    label: LabelModel | None
    target: str

    def release(self) -> None:
        self.train.unpersist()
        self.val.unpersist()


def with_order(df: DataFrame, key: Sequence[str] | None, seed: int = 42) -> DataFrame:
    """Add the split order: a hash of the key columns, or of the whole row."""
    order = F.pmod(row_key(key or df.columns, seed), F.lit(1 << 52)).cast("double")
    return df.withColumn(ORDER, order)


def add_label(df: DataFrame, target: str, classification: bool) -> tuple[DataFrame, LabelModel | None]:
    df = df.where(ref(target).isNotNull())
    if not classification:
        return df.withColumn("label", ref(target).cast("double")), None
    model = LabelEncode.of([target]).fit(df)
    return model.transform(df), model


def balanced_weights(df: DataFrame, classes: int) -> DataFrame:
    """Add ``weight`` = n / (classes * class size)."""
    sizes = {r["label"]: r["count"] for r in df.groupBy("label").count().collect()}
    n = sum(sizes.values())
    w = F.lit(1.0)
    for c, size in sizes.items():
        w = F.when(F.col("label") == c, F.lit(n / (classes * size))).otherwise(w)
    return df.withColumn("weight", w)


def prepare(df: DataFrame, target: str, classification: bool, key: Sequence[str] | None = None, test_size: float = 0.2,
            grid=GRID, class_weight: str | None = None, seed: int = 42, parallelism: int = 4, **options) -> Prepared:
    """Drop useless columns, split, pick a recipe, and cache the transformed rows."""
    keyed = with_order(df, key, seed)
    labelled, label = add_label(keyed, target, classification)
    skip = [ORDER, "label", *(key or [])]
    ids = [c for c, _ in detect_id_columns(df, target)] + drop_all_unique_strings(df, target)
    roles = split_columns(labelled, target, [*dict.fromkeys([*ids, *skip])])
    roles.dropped = [c for c in dict.fromkeys([*ids, *(key or [])])]
    marked = assign_split(labelled, F.col(ORDER), "label" if classification else None, test_size)
    used = [*roles.features, "label", ORDER]
    # The split is read by every recipe: keep it, on disk where memory is short.
    marked = marked.select(*[ref(c) for c in used], "is_val").persist(StorageLevel.MEMORY_AND_DISK)
    train, val = marked.where(~F.col("is_val")).drop("is_val"), marked.where("is_val").drop("is_val")
    info = train.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
    task = Task(classification, len(label.classes) if label else 0, info["n"], label_std=info["s"] or 1.0)
    recipe, scores = best_recipe(train, val, roles, task, grid, parallelism, keep=[ORDER], **options)
    task.width = recipe.width
    ready = [recipe.transform(part).select("features", "label", ORDER) for part in (train, val)]
    if class_weight == "balanced" and classification:
        ready[0] = balanced_weights(ready[0], task.classes)
        task.weighted = True
    ready = [part.persist(StorageLevel.MEMORY_AND_DISK) for part in ready]
    for part in ready:
        part.count()
    marked.unpersist()
    return Prepared(ready[0], ready[1], task, roles, recipe, scores, label, target)


# tuning -----------------------------------------------------------------------
def cross_val_scores(family: Family, params: dict, folded: DataFrame, task: Task, k: int, parallelism: int = 4, folds: Sequence[int] | None = None) -> list[float]:
    """Primary metric per fold (of ``folds`` or all); ``folded`` has a ``fold`` column.  Folds run side by side."""

    def one(f: int) -> float:
        model = family.fit(folded.where(F.col("fold") != f), task, params)
        scored = score(model, folded.where(F.col("fold") == f)).drop("probability")
        return evaluate(scored, task.classification, task.classes)[primary_metric(task.classification)]
    folds = range(k) if folds is None else folds
    with ThreadPoolExecutor(max(1, min(len(folds), parallelism))) as pool:
        return list(pool.map(one, folds))


def tune(family: Family, folded: DataFrame, task: Task, trials: int, k: int, seconds: float | None = None,
         seed: int = 42, history: str | None = None) -> tuple[dict, float | None]:
    """Best parameters and mean fold score of a model-based search with successive halving over the folds.

    All trials are made unless ``seconds`` sets a time limit, checked between trials.  A trial that fails gives a
    warning.  With ``history`` trials are kept in the Parquet table of the family under that path, and a search that
    finds trials there goes on from them.
    """
    if not family.space or trials <= 0:
        return dict(family.defaults), None
    table = parzen.TrialTable(folded.sparkSession, history and f"{history}/{family.name}")
    parzen.search(lambda params, folds: cross_val_scores(family, params, folded, task, k, folds=folds), family.space, trials, k, table,
                  seconds, seed, family.defaults)
    found = parzen.best(table)
    return ({**family.defaults, **found.params}, found.value) if found else (dict(family.defaults), FAILED)


def train_one(family: Family, train: DataFrame, val: DataFrame, task: Task, trials: int, folded: DataFrame | None,
              k: int, seconds: float | None = None, params: dict | None = None) -> Entry:
    start = time.time()
    best, cv = (dict(family.defaults), None) if folded is None else tune(family, folded, task, trials, k, seconds)
    best.update(params or {})
    model = family.fit(train, task, best)
    metrics = evaluate(score(model, val), task.classification, task.classes)
    return Entry(family.name, metrics, best, round(time.time() - start, 2), model, cv_score=cv)


def sort_entries(entries: list[Entry], classification: bool) -> list[Entry]:
    return sorted(entries, key=lambda e: -e.primary(classification))


def add_voting(entries: list[Entry], val: DataFrame, task: Task, top: int = 5) -> Entry:
    start = time.time()
    members = [(e.model_name, e.model) for e in sort_entries(entries, task.classification)[:top]]
    model = VotingModel(members, task.classes)
    metrics = evaluate(score(model, val), task.classification, task.classes)
    return Entry("voting_ensemble", metrics, {"n_models": len(members)}, round(time.time() - start, 2), model, "ensemble")


def fit_stacking(bases: list[tuple[str, Family, dict, Any]], train: DataFrame, task: Task, k: int = 3) -> StackingModel:
    """Final linear model on out-of-fold outputs of the bases, original features included."""
    folded = assign_folds(train, F.col(ORDER), k, "label" if task.classification else None)
    parts = None
    for f in range(k):
        rest = folded.where(F.col("fold") != f)
        members = [(n, fam.fit(rest, task, params)) for n, fam, params, _ in bases]
        part = stack_features(members, folded.where(F.col("fold") == f), task.classes).select(
            F.col("_stacked").alias("features"), "label")
        parts = part if parts is None else parts.unionByName(part)
    name = "logistic_regression" if task.classification else "ridge"
    final = registry(task.classification)[name]
    parts = parts.persist(StorageLevel.MEMORY_AND_DISK)
    width = len(parts.first()["features"])
    model = final.fit(parts, Task(**{**task.__dict__, "width": width, "weighted": False}), final.defaults)
    parts.unpersist()
    return StackingModel([(n, m) for n, _, _, m in bases], model, task.classes)


def add_stacking(entries: list[Entry], train: DataFrame, val: DataFrame, task: Task, top: int = 4, k: int = 3) -> Entry | None:
    start = time.time()
    fams = registry(task.classification)
    best = [e for e in sort_entries(entries, task.classification) if e.model_type == "base"][:top]
    if len(best) < 2:
        return None
    model = fit_stacking([(e.model_name, fams[e.model_name], e.params, e.model) for e in best], train, task, k)
    metrics = evaluate(score(model, val), task.classification, task.classes)
    return Entry("stacking_ensemble", metrics, {"base_models": [e.model_name for e in best]},
                 round(time.time() - start, 2), model, "ensemble")


def train_all(train: DataFrame, val: DataFrame, task: Task, trials: int = 10, k: int = 5, models: Sequence[str] | None = None,
              seconds: float | None = None, ensembles: bool = True, params: dict[str, dict] | None = None, fast: bool | None = None) -> list[Entry]:
    """Train every requested family, add ensembles of three or more, best first.

    ``fast`` leaves out the slow families; unless it is given, only where no families are named and
    no more than ten trials are asked for.  A family that fails gives a warning.
    """
    families = requested_families(models, task.classification, fast=not models and trials <= 10 if fast is None else fast)
    folded = None
    if trials > 0:
        folded = assign_folds(train, F.col(ORDER), k, "label" if task.classification else None).persist(
            StorageLevel.MEMORY_AND_DISK)
    entries: list[Entry] = []
    failures: dict[str, str] = {}
    for name, family in families.items():
        try:
            entries.append(train_one(family, train, val, task, trials, folded, k, seconds, (params or {}).get(name)))
        except Exception as e:  # one family's failure leaves the others on the board
            failures[name] = f"{type(e).__name__}: {str(e)[:300]}"
            warnings.warn(f"{name}: {failures[name]}", RuntimeWarning, stacklevel=2)
    if folded is not None:
        folded.unpersist()
    if not entries:
        raise RuntimeError(f"no family could be trained: {failures}")
    if ensembles and len(entries) >= 3:
        voting = add_voting(entries, val, task)
        stacked = add_stacking(entries, train, val, task)
        entries += [voting] + ([stacked] if stacked else [])
    return sort_entries(entries, task.classification)


def leaderboard_table(spark, entries: list[Entry], classification: bool) -> DataFrame:
    """Rows ordered by the primary metric, best first."""
    metric = primary_metric(classification)
    rows = [(e.model_name, e.model_type, metric, float(e.primary(classification)), e.cv_score, float(e.seconds),
             {k: float(v) for k, v in e.metrics.items()}, {k: str(v) for k, v in e.params.items()}) for e in entries]
    return spark.createDataFrame(rows, LEADERBOARD).orderBy(F.desc_nulls_last("score"), "model_name")


# tools ------------------------------------------------------------------------
@dataclass
class Benchmark:
    best_model: str
    best_score: float
    metric: str
    entries: list[Entry]
    prepared: Prepared
    config: dict = field(default_factory=dict)

    def leaderboard(self, spark, top: int | None = 6) -> DataFrame:
        return leaderboard_table(spark, self.entries if top is None else self.entries[:top], self.prepared.task.classification)


def quick_benchmark(df: DataFrame, target: str, models: Sequence[str] | None = None, trials: int = 10,
                    class_weight: str | None = None, problem_type: str | None = None, key: Sequence[str] | None = None,
                    grid=GRID, params: dict[str, dict] | None = None, **options) -> Benchmark:
    """Train the chosen families once and rank them; ``class_weight='balanced'`` weights rows."""
    classification = (problem_type or detect_problem_type(df, target)) == "classification"
    prepared = prepare(df, target, classification, key, grid=grid, class_weight=class_weight, **options)
    entries = train_all(prepared.train, prepared.val, prepared.task, trials, 3, models, ensembles=False, params=params)
    best = entries[0]
    return Benchmark(best.model_name, best.primary(classification), primary_metric(classification), entries, prepared,
                     {"models": list(models or []), "trials": trials, "class_weight": class_weight})


def deep_tune(df: DataFrame, target: str, model: str, trials: int = 40, **kw) -> Benchmark:
    """``quick_benchmark`` of one family with many trials."""
    return quick_benchmark(df, target, [model], trials, **kw)


def cross_validate(df: DataFrame, target: str, model: str, k: int = 5, problem_type: str | None = None,
                   key: Sequence[str] | None = None, params: dict | None = None) -> dict:
    """Fold scores of a family on mean-filled numeric features: mean, population std, and
    whether the std is below 0.05."""
    classification = (problem_type or detect_problem_type(df, target)) == "classification"
    name = ALIASES.get(model, model)
    name = ("logistic_regression" if classification else "ridge") if name == "linear" else name
    fams = registry(classification)
    if name not in fams:
        raise ValueError(f"{model!r} is not available; choose from {sorted(fams)}")
    cols = [c for c in numeric_columns(df, [target, *(key or [])])]
    labelled, label = add_label(with_order(df, key), target, classification)
    filled = Fill.of(cols, strategy="mode" if not cols else "mean").fit(labelled).transform(labelled)
    rows = filled.select(array_to_vector(F.array(*[ref(c).cast("double") for c in cols])).alias("features"), "label", ORDER)
    folded = assign_folds(rows, F.col(ORDER), k, "label" if classification else None).persist(StorageLevel.MEMORY_AND_DISK)
    info = folded.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
    task = Task(classification, len(label.classes) if label else 0, info["n"] * (k - 1) // k, len(cols), info["s"] or 1.0)
    scores = cross_val_scores(fams[name], {**fams[name].defaults, **(params or {})}, folded, task, k)
    folded.unpersist()
    return {"model": name, "cv_mean": float(np.mean(scores)), "cv_std": float(np.std(scores)), "cv_scores": scores,
            "reliable": bool(np.std(scores) < 0.05)}


def cv_table(spark, report: dict) -> DataFrame:
    rows = [(report["model"], i, s, report["cv_mean"], report["cv_std"], report["reliable"])
            for i, s in enumerate(report["cv_scores"])]
    return spark.createDataFrame(rows, "model string, fold int, score double, cv_mean double, cv_std double, reliable boolean")


FINDINGS = "finding string, suggestion string, value double"


def analyze_errors(profile: TableProfile, scores: Sequence[float], classification: bool) -> DataFrame:
    """Findings from class balance, the best score and the spread between models."""
    rows: list[tuple[str, str, float]] = []
    best = max(scores)
    spread = round(best - min(scores), 4) if len(scores) > 1 else 0.0
    if classification:
        sizes = [n for _, n in profile.class_counts]
        ratio = sizes[-1] / sizes[0] if sizes else 1.0
        if ratio < 0.3:
            rows.append(("class_imbalance", "use balanced class weights", ratio))
        if best < 0.75:
            rows.append(("low_accuracy", "more trials or stronger families", best))
        elif best > 0.98:
            rows.append(("suspiciously_high_accuracy", "remove columns derived from the target", best))
    elif best < 0.6:
        rows.append(("poor_fit", "engineer features or use non-linear families", best))
    elif best > 0.99:
        rows.append(("likely_leakage", "remove columns derived from the target", best))
    if spread > 0.1:
        rows.append(("large_model_spread", "tune only the leading families", spread))
    if len(profile.numeric) > 10:
        rows.append(("many_numeric_features", "try feature selection", float(len(profile.numeric))))
    return profile.spark.createDataFrame(rows, FINDINGS)


def default_plan(facts: dict) -> dict:
    """Families, trials and settings from the size and shape of a table (``TableProfile.facts``)."""
    n, classification = facts["rows"], facts["task"] == "classification"
    linear = "logistic_regression" if classification else "ridge"
    if n < 500:
        models, trials = [linear, "random_forest", "svm"] + (["knn"] if classification else []), 12
    elif n < 5000:
        models, trials = ["gradient_boosting", "random_forest", linear], 25
    else:
        models, trials = ["gradient_boosting", "random_forest"], 40
    if facts["cat_feats"] > 3:
        models = ["gradient_boosting"] + [m for m in models if m != "gradient_boosting"]
    skewed = len(facts["high_skew"])
    scaling = "robust" if facts["missing_pct"] > 5 or skewed > 2 else "power" if skewed else "standard"
    metric = "r2" if not classification else "roc_auc" if facts.get("classes") == 2 else "f1_weighted"
    return {"models": models[:4], "trials": trials, "scaling": scaling, "metric": metric,
            "balance_classes": classification and facts.get("imbalance", 1.0) < 0.4}


HISTORY = "iteration int, action string, model string, score double, config string"


def adaptive_search(df: DataFrame, target: str, problem_type: str | None = None, key: Sequence[str] | None = None,
                    trials: int = 15, deep_trials: int = 25, goal: float = 0.85, **options) -> tuple[Benchmark, list[tuple]]:
    """Investigate, benchmark, and when the score is below ``goal`` add features and tune the
    winner.  Returns the better benchmark and the history rows."""
    problem_type = problem_type or detect_problem_type(df, target)
    classification = problem_type == "classification"
    profile = TableProfile(df, target, "classification" if classification else "regression")
    issues = profile.issues()
    history = [(0, "investigate", None, None, ",".join(sorted({i for i, _, _ in issues})))]
    balanced = "balanced" if classification and any(i == "class_imbalance" for i, _, _ in issues) else None
    if profile.rows < 1000:
        models = ["random_forest", "logistic_regression", "svm"] if classification else ["ridge", "random_forest", "svm"]
    else:
        models = ["gradient_boosting", "random_forest"]
    first = quick_benchmark(df, target, models, trials, balanced, problem_type, key, **options)
    history.append((1, "quick_benchmark", first.best_model, first.best_score, f"trials={trials}"))
    if first.best_score >= goal:
        return first, history
    strategy = "aggregates" if profile.missing_pct > 5 else "interactions"
    richer, names = engineer_features(df.select(*[ref(c) for c in df.columns]), target, strategy,
                                      [c for c in numeric_columns(df, [target, *(key or [])])])
    history.append((2, f"engineer_{strategy}", None, None, ",".join(names)))
    second = deep_tune(richer, target, first.best_model, deep_trials, class_weight=balanced, problem_type=problem_type,
                       key=key, **options)
    history.append((3, "deep_tune", second.best_model, second.best_score, f"trials={deep_trials}"))
    return (second if second.best_score > first.best_score else first), history
