"""One table and a target column: profile, prepare, train, explain, save, score."""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabsmith.functions.expr import numeric_columns, ref
from tabsmith.operators import explain
from tabsmith.operators.impute import fill_missing_columns
from tabsmith.operators.isolation import mark_outliers
from tabsmith.operators.models import score
from tabsmith.operators.profile import TableProfile
from tabsmith.operators.roles import detect_problem_type
from tabsmith.operators.stats import summarize
from tabsmith.operators.tree_shapley import tree_shapley
from tabsmith.plans.recipe import GRID, scores_table
from tabsmith.plans.search import Entry, leaderboard_table, prepare, train_all
from tabsmith.sources import runs as run_store
from tabsmith.sources.tables import clean_table, drop_null_target, load_table, require_columns, resolve_target


class TableScorer:
    """A fitted preprocessor and model that score raw rows."""

    def __init__(self, prep, model, facts: dict):
        self.prep, self.model, self.facts = prep, model, facts

    @property
    def classes(self) -> list[str]:
        return self.facts["classes"]

    def raw(self, df: DataFrame) -> DataFrame:
        """Add ``prediction`` (class index or value) and ``probability``.

        The columns of ``df`` come back untouched: preprocessing works on copies of the
        feature columns that travel in a struct, so no join is needed.
        """
        features = self.facts["features"]
        kept = [c for c in df.columns if c not in ("features", "prediction", "probability")]
        packed = df.select(F.struct(*[ref(c) for c in kept]).alias("_row"), *[ref(c) for c in features])
        out = score(self.model, self.prep.transform(packed).select("_row", "features"))
        extra = [c for c in ("prediction", "probability") if c in out.columns]
        return out.select(*[F.col("_row").getField(c).alias(c) for c in kept], *extra)

    def predict(self, df: DataFrame, fill: bool = True) -> DataFrame:
        """Decoded ``prediction``, and for classes ``probabilities`` and ``confidence``."""
        if fill:
            df = fill_missing_columns(df, self.facts["defaults"])
        require_columns(df, self.facts["features"])
        out = self.raw(df)
        if not self.classes:
            return out
        decoded = F.get(F.lit(self.classes), F.col("prediction").cast("int"))
        if "probability" in out.columns:
            out = out.withColumn("probabilities", vector_to_array("probability")).drop("probability")
            out = out.withColumn("confidence", F.round(F.array_max("probabilities"), 4))
        return out.withColumn("prediction", decoded)

    def save(self, spark: SparkSession, path: str) -> None:
        run_store.save_bundle(spark, path, self.prep, self.model, self.facts)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "TableScorer":
        return cls(*run_store.load_bundle(spark, path))


class AutoTable:
    """Run the whole analysis of one table.

    >>> result = AutoTable(df, target="species").run()
    >>> result.scorer.predict(new_rows)
    """

    def __init__(self, df: DataFrame, target: str, problem_type: str | None = None, datetime_col: str | None = None,
                 key: Sequence[str] | None = None, trials: int = 10, folds: int = 5, test_size: float = 0.2,
                 remove_outlier_rows: bool = False, models: Sequence[str] | None = None, class_weight: str | None = None,
                 grid=GRID, params: dict[str, dict] | None = None, ensembles: bool = True, **recipe_options):
        df = clean_table(df)
        self.target = resolve_target(df, target)
        self.problem_type = problem_type or detect_problem_type(df, self.target, datetime_col)
        self.classification = self.problem_type == "classification"
        self.source, self.key = df, list(key) if key else None
        self.df = drop_null_target(df, self.target, datetime_col)
        self.trials, self.folds, self.test_size = trials, folds, test_size
        self.remove_outlier_rows, self.models, self.class_weight = remove_outlier_rows, models, class_weight
        self.grid, self.params, self.ensembles, self.recipe_options = grid, params, ensembles, recipe_options
        self.run_id = uuid.uuid4().hex[:8]
        self.entries: list[Entry] = []
        self.profile = TableProfile(self.source, self.target, "classification" if self.classification else "regression")

    @classmethod
    def load(cls, spark: SparkSession, path: str, target: str, **kw) -> "AutoTable":
        return cls(load_table(spark, path), target, **kw)

    def run(self) -> "AutoTable":
        start = time.time()
        df = self.df
        if self.remove_outlier_rows:
            cols = [c for c in numeric_columns(df, [self.target, *(self.key or [])])]
            df = mark_outliers(df, cols).where(~F.col("is_outlier")).drop("is_outlier")
        self.prepared = prepare(df, self.target, self.classification, self.key, self.test_size, self.grid,
                                self.class_weight, **self.recipe_options)
        p = self.prepared
        self.entries = train_all(p.train, p.val, p.task, self.trials, self.folds, self.models, ensembles=self.ensembles,
                                 params=self.params)
        best = self.entries[0]
        self.scorer = TableScorer(p.recipe.model, best.model, {
            "features": p.roles.features, "defaults": p.recipe.defaults, "classes": p.label.classes if p.label else [],
            "problem_type": self.problem_type, "target": self.target, "run_id": self.run_id, "best_model": best.model_name,
            "recipe": p.recipe.stats(), "vector": p.recipe.names,
        })
        self.seconds = round(time.time() - start, 1)
        return self

    @property
    def names(self) -> list[str]:
        """Names of the model's input vector."""
        p = self.prepared.recipe
        return [f"pc{i}" for i in range(p.components)] if p.components else p.names

    def leaderboard(self) -> DataFrame:
        return leaderboard_table(self.df.sparkSession, self.entries, self.classification)

    def recipe_scores(self) -> DataFrame:
        return scores_table(self.df.sparkSession, self.prepared.recipe_scores)

    def importance(self, top: int | None = 20) -> DataFrame:
        """Impurity or coefficient importance; for other models mean |Shapley value|."""
        out = explain.feature_importance(self.df.sparkSession, self.entries[0].model, self.names, top)
        if out.isEmpty():
            values = self.shapley()
            out = explain.mean_abs_shapley(values, top).withColumnRenamed("mean_abs_shap", "importance")
        return out

    def shapley(self, permutations: int = 4) -> DataFrame:
        from tabsmith.plans.search import ORDER
        return explain.shapley_values(self.entries[0].model, self.prepared.val, self.names, [ORDER],
                                      self.prepared.task.classes, permutations)

    def exact_shapley(self) -> DataFrame:
        """Exact values of the winner for every validation row, if it is a tree model; see ``tree_shapley.ensemble_of`` for its outputs."""
        from tabsmith.plans.search import ORDER
        return tree_shapley(self.entries[0].model, self.prepared.val, self.names, [ORDER])

    def feature_stats(self):
        cols = [c for c in self.prepared.roles.numeric]
        return summarize(self.df, cols, (0.5,), moments=2)

    def sensitivity(self, rows: DataFrame, key: Sequence[str]) -> DataFrame:
        return explain.sensitivity(rows, self.scorer.raw, self.prepared.roles.numeric, key, self.feature_stats())

    def counterfactuals(self, rows: DataFrame, key: Sequence[str], goal: str | None = None) -> DataFrame:
        return explain.counterfactuals(rows, self.scorer.raw, self.prepared.roles.numeric, key, self.feature_stats(), goal)

    def save(self, path: str, runs_root: str | None = None, dataset: str = "") -> None:
        """Save the bundle, and append the run to the run tables when ``runs_root`` is given."""
        spark = self.df.sparkSession
        self.scorer.save(spark, path)
        if runs_root:
            best, n = self.entries[0], self.profile.rows
            missing = [(c, 100.0 * m / n if n else 0.0) for c, m in self.profile.missing_counts.items() if m]
            run_store.append_run(spark, runs_root, {
                "run_id": self.run_id, "dataset": dataset, "status": "completed", "problem_type": self.problem_type,
                "target": self.target, "n_rows": n, "n_cols": len(self.source.columns), "best_model": best.model_name,
                "best_score": float(best.primary(self.classification)), "recipe": self.prepared.recipe.recipe.name,
                "seconds": self.seconds}, self.leaderboard(), self.importance(),
                self.profile.class_counts if self.classification else [], missing)
