"""Preprocessing recipes: which imputer, scaler and encoder, and the search for the best."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field
from threading import Lock

from pyspark.ml import Estimator, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import ref
from tabsmith.operators.encode import TargetEncode, category_encoder
from tabsmith.operators.evaluate import evaluate, primary_metric
from tabsmith.operators.fitted import FittedColumns
from tabsmith.operators.impute import ChainedFill, Fill, KnnFill, column_defaults, imputer
from tabsmith.operators.models import Task, registry, score
from tabsmith.operators.roles import ColumnRoles
from tabsmith.operators.scale import OutlierClip, SkewCorrect, scaler
from tabsmith.operators.stats import null_counts
from tabsmith.operators.select import DateParts, FeatureVector, FeatureVectorModel, reduce_dimensions

# The (imputer, scaler, encoder) combinations that are compared.
GRID = (
    ("median", "robust", "onehot"),
    ("mean", "standard", "onehot"),
    ("knn", "minmax", "ordinal"),
    ("iterative", "standard", "target"),
    ("median", "robust", "target"),
    ("mean", "power", "freq"),
    ("knn", "quantile", "binary"),
    ("median", "normalize", "ordinal"),
)
FAILED = -999.0


class BooleanModel(FittedColumns):
    def expressions(self, df: DataFrame):
        return {c: ref(c).cast("double") for c in self.fitted}


@dataclass
class Recipe:
    impute: str
    scale: str
    encode: str
    clip: bool = True
    correct_skew: bool = True
    select: bool = True
    pca: bool = True
    keep_share: float = 0.9

    @property
    def name(self) -> str:
        return f"{self.impute}|{self.scale}|{self.encode}"


@dataclass
class FittedRecipe:
    recipe: Recipe
    model: PipelineModel
    names: list[str]
    roles: ColumnRoles
    components: int = 0
    defaults: dict = field(default_factory=dict)

    def transform(self, df: DataFrame) -> DataFrame:
        return self.model.transform(df)

    @property
    def width(self) -> int:
        return self.components or len(self.names)

    def stats(self) -> dict:
        r = self.roles
        return {
            "strategy": self.recipe.name, "input_features": len(r.features), "numeric_features": len(r.numeric),
            "low_card_cat": len(r.low_card), "high_card_cat": len(r.high_card), "date_cols": list(r.date),
            "dropped_cols": list(r.dropped), "pca_applied": bool(self.components), "pca_components": self.components,
            "output_features": self.width,
        }


def _stages(recipe: Recipe, roles: ColumnRoles, classes: int) -> list:
    numeric = roles.numeric + roles.boolean
    stages: list = []
    if roles.boolean:
        stages.append(BooleanModel.of(roles.boolean))
    if numeric:
        stages.append(imputer(recipe.impute, numeric))
        if recipe.clip:
            stages.append(OutlierClip.of(numeric, factor=3.0))
        if recipe.correct_skew:
            stages.append(SkewCorrect.of(numeric))
        stages.append(scaler(recipe.scale, numeric))
    if roles.low_card or roles.high_card:
        stages.append(Fill.of(roles.low_card + roles.high_card, strategy="mode"))
    if roles.low_card:
        stages.append(category_encoder(recipe.encode, roles.low_card, "label", classes))
    if roles.high_card:
        stages.append(TargetEncode.of(roles.high_card, target="label", classes=classes))
    if roles.date:
        stages.append(DateParts.of(roles.date))
    return stages


class StageCache:
    """Fits and column measures shared by recipes: what derives in the same way from the same columns is worked out once."""

    def __init__(self):
        self._lock, self._fits, self._measures, self._numbers = Lock(), {}, {}, {}

    def number(self, derivation: tuple) -> int:
        """A short name of a derivation."""
        with self._lock:
            return self._numbers.setdefault(derivation, len(self._numbers))

    def fit(self, key: int, run: Callable):
        with self._lock:
            future = self._fits.get(key)
            mine = future is None
            if mine:
                future = self._fits[key] = Future()
        if mine:
            try:
                future.set_result(run())
            except BaseException as e:
                future.set_exception(e)
        return future.result()

    def measure(self, keys: dict[str, tuple], run: Callable) -> dict:
        """``run(columns)`` for the columns whose keys are new; the others as measured before, or at this time by another recipe."""
        mine, others = {}, {}
        with self._lock:
            for c, key in keys.items():
                if key in self._measures:
                    others[c] = self._measures[key]
                else:
                    mine[c] = self._measures[key] = Future()
        found = {}
        if mine:
            try:
                found = run(list(mine))
                for c, future in mine.items():
                    future.set_result(found[c])
            except BaseException as e:
                for future in mine.values():
                    if not future.done():
                        future.set_exception(e)
                raise
        # A failure may be due to another recipe's columns, so it is not shared.
        failed = [c for c, future in others.items() if future.exception()]
        found.update({c: future.result() for c, future in others.items() if c not in failed})
        return {**found, **run(failed)} if failed else found


def _fit_stages(stages: list, df: DataFrame, complete: bool, cache: StageCache) -> list:
    """Fit one stage after the other.  A fit depends on the columns it reads, a column on the fit that wrote it, so stages of
    categories and dates do not depend on the scaler.  Where the numbers have no gaps every imputer leaves them alone, so
    the stages behind it do not depend on which one it was."""
    origin = {c: cache.number((c,)) for c in df.columns}
    models = []
    for stage in stages:
        options = stage.getOrDefault("options") if stage.hasParam("options") else stage.getOrDefault("spec")
        cols = stage.cols if hasattr(stage, "cols") else list(stage.fitted)
        target = stage.option("target") if hasattr(stage, "option") else None
        chooses = isinstance(stage, FeatureVector)
        reads = df.columns if chooses else [*cols, *([target] if target else [])]
        key = cache.number((type(stage).__name__, tuple(cols), options, tuple((c, origin[c]) for c in reads)))

        def measured(kind, names, measure, y=target):
            return cache.measure({c: (kind, origin[c], origin[y]) for c in names}, measure)

        def fit(stage=stage, df=df, chooses=chooses, measured=measured):
            if chooses:
                return stage.fit_measured(df, measured)
            return stage.fit(df) if isinstance(stage, Estimator) else stage

        model = cache.fit(key, fit)
        skip = complete and not models and isinstance(stage, (Fill, KnnFill, ChainedFill))
        models.append(model)
        before, df = set(df.columns), model.transform(df)
        written = {*cols, *getattr(model, "outputs", ())}
        if not skip:
            origin |= {c: cache.number((key, c)) for c in df.columns if c in written or c not in before}
    return models


def fit_recipe(train: DataFrame, recipe: Recipe, roles: ColumnRoles, classification: bool, classes: int,
               keep: Sequence[str] = (), complete: bool = False, cache: StageCache | None = None) -> FittedRecipe:
    """Fit on rows with ``label``; ``keep`` are columns that are not features.

    ``complete`` tells that no numeric feature has gaps, ``cache`` shares stage fits.
    """
    total = len(roles.features)
    k = max(1, min(total, int(total * recipe.keep_share))) if recipe.select and total > 1 else None
    cols = [ref(c) for c in dict.fromkeys([*roles.features, "label", *[c for c in keep if c in train.columns]])]
    vector = FeatureVector.of(roles.features, exclude=[*keep, "weight"], target="label", k=k, classification=classification)
    fitted = _fit_stages([*_stages(recipe, roles, classes), vector], train.select(*cols), complete, cache or StageCache())
    model = PipelineModel(fitted)
    fv: FeatureVectorModel = fitted[-1]
    names, components = fv.names, 0
    if recipe.pca and len(names) > 40:
        raw = FeatureVectorModel.of({"keep": names, "output": "raw_features"})
        head = PipelineModel([*model.stages[:-1], raw])
        rotate = reduce_dimensions(head.transform(train), len(names), col="raw_features", output="features")
        model = PipelineModel([*head.stages, *rotate.stages])
        components = len(rotate.stages[-1].getIndices())
    return FittedRecipe(recipe, model, names, roles, components)


def quick_score(fitted: FittedRecipe, train: DataFrame, val: DataFrame, task: Task) -> float:
    """Validation score of a default linear model on the recipe's output."""
    name = "logistic_regression" if task.classification else "ridge"
    family = registry(task.classification)[name]
    model = family.fit(fitted.transform(train).select("features", "label"), Task(**{**task.__dict__, "width": fitted.width}),
                       {**family.defaults, "max_iter": 100})
    scored = score(model, fitted.transform(val).select("features", "label")).drop("probability")
    return evaluate(scored, task.classification, task.classes)[primary_metric(task.classification)]


def best_recipe(train: DataFrame, val: DataFrame, roles: ColumnRoles, task: Task, grid=GRID, parallelism: int = 4,
                keep: Sequence[str] = (), **options) -> tuple[FittedRecipe, dict[str, float]]:
    """Fit every recipe of the grid, keep the one with the best quick score.

    A recipe that fails scores -999.  Fits are independent, so a few run at a time.
    """

    numeric = [ref(c) for c in roles.numeric + roles.boolean]
    complete = not numeric or not any(null_counts(train.select(*numeric))[1].values())
    cache = StageCache()

    def attempt(parts):
        recipe = Recipe(*parts, **options)
        try:
            fitted = fit_recipe(train, recipe, roles, task.classification, task.classes, keep, complete, cache)
            return recipe.name, fitted, quick_score(fitted, train, val, task)
        except Exception as e:  # a failing recipe only loses the comparison
            return recipe.name, None, (FAILED, f"{type(e).__name__}: {e}")

    with ThreadPoolExecutor(parallelism) as pool:
        results = list(pool.map(attempt, grid))
    scores = {name: s if fitted else FAILED for name, fitted, s in results}
    done = [(s, -i, fitted) for i, (_, fitted, s) in enumerate(results) if fitted]
    if not done:
        raise RuntimeError(f"every recipe failed: {[(n, s[1]) for n, _, s in results]}")
    fitted = max(done, key=lambda d: (d[0], d[1]))[2]
    fitted.defaults = column_defaults(train, roles.features)
    return fitted, scores


def scores_table(spark, scores: dict[str, float]) -> DataFrame:
    df = spark.createDataFrame(list(scores.items()), "recipe string, score double")
    return df.orderBy(F.desc("score"), "recipe")
