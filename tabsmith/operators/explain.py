"""Explanations of fitted models, as one scoring job over exploded what-if rows.

Shapley values and local surrogates are linear in the model's outputs on a fixed set of
perturbations, so a row's explanation is a weighted sum of its scores.  Rows are dealt
out by key before they are copied, so the copies of a row are scored and summed in one
task without another shuffle, and a task holds the sums of a bounded number of rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from itertools import permutations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import as_double, double_arrays, ref
from tabsmith.operators.models import AdaBoostModel, StackingModel, VotingModel, score
from tabsmith.operators.stats import ColumnSummary, summarize

Scorer = Callable[[DataFrame], DataFrame]


# importance -------------------------------------------------------------------
def raw_importance(model, width: int) -> np.ndarray | None:
    """Impurity importance or mean |coefficient| per feature; None if the model has neither."""
    if isinstance(model, StackingModel):
        own = raw_importance(model.final, width)
        return None if own is None else own[:width]
    if isinstance(model, VotingModel):
        parts = [raw_importance(m, width) for _, m in model.members]
    elif isinstance(model, AdaBoostModel):
        parts = [a * s.featureImportances.toArray() for s, a in zip(model.stumps, model.alphas)]
    elif hasattr(model, "featureImportances"):
        return model.featureImportances.toArray()
    elif hasattr(model, "coefficientMatrix"):
        return np.abs(model.coefficientMatrix.toArray()).mean(axis=0)
    elif hasattr(model, "coefficients"):
        return np.abs(model.coefficients.toArray())
    elif hasattr(model, "models"):
        parts = [raw_importance(m, width) for m in model.models]
    else:
        return None
    parts = [p[:width] for p in parts if p is not None and len(p) >= width]
    return np.mean(parts, axis=0) if parts else None


def feature_importance(spark, model, names: Sequence[str], top: int | None = 20) -> DataFrame:
    """``(feature, importance)``, largest first."""
    values = raw_importance(model, len(names))
    rows = [] if values is None else sorted(((n, float(v)) for n, v in zip(names, values)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows[:top] if top else rows, "feature string, importance double")


# Shapley ----------------------------------------------------------------------
def linear_shapley(df: DataFrame, coefficients: dict[str, float]) -> DataFrame:
    """Exact mean |coefficient * (x - mean)| per column: two aggregates, no rows moved."""
    cols = list(coefficients)
    stats = summarize(df, cols, (), moments=0)
    r = df.agg(*[
        F.avg(F.abs(F.lit(coefficients[c]) * (as_double(c) - F.lit(stats[c].mean or 0.0)))).alias(f"v{i}")
        for i, c in enumerate(cols)
    ]).first()
    return df.sparkSession.createDataFrame([(c, r[i]) for i, c in enumerate(cols)], "feature string, mean_abs_shap double")


def _orders(width: int, count: int, seed: int) -> list[tuple[int, ...]]:
    """All permutations if there are few, else seeded ones with their reversals."""
    if math.factorial(min(width, 10)) <= count:
        return list(permutations(range(width)))
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < count:
        p = tuple(int(x) for x in rng.permutation(width))
        out += [p, p[::-1]]
    return out[:count]


def _coalitions(width: int, count: int, seed: int) -> tuple[list[tuple[int, ...]], np.ndarray]:
    """Distinct feature sets along the permutations, and their weight in each Shapley value."""
    orders = _orders(width, count, seed)
    at: dict[tuple[int, ...], int] = {}
    terms: list[tuple[int, int, float]] = []
    for order in orders:
        members: set[int] = set()
        before = at.setdefault((), len(at))
        for j in order:
            members.add(j)
            after = at.setdefault(tuple(sorted(members)), len(at))
            terms += [(after, j, 1.0), (before, j, -1.0)]
            before = after
    w = np.zeros((len(at), width))
    for s, j, sign in terms:
        w[s, j] += sign / len(orders)
    return list(at), w


def _outputs(scored: DataFrame, classes: int) -> tuple[DataFrame, list[Column]]:
    if classes and "probability" in scored.columns:
        out = scored.withColumn("_q", vector_to_array("probability"))
        return out, [F.get("_q", F.lit(c)) for c in (range(classes) if classes > 2 else [1])]
    return scored, [F.col("prediction")]


# Sums that a task holds at a time.
TASK_SUMS = 1_000_000


def _dealt(df: DataFrame, key: Sequence[str], sums: int) -> DataFrame:
    """``df`` by key, in parts whose rows have ``TASK_SUMS`` sums together, ``sums`` a row."""
    parts = math.ceil(df.count() * sums / TASK_SUMS)
    return df.repartition(max(parts, 2 * df.sparkSession.sparkContext.defaultParallelism), *[ref(k) for k in key])


def _weighted_outputs(df: DataFrame, model, key: Sequence[str], points: Column, weights: np.ndarray, classes: int) -> DataFrame:
    """Per key: ``w<c>_<j>`` = sum over perturbations s of weights[s, j] * output c."""
    dealt = _dealt(df.select(*[ref(k) for k in key], "features"), key, weights.shape[1] * max(1, classes))
    exploded = dealt.select(*[ref(k) for k in key], F.posexplode(points).alias("_s", "_x"))
    exploded = exploded.select(*[ref(k) for k in key], "_s", array_to_vector("_x").alias("features"))
    scored, outs = _outputs(score(model, exploded), classes)
    # Weights are looked up once per exploded row.
    scored = scored.withColumn("_w", F.get(double_arrays(weights.tolist()), F.col("_s")))
    aggs = [F.sum(F.get("_w", F.lit(j)) * y).alias(f"w{c}_{j}") for c, y in enumerate(outs) for j in range(weights.shape[1])]
    return scored.groupBy(*[ref(k) for k in key]).agg(*aggs)


def vector_means(df: DataFrame) -> list[float]:
    rows = df.select(F.posexplode(vector_to_array("features")).alias("j", "v")).groupBy("j").agg(F.avg("v").alias("m")).collect()
    return [r["m"] for r in sorted(rows, key=lambda r: r["j"])]


def shapley_values(model, df: DataFrame, names: Sequence[str], key: Sequence[str], classes: int = 0,
                   permutations: int = 8, base: Sequence[float] | None = None, seed: int = 42) -> DataFrame:
    """Shapley values of every row against the mean row: ``(key..., output, feature, value)``.

    A feature outside a coalition takes its mean.  Values of a row add up to its output
    minus the output at the mean.  ``output`` is the class (or 0).
    """
    base = list(base or vector_means(df))
    sets, w = _coalitions(len(names), permutations, seed)
    x = vector_to_array("features")
    points = F.array(*[
        F.array(*[F.get(x, F.lit(j)) if j in s else F.lit(float(base[j])) for j in range(len(names))]) for s in map(set, sets)])
    sums = _weighted_outputs(df, model, key, points, w, classes)
    return _long(sums, key, names, classes, "value")


def _long(sums: DataFrame, key: Sequence[str], names: Sequence[str], classes: int, value: str) -> DataFrame:
    cols = [c for c in sums.columns if c not in key]
    structs = [F.struct(F.lit(int(c.split("_")[0][1:])).alias("output"), F.lit(names[int(c.split("_")[1])]).alias("feature"),
                        F.col(c).alias(value)) for c in cols if int(c.split("_")[1]) < len(names)]
    return sums.select(*[ref(k) for k in key], F.inline(F.array(*structs)))


def mean_abs_shapley(values: DataFrame, top: int | None = 20) -> DataFrame:
    out = values.groupBy("feature").agg(F.avg(F.abs("value")).alias("mean_abs_shap")).orderBy(F.desc("mean_abs_shap"), "feature")
    return out if top is None else out.limit(top)


# local surrogate --------------------------------------------------------------
def local_surrogate(model, df: DataFrame, names: Sequence[str], key: Sequence[str], scales: Sequence[float], classes: int = 0,
                    samples: int = 300, features: int = 10, ridge: float = 1.0, seed: int = 42) -> DataFrame:
    """Weighted ridge fit around each row: ``(key..., output, feature, weight, rank)``.

    All rows share one seeded set of perturbations (in units of the feature scales), so the
    ridge solution is one constant matrix applied to the row's scores.
    """
    d = len(names)
    z = np.vstack([np.zeros((1, d)), np.random.default_rng(seed).standard_normal((samples - 1, d))])
    kernel = np.exp(-(z ** 2).sum(axis=1) / (0.75 ** 2 * d) / 2.0)
    design = np.hstack([z, np.ones((samples, 1))])
    penalty = np.diag([ridge] * d + [0.0])
    solution = np.linalg.solve(design.T @ (kernel[:, None] * design) + penalty, design.T * kernel)  # (d + 1) x samples
    x = vector_to_array("features")
    noise = double_arrays((z * np.array(scales)[None, :]).tolist())
    points = F.transform(noise, lambda n: F.zip_with(x, n, lambda a, b: a + b))
    sums = _weighted_outputs(df, model, key, points, solution.T[:, :d], classes)
    # Largest weights first within the row: absent ones last, not-a-numbers first, ties by name.
    lists: dict[int, list[Column]] = {}
    for c in [c for c in sums.columns if c not in key]:
        output, j = int(c.split("_")[0][1:]), int(c.split("_")[1])
        w = F.col(c)
        lists.setdefault(output, []).append(F.struct(
            w.isNull().alias("none"), (~F.coalesce(F.isnan(w), F.lit(False))).alias("number"), (-F.abs(w)).alias("size"),
            F.lit(names[j]).alias("feature"), w.alias("weight")))
    ranked = sums.select(*[ref(k) for k in key], F.inline(F.array(*[
        F.struct(F.lit(output).alias("output"), F.slice(F.array_sort(F.array(*structs)), 1, features).alias("_top")) for output, structs in lists.items()])))
    return ranked.select(*[ref(k) for k in key], "output", F.posexplode("_top").alias("_at", "_w")).select(
        *[ref(k) for k in key], "output", "_w.feature", "_w.weight", (F.col("_at") + 1).alias("rank"))


# what-if grids ----------------------------------------------------------------
def _what_if(df: DataFrame, moves: Sequence[tuple], schema: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Copies of each row with one feature set to a move's value.  ``moves`` are tuples with
    the feature first and the value last; they are constants, so no table is joined."""
    structs = [F.struct(*[F.lit(v).alias(n) for n, v in zip(schema, m)]) for m in moves]
    grid = df.select("*", F.inline(F.array(*structs)))
    changed = {c: F.when(F.col("_feature") == c, F.col("_value")).otherwise(as_double(c)) for c in features}
    return grid.withColumns(changed)


def _strength(scored: DataFrame) -> Column:
    if "probability" in scored.columns:
        return F.array_max(vector_to_array("probability"))
    return F.col("prediction")


def sensitivity(df: DataFrame, scorer: Scorer, features: Sequence[str], key: Sequence[str],
                stats: dict[str, ColumnSummary]) -> DataFrame:
    """Per row and numeric feature: the score at median - 2 std and median + 2 std.

    ``(key..., feature, low_val, high_val, low_pred, high_pred, impact, direction)``; the
    score of a classifier is its largest class probability.
    """
    moves = []
    for c in features:
        s = stats[c]
        std = s.std or 1.0
        mid = s.quantiles.get(0.5, 0.0)
        moves += [(c, 0, float(mid - 2 * std)), (c, 1, float(mid + 2 * std))]
    grid = scorer(_what_if(df, moves, ("_feature", "_side", "_value"), features))
    y = _strength(grid)
    side = lambda s, v: F.max(F.when(F.col("_side") == s, v))
    out = grid.groupBy(*[ref(k) for k in key], F.col("_feature").alias("feature")).agg(
        side(0, F.col("_value")).alias("low_val"), side(1, F.col("_value")).alias("high_val"),
        side(0, y).alias("low_pred"), side(1, y).alias("high_pred"))
    return out.withColumn("impact", F.abs(F.col("high_pred") - F.col("low_pred"))).withColumn(
        "direction", F.when(F.col("high_pred") >= F.col("low_pred"), "positive").otherwise("negative"))


def sensitivity_summary(rows: DataFrame, top: int | None = 20) -> DataFrame:
    """Mean impact per feature over all rows."""
    out = rows.groupBy("feature").agg(
        F.avg("impact").alias("mean_impact"), F.max("impact").alias("max_impact"),
        F.avg((F.col("direction") == "positive").cast("double")).alias("positive_share"),
    ).orderBy(F.desc("mean_impact"), "feature")
    return out if top is None else out.limit(top)


MULTIPLES = (1.0, -1.0, 2.0, -2.0, 0.5, -0.5)  # fixed values: tried in this order


def counterfactuals(df: DataFrame, scorer: Scorer, features: Sequence[str], key: Sequence[str],
                    stats: dict[str, ColumnSummary], goal: str | None = None, per_row: int = 3) -> DataFrame:
    """Single-feature changes that alter a row's prediction, the first ``per_row`` features.

    A feature is set to its median plus a multiple of its std, inside its range.  A change
    counts when the predicted class differs, or for a regression with a ``goal`` column when
    the prediction reaches it.
    """
    moves = []
    for i, c in enumerate(features):
        s = stats[c]
        if s.n < 2:
            continue
        for j, m in enumerate(MULTIPLES):
            v = max(s.lo, min(s.hi, s.quantiles[0.5] + m * (s.std or 0.0)))
            moves.append((c, i, j, float(v)))
    based = scorer(df)
    base = based.withColumnRenamed("prediction", "_base").drop("probability", "features")
    base = base.withColumn("_original", F.create_map(*[x for c in features for x in (F.lit(c), as_double(c))]))
    tried = scorer(_what_if(base, moves, ("_feature", "_forder", "_morder", "_value"), features))
    hit = F.col("prediction") >= ref(goal) if goal else F.col("prediction") != F.col("_base")
    keys = [ref(k) for k in key]
    found = tried.where(hit).groupBy(*keys, "_feature", "_forder").agg(F.min(F.struct(
        "_morder", F.col("_value").alias("v"), F.col("prediction").alias("p"), F.col("_base").alias("b"),
        F.element_at("_original", F.col("_feature")).alias("o"))).alias("m"))
    w = Window.partitionBy(*keys).orderBy("_forder")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_row).select(
        *keys, "rank", F.col("_feature").alias("feature"), F.col("m.o").alias("original"), F.col("m.v").alias("changed_to"),
        (F.col("m.v") - F.col("m.o")).alias("delta"), F.col("m.b").alias("base_prediction"), F.col("m.p").alias("new_prediction"))
