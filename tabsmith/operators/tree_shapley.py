"""Exact Shapley values of tree models, for every row.

The value of a coalition is what a tree gives when features outside of it are averaged along the tree by training rows
(path-dependent).  A leaf adds up, over the features on its way from the root, polynomials in the coalition's size; only
which of these features a row satisfies matters, so each pattern that occurs is worked out once for a batch of rows.
Rows stay where they are; trees travel in parts of a counted number of nodes.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.expr import ref
from tabsmith.functions.session import shared_folder
from tabsmith.operators.boosting import BoostedModel
from tabsmith.operators.models import AdaBoostModel
from tabsmith.operators.trees import Tree, matrix

# Nodes that go to the tasks at once.
PART_NODES = 200_000


@dataclass
class Ensemble:
    """A sum of trees on top of ``base``, one number for each output."""

    trees: list[Tree]
    base: list[float]

    def expected(self) -> np.ndarray:
        """Output of the empty coalition: each tree's mean over its training rows."""
        out = np.array(self.base, float)
        for t in self.trees:
            leaf = t.feature < 0
            share = _reach(t)[leaf]
            out += share @ t.value[leaf]
        return out


def _reach(tree: Tree) -> np.ndarray:
    """Share of the root's training rows that reach each node."""
    out = np.zeros(len(tree))
    out[0] = 1.0
    for node in _downward(tree):
        if tree.feature[node] >= 0:
            for child in (tree.left[node], tree.right[node]):
                out[child] = out[node] * _share(tree, node, child)
    return out


def _downward(tree: Tree) -> list[int]:
    order = [0]
    for node in order:
        if tree.feature[node] >= 0:
            order += [int(tree.left[node]), int(tree.right[node])]
    return order


def _share(tree: Tree, node: int, child: int) -> float:
    """Share of a node's rows that go to a child; one half if it has no rows."""
    both = tree.cover[tree.left[node]] + tree.cover[tree.right[node]]
    return float(tree.cover[child] / both) if both > 0 else 0.5


# models ---------------------------------------------------------------------------
def _spark_trees(spark, model) -> list[Tree]:
    """Trees of one of Spark's models, in order, from the tables that it saves."""
    folder = shared_folder(spark, "trees")
    model.write().overwrite().save(folder)
    saved = spark.read.parquet(f"{folder}/data")
    if "nodeData" in saved.columns:
        saved = saved.select(F.col("treeID"), "nodeData.*")
    else:
        saved = saved.select(F.lit(0).alias("treeID"), "*")
    found: dict[int, list] = {}
    for row in saved.orderBy("treeID", "id").toLocalIterator():
        found.setdefault(row["treeID"], []).append(row)
    regression = not hasattr(model, "numClasses") or model.__class__.__name__.startswith("GBT")
    return [_tree(rows, regression) for _, rows in sorted(found.items())]


def _tree(rows: list, regression: bool) -> Tree:
    value, cover, categories = [], [], {}
    feature, threshold = np.full(len(rows), -1, np.int64), np.zeros(len(rows))
    for i, r in enumerate(rows):
        stats = np.array(r["impurityStats"], float)
        # Statistics of regression trees are weight, sum and sum of squares; of classifiers the weight of each class.
        cover.append(stats[0] if regression else stats.sum())
        value.append([r["prediction"]] if regression else (stats / stats.sum() if stats.sum() else np.full(len(stats), 1.0 / len(stats))))
        if r["leftChild"] >= 0:
            split = r["split"]
            feature[i] = split["featureIndex"]
            if split["numCategories"] >= 0:
                categories[i] = list(split["leftCategoriesOrThreshold"])
            else:
                threshold[i] = split["leftCategoriesOrThreshold"][0]
    left, right = (np.array([r[c] for r in rows], np.int64) for c in ("leftChild", "rightChild"))
    return Tree(feature, threshold, left, right, np.array(value, float), np.array(cover, float), categories=categories)


def _times(tree: Tree, factor: float, output: int = 0, outputs: int | None = None) -> Tree:
    value = tree.value * factor
    if outputs is not None:
        wide = np.zeros((len(tree), outputs))
        wide[:, output] = value[:, 0]
        value = wide
    return Tree(tree.feature, tree.threshold, tree.left, tree.right, value, tree.cover, tree.gain, tree.categories)


def ensemble_of(spark, model) -> Ensemble:
    """The trees of a model.  Outputs are what the trees add up to: class probabilities of trees, forests and the stumps'
    vote, scores before the link function of boosters, predictions of regression; one-against-rest boosters give a score each."""
    if isinstance(model, Ensemble):
        return model
    if isinstance(model, BoostedModel):
        n = len(model.base)
        return Ensemble([_times(t, 1.0, k, n) for group in model.rounds for k, t in enumerate(group)], model.base)
    if isinstance(model, AdaBoostModel):
        total, trees = sum(model.alphas) or 1.0, []
        for stump, alpha in zip(model.stumps, model.alphas):
            tree = _spark_trees(spark, stump)[0]
            vote = np.zeros((len(tree), model.classes))
            vote[np.arange(len(tree)), tree.value.argmax(axis=1)] = alpha / total
            trees.append(Tree(tree.feature, tree.threshold, tree.left, tree.right, vote, tree.cover, None, tree.categories))
        return Ensemble(trees, [0.0] * model.classes)
    if hasattr(model, "models"):
        parts = [ensemble_of(spark, m) for m in model.models]
        if any(len(p.base) != 1 for p in parts):
            raise ValueError("one-against-rest models must be boosters")
        return Ensemble([_times(t, 1.0, k, len(parts)) for k, p in enumerate(parts) for t in p.trees], [p.base[0] for p in parts])
    if not hasattr(model, "toDebugString"):
        raise ValueError(f"{type(model).__name__} is not a tree model")
    trees = _spark_trees(spark, model)
    weights = list(model.treeWeights) if hasattr(model, "treeWeights") else [1.0]
    if type(model).__name__.startswith("RandomForest"):
        weights = [1.0 / len(trees)] * len(trees)
    return Ensemble([_times(t, w) for t, w in zip(trees, weights)], [0.0] * trees[0].value.shape[1])


# values ---------------------------------------------------------------------------
def _leaf_ways(tree: Tree):
    """For each leaf: its features on the way, the share of rows that goes on at each, and the steps (feature's place, node, left)."""
    todo = [(0, (), {})]
    while todo:
        node, steps, shares = todo.pop()
        if tree.feature[node] < 0:
            yield node, steps, shares
            continue
        for child, left in ((int(tree.left[node]), True), (int(tree.right[node]), False)):
            f = int(tree.feature[node])
            todo.append((child, (*steps, (f, node, left)), {**shares, f: shares.get(f, 1.0) * _share(tree, node, child)}))


def _sizes_polynomial(shares: Sequence[float], on: np.ndarray) -> np.ndarray:
    """Sums over coalitions of each size of the products of ``on`` (features inside) and ``shares`` (outside); on: (features, patterns)."""
    out = np.ones((1, on.shape[1]))
    for z, o in zip(shares, on):
        wider = np.zeros((len(out) + 1, on.shape[1]))
        wider[:-1] = out * z
        wider[1:] += out * o
        out = wider
    return out


def _leaf_values(shares: Sequence[float], on: np.ndarray) -> np.ndarray:
    """Shapley value of each feature on the way to a leaf of value 1: (features, patterns)."""
    d = len(shares)
    weights = [math.factorial(s) * math.factorial(d - 1 - s) / math.factorial(d) for s in range(d)]
    whole, out = _sizes_polynomial(shares, on), np.empty(on.shape)
    for j, z in enumerate(shares):
        if z > 0:
            # Divide the polynomial by (z + o t): from the top where o is 1, term by term where it is 0.
            rest, carry = np.empty((d, on.shape[1])), whole[d].copy()
            for s in range(d - 1, -1, -1):
                rest[s] = carry
                carry = whole[s] - z * carry
            rest = np.where(on[j] > 0, rest, whole[:d] / z)
        else:
            rest = _sizes_polynomial([*shares[:j], *shares[j + 1:]], np.delete(on, j, axis=0))
        out[j] = (on[j] - z) * np.tensordot(weights, rest, 1)
    return out


def tree_values(tree: Tree, x: np.ndarray) -> np.ndarray:
    """Shapley values (rows, features, outputs) of one tree."""
    out = np.zeros((len(x), x.shape[1], tree.value.shape[1]))
    left = {n: tree.goes_left(n, x[:, tree.feature[n]]) for n in np.flatnonzero(tree.feature >= 0).tolist()}
    for leaf, steps, shares in _leaf_ways(tree):
        features = list(shares)
        if not features or not tree.value[leaf].any():
            continue
        on = np.ones((len(features), len(x)), bool)
        for f, node, goes in steps:
            on[features.index(f)] &= left[node] if goes else ~left[node]
        # Few of the patterns occur; over 60 features on a way they are told apart as bytes.
        if len(features) <= 60:
            code = np.left_shift(1, np.arange(len(features), dtype=np.int64)) @ on.astype(np.int64)
        else:
            code = np.array([c.tobytes() for c in np.packbits(on, axis=0).T])
        _, first, where = np.unique(code, return_index=True, return_inverse=True)
        values = _leaf_values([shares[f] for f in features], on[:, first].astype(float))
        out[:, features, :] += values[:, where].T[:, :, None] * tree.value[leaf]
    return out


def _parts(trees: list[Tree]) -> list[list[Tree]]:
    out, size = [[]], 0
    for t in trees:
        if out[-1] and size + len(t) > PART_NODES:
            out.append([])
            size = 0
        out[-1].append(t)
        size += len(t)
    return out


def _values_column(trees: list[Tree], outputs: int) -> Column:
    @F.arrow_udf("array<double>")
    def values(x: pa.Array) -> pa.Array:
        if not len(x):
            return pa.array([], pa.list_(pa.float64()))
        rows = matrix(x, len(x[0]))
        out = sum((tree_values(t, rows) for t in trees), np.zeros((*rows.shape, outputs)))
        return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out[0].size, dtype=np.int32)), pa.array(out.ravel()))
    return values(vector_to_array("features"))


def tree_shapley(model, df: DataFrame, names: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Exact Shapley values of every row of ``df`` (key columns, ``features``): ``(key..., output, feature, value)``.

    ``model`` is a tree, forest or booster of Spark's, an ``AdaBoostModel``, a ``BoostedModel`` or an ``Ensemble``; see
    ``ensemble_of`` for what an output is.  Values of a row and output add up to the output less ``expected``.  Rows are
    neither sampled nor capped; equal rows have equal values, and rows without features (null) give none.
    """
    found = ensemble_of(df.sparkSession, model)
    outputs = len(found.base)
    rows = df.where(F.col("features").isNotNull())
    total = None
    for part in _parts(found.trees):
        values = _values_column(part, outputs)
        total = values if total is None else F.zip_with(total, values, lambda a, b: a + b)
    rows = rows.select(*[ref(k) for k in key], F.posexplode(total).alias("_i", "value"))
    place = (F.col("_i") / outputs).cast("int")
    labels = F.array(*map(F.lit, names))
    return rows.select(*[ref(k) for k in key], F.pmod("_i", F.lit(outputs)).cast("int").alias("output"), F.get(labels, place).alias("feature"), "value")
