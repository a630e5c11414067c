"""Gradient boosting on histograms: one booster for all classes, second-order gains, leaf-wise trees.

Features become bin numbers once.  A pass over the rows sums gradients and hessians by (output, node, feature, bin) in
every task; only these sums are shuffled, and prefix sums over bins give the best split of each node.  The trees of all
classes of a round grow in the same passes, a level at a time.  The gain of a node does not depend on other nodes, so
taking splits in order of gain from the levels grown gives the trees that leaf-wise growth gives.

Scores of the rows are written every few rounds and survive lost executors; in between the trees since then are added
on the way.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.session import cut_lineage
from tabsmith.operators.trees import LevelTree, Tree, matrix

# Rounds whose trees are applied on the way before the scores of the rows are written anew.
ROUNDS_KEPT = 8
# Cells (output, node, feature, bin) that a task sums in one pass; more nodes than that take further passes.
PASS_CELLS = 2_000_000
# Points of a quantile summary for each bin, and groups that merge summaries first.
SUMMARY_POINTS, SUMMARY_PARTS = 16, 64

SPLIT = ["gain", "feature", "bin", "left_g", "left_h", "left_n", "g", "h", "n"]


@dataclass
class Boosting:
    """``l1`` and ``l2`` shrink leaf weights, ``min_gain`` is the loss a split must save, ``rows`` and ``columns`` are the
    shares sampled for each round.  ``leaves`` bounds a tree's leaves, ``depth`` its levels."""

    rounds: int = 100
    depth: int = 6
    leaves: int = 31
    rate: float = 0.1
    bins: int = 64
    l1: float = 0.0
    l2: float = 1.0
    min_gain: float = 0.0
    min_hessian: float = 1e-3
    min_rows: int = 1
    rows: float = 1.0
    columns: float = 1.0
    oblivious: bool = False  # one split for all nodes of a level; ``leaves`` and ``min_rows`` do not apply
    seed: int = 42


# bins ---------------------------------------------------------------------------
def _thin(values: np.ndarray, weights: np.ndarray, points: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values with their weights; over ``points`` of them, those at even ranks with the weight up to each."""
    values, where = np.unique(values, return_inverse=True)
    weights = np.bincount(where, weights, len(values))
    if len(values) <= points:
        return values, weights
    total = np.cumsum(weights)
    at = np.unique(np.append(np.searchsorted(total, (np.arange(points - 1) + 0.5) * total[-1] / (points - 1)), len(values) - 1))
    return values[at], np.diff(np.concatenate(([0.0], total[at])))


def bin_edges(df: DataFrame, width: int, bins: int) -> list[np.ndarray]:
    """Edges of each feature: a value's bin is the number of edges below it.

    NaN is the largest value.  A feature with up to ``bins`` distinct values has them all but the largest as edges.  Others are cut at quantiles
    from merged summaries, whose ranks are off by about one part in ``SUMMARY_POINTS`` of a bin for each merge.
    """
    points = SUMMARY_POINTS * bins

    def summarize(batches):
        kept: list = [[] for _ in range(width)]
        for batch in batches:
            x = matrix(batch.column("x"), width)
            for j in range(width):
                v = np.where(np.isnan(x[:, j]), np.inf, x[:, j])
                kept[j].append(_thin(v, np.ones(len(v)), points))
                if sum(len(y) for y, _ in kept[j]) > 4 * points:
                    kept[j] = [_thin(*map(np.concatenate, zip(*kept[j])), points)]
        rows = [(j, *_thin(*map(np.concatenate, zip(*k)), points)) for j, k in enumerate(kept) if k]
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.float64())),
                               pa.array([r[2] for r in rows], pa.list_(pa.float64()))], ["feature", "v", "w"])

    def merge(table: pa.Table) -> pa.Table:
        v, w = (np.concatenate([np.asarray(x, float) for x in table.column(n).to_pylist()]) for n in ("v", "w"))
        v, w = _thin(v, w, points)
        return pa.table({"feature": table.column("feature").slice(0, 1), "v": pa.array([v], pa.list_(pa.float64())), "w": pa.array([w], pa.list_(pa.float64()))})
    schema = "feature int, v array<double>, w array<double>"
    found = df.select(vector_to_array("features").alias("x")).mapInArrow(summarize, schema)
    found = found.withColumn("part", F.spark_partition_id() % SUMMARY_PARTS).groupBy("feature", "part").applyInArrow(merge, schema)
    out = [np.zeros(0)] * width
    for row in found.groupBy("feature").applyInArrow(merge, schema).collect():
        v, w = np.array(row["v"]), np.array(row["w"])
        if len(v) <= bins:
            out[row["feature"]] = v[:-1]
        else:
            total = np.cumsum(w)
            cut = v[np.searchsorted(total, np.arange(1, bins) * total[-1] / bins)]
            if np.isinf(v[-1]):  # gaps have a bin of their own
                cut[-1] = v[-2]
            out[row["feature"]] = np.unique(cut[cut < v[-1]])
    return out


def _binned(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
    out = np.empty(x.shape, np.uint8)
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(e, x[:, j])
    return out


# trees in the making --------------------------------------------------------------
class _Grower:
    """One tree while it grows: a node for every split tried."""

    def __init__(self, g: float, h: float, n: float):
        self.sums = [(g, h, n)]
        self.split: dict[int, tuple[float, int, int, int, int]] = {}  # gain, feature, bin, left, right
        self.depth = [0]

    def divide(self, node: int, gain: float, feature: int, cut: int, left: tuple, right: tuple) -> None:
        a = len(self.sums)
        self.sums += [left, right]
        self.depth += [self.depth[node] + 1] * 2
        self.split[node] = (gain, feature, cut, a, a + 1)

    def chosen(self, leaves: int) -> set[int]:
        """The splits of a tree with up to ``leaves`` leaves, taken in order of gain from the root down."""
        heap, out = [(-self.split[0][0], 0)] if 0 in self.split else [], set()
        while heap and len(out) < leaves - 1:
            _, node = heapq.heappop(heap)
            out.add(node)
            for child in self.split[node][3:]:
                if child in self.split:
                    heapq.heappush(heap, (-self.split[child][0], child))
        return out

    def tree(self, leaves: int, weight, edges: list[np.ndarray] | None = None) -> Tree:
        """The chosen part; thresholds are bin numbers, or the edges of these bins."""
        keep = self.chosen(leaves)
        number, order = {0: 0}, [0]
        for node in order:
            if node in keep:
                for child in self.split[node][3:]:
                    number[child] = len(order)
                    order.append(child)
        pick = lambda of, none: np.array([of(x) if x in keep else none for x in order])
        return Tree(
            pick(lambda x: self.split[x][1], -1).astype(np.int64),
            pick(lambda x: float(self.split[x][2] if edges is None else edges[self.split[x][1]][self.split[x][2]]), 0.0).astype(float),
            pick(lambda x: number[self.split[x][3]], -1).astype(np.int64), pick(lambda x: number[self.split[x][4]], -1).astype(np.int64),
            np.array([[weight(*self.sums[x][:2])] for x in order]), np.array([self.sums[x][2] for x in order], float),
            pick(lambda x: self.split[x][0], 0.0).astype(float))


def _slots(grower: _Grower, bins: np.ndarray, at: dict[int, int]) -> np.ndarray:
    """Which of the open nodes ``at`` (node: slot) each row is in, -1 for none."""
    out = np.full(len(bins), -1, np.int64)
    todo = [(0, np.arange(len(bins)))]
    while todo:
        node, rows = todo.pop()
        if node in at:
            out[rows] = at[node]
        elif node in grower.split and len(rows):
            _, feature, cut, a, b = grower.split[node]
            left = bins[rows, feature] <= cut
            todo += [(a, rows[left]), (b, rows[~left])]
    return out


def _softmax(m: np.ndarray) -> np.ndarray:
    e = np.exp(m - m.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def gradients(margin: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the loss by each output: squares / 2, logistic or softmax."""
    if classes > 2:
        p = _softmax(margin)
        g = p.copy()
        g[np.arange(len(label)), label.astype(np.int64)] -= 1.0
    elif classes:
        p = 1.0 / (1.0 + np.exp(-margin))
        g = p - label[:, None]
    else:
        return (margin - label[:, None]) * weight[:, None], np.repeat(weight[:, None], margin.shape[1], axis=1)
    return g * weight[:, None], p * (1.0 - p) * weight[:, None]


_STATE = "bins binary, label double, weight double, draw long, margin array<double>"


def _rows(batch: pa.RecordBatch, width: int, outputs: int, trees: list[list[Tree]]):
    """Bins, label, weight, draw and margin of a batch, with the given rounds of trees added."""
    n = batch.num_rows
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.uint8).reshape(n, width)
    margin = matrix(batch.column("margin"), outputs).copy()
    for group in trees:
        for k, tree in enumerate(group):
            margin[:, k] += tree.scores(bins)[:, 0]
    return bins, *(batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight", "draw")), margin


def _soft(x, l1: float):
    return F.greatest(F.abs(x) - F.lit(l1), F.lit(0.0))


def best_splits(cells: DataFrame, p: Boosting) -> DataFrame:
    """The best split of each (output, node) from sums of gradients (g), hessians (h) and rows (n) by feature and bin.

    A split sends the bins up to ``bin`` left.  Its gain is half of what the squared sums over hessians gain; of equal
    ones the first feature and bin count.  A node without a split has a null gain and its own sums.
    """
    by = ["out", "node", "feature"]
    sums = cells.groupBy(*by, "bin").agg(*(F.sum(c).alias(c) for c in "ghn"))
    along, whole = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    part = sums.select(*by, "bin", *(F.sum(c).over(along).alias(f"left_{c}") for c in "ghn"), *(F.sum(c).over(whole).alias(c) for c in "ghn"))

    def value(g, h):
        return _soft(g, p.l1) * _soft(g, p.l1) / (h + F.lit(p.l2 + 1e-12))
    g, h, n = (F.col(c) - F.col(f"left_{c}") for c in "ghn")
    gain = 0.5 * (value(F.col("left_g"), F.col("left_h")) + value(g, h) - value(F.col("g"), F.col("h"))) - F.lit(p.min_gain)
    fine = (F.col("left_n") >= p.min_rows) & (n >= p.min_rows) & (n > 0) & (F.col("left_h") >= p.min_hessian) & (h >= p.min_hessian)
    part = part.withColumn("gain", F.when(fine & (gain > 1e-12), gain))
    order = F.struct("gain", (-F.col("feature")).alias("f"), (-F.col("bin")).alias("b"))
    return part.groupBy("out", "node").agg(F.max_by(F.struct(*SPLIT), order).alias("s")).select("out", "node", "s.*")


def best_level_split(cells: DataFrame, p: Boosting, bins: int) -> DataFrame:
    """The split of each output that gains most over all its nodes together, with the sums left of it and the whole sums of each node."""
    def best(table: pa.Table) -> pa.Table:
        node, cut = (table.column(c).to_numpy() for c in ("node", "bin"))
        nodes, row = np.unique(node, return_inverse=True)
        g, h, n = (np.bincount(row * bins + cut, table.column(c).to_numpy(), len(nodes) * bins).reshape(-1, bins) for c in "ghn")
        value = lambda a, b: np.maximum(np.abs(a) - p.l1, 0.0) ** 2 / (b + p.l2 + 1e-12)
        left = [x.cumsum(axis=1) for x in (g, h, n)]
        whole = [x[:, -1:] for x in left]
        gain = 0.5 * (value(left[0], left[1]) + value(whole[0] - left[0], whole[1] - left[1]) - value(whole[0], whole[1])).sum(axis=0) - p.min_gain
        rows = left[2].sum(axis=0)
        gain[(rows == 0) | (rows == rows[-1])] = -np.inf
        at = int(np.argmax(gain))
        lists = [pa.array([x[:, 0 if x.shape[1] == 1 else at]]) for x in (*left, *whole)]
        return pa.table([table.column("out").slice(0, 1), table.column("feature").slice(0, 1), pa.array([at], pa.int32()), pa.array([gain[at]]), pa.array([nodes], pa.list_(pa.int32())), *lists],
                        names=["out", "feature", "bin", "gain", "nodes", *(f"left_{c}" for c in "ghn"), *"ghn"])
    sums = cells.groupBy("out", "node", "feature", "bin").agg(*(F.sum(c).alias(c) for c in "ghn"))
    lists = ", ".join(f"{c} array<double>" for c in (*(f"left_{c}" for c in "ghn"), *"ghn"))
    found = sums.groupBy("out", "feature").applyInArrow(best, f"out int, feature int, bin int, gain double, nodes array<int>, {lists}")
    return found.groupBy("out").agg(F.max_by(F.struct(*found.columns), F.struct("gain", -F.col("feature"))).alias("s")).select("s.*")


def _pass(state: DataFrame, growers: list[_Grower], opened: list[tuple[int, int]], added: list[list[Tree]], columns: np.ndarray, width: int,
          bins: int, classes: int, p: Boosting, round_: int) -> DataFrame:
    outputs = len(growers)
    slot = {node: i for i, node in enumerate(opened)}
    at = [{node: i for (k, node), i in slot.items() if k == out} for out in range(outputs)]

    def run(batches):
        sums = np.zeros((3, len(opened), len(columns), bins))
        for batch in batches:
            if not batch.num_rows:
                continue
            x, label, weight, draw, margin = _rows(batch, width, outputs, added)
            if p.rows < 1.0:
                keep = _drawn(draw, p.seed, round_) < p.rows
                x, label, weight, margin = x[keep], label[keep], weight[keep], margin[keep]
            g, h = gradients(margin, label, weight, classes)
            for k in range(outputs):
                if not at[k]:
                    continue
                where = _slots(growers[k], x, at[k])
                rows = np.flatnonzero(where >= 0)
                for i, j in enumerate(columns):
                    cell = where[rows] * bins + x[rows, j]
                    for s, of in enumerate((g[rows, k], h[rows, k], weight[rows])):
                        sums[s, :, i, :] += np.bincount(cell, of, len(opened) * bins).reshape(-1, bins)
        node, feature, cut = np.nonzero(sums[2])
        yield pa.record_batch(
            [pa.array(np.array([opened[i][0] for i in node], np.int32)), pa.array(np.array([opened[i][1] for i in node], np.int32)),
             pa.array(columns[feature].astype(np.int32)), pa.array(cut.astype(np.int32)), *(pa.array(sums[s, node, feature, cut]) for s in range(3))],
            ["out", "node", "feature", "bin", "g", "h", "n"])
    return state.mapInArrow(run, "out int, node int, feature int, bin int, g double, h double, n double")


def _drawn(draw: np.ndarray, seed: int, round_: int) -> np.ndarray:
    """A number from 0 to 1 for each row, another one in every round."""
    x = draw.astype(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + round_ * 0xD1342543DE82EF95) & (1 << 64) - 1)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ x >> np.uint64(shift)) * np.uint64(factor)
    return (x ^ x >> np.uint64(31)) / 2.0**64


def fit_boosting(df: DataFrame, classes: int = 0, p: Boosting | None = None) -> BoostedModel:
    """Fit on ``features`` (vector), ``label`` (classes 0..n-1, or any number when ``classes`` is 0) and, if there is one, ``weight``.

    Rows are sampled by a hash of their content, so a fit does not depend on how rows lie in partitions (equal rows are
    drawn together), up to the order in which sums are added.  NaN counts as larger than every number.  An empty table
    or one without columns gives the constant model.
    """
    p = p or Boosting()
    if not 2 <= p.bins <= 256:
        raise ValueError("bins must be from 2 to 256")
    weight = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    rows = df.select("features", F.col("label").cast("double").alias("label"), weight.cast("double").alias("weight"))
    first = rows.first()
    width = len(first["features"]) if first else 0
    outputs = classes if classes > 2 else 1
    if classes:
        sizes = [F.sum(F.when(F.col("label") == c, F.col("weight")).otherwise(0.0)) for c in range(max(classes, 2))]
    else:
        sizes = [F.sum(F.col("label") * F.col("weight"))]
    found = rows.agg(F.sum("weight"), *sizes).first()
    total, shares = found[0] or 0.0, [(x or 0.0) / (found[0] or 1.0) for x in found[1:]]
    log = lambda x: float(np.log(max(x, 1e-15)))
    base = shares if not classes else [log(x) for x in shares] if classes > 2 else [log(shares[1]) - log(shares[0])]
    if not width or not total:
        return BoostedModel([], base if total else [0.0] * outputs, classes, width)
    edges = bin_edges(rows, width, p.bins)
    bins = max(len(e) for e in edges) + 1

    def encode(batches):
        for batch in batches:
            x = _binned(matrix(batch.column("x"), width), edges)
            start = pa.array([base] * batch.num_rows, pa.list_(pa.float64()))
            yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), *(batch.column(c) for c in ("label", "weight", "draw")), start],
                                  ["bins", "label", "weight", "draw", "margin"])
    x = vector_to_array("features")
    state = cut_lineage(rows.select(x.alias("x"), "label", "weight", F.xxhash64(x, "label", "weight").alias("draw")).mapInArrow(encode, _STATE))
    rng = np.random.default_rng(p.seed)
    done: list[list[Tree]] = []
    added: list[list[Tree]] = []

    def leaf(g: float, h: float) -> float:
        return -p.rate * np.sign(g) * max(abs(g) - p.l1, 0.0) / (h + p.l2 + 1e-12)
    for round_ in range(p.rounds):
        columns = np.sort(rng.choice(width, max(1, int(np.ceil(p.columns * width))), replace=False))
        if p.oblivious:
            trees = _grow_levels(state, added, columns, width, bins, classes, outputs, p, round_)
            if all(not t.levels for t in trees) and p.rows >= 1.0 and p.columns >= 1.0:
                break
            done.append([t.tree(leaf, edges) for t in trees])
            added.append([t.tree(leaf) for t in trees])
            if len(added) == ROUNDS_KEPT and round_ + 1 < p.rounds:
                state, added = _written(state, added, width, outputs), []
            continue
        growers = _grow(state, added, columns, width, bins, classes, outputs, p, round_)
        if not any(g.split for g in growers) and p.rows >= 1.0 and p.columns >= 1.0:
            break  # no further round would find a split either
        done.append([g.tree(p.leaves, leaf, edges) for g in growers])
        added.append([g.tree(p.leaves, leaf) for g in growers])
        if len(added) == ROUNDS_KEPT and round_ + 1 < p.rounds:
            state = _written(state, added, width, outputs)
            added = []
    return BoostedModel(done, base, classes, width)


def _written(state: DataFrame, trees: list[list[Tree]], width: int, outputs: int) -> DataFrame:
    def run(batches):
        for batch in batches:
            *_, margin = _rows(batch, width, outputs, trees)
            sums = pa.ListArray.from_arrays(pa.array(np.arange(0, margin.size + 1, outputs, dtype=np.int32)), pa.array(margin.ravel()))
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", sums)
    return cut_lineage(state.mapInArrow(run, _STATE))


def _grow(state: DataFrame, added: list[list[Tree]], columns: np.ndarray, width: int, bins: int, classes: int, outputs: int, p: Boosting,
          round_: int) -> list[_Grower]:
    growers = [_Grower(0.0, 0.0, 0.0) for _ in range(outputs)]
    opened = [(k, 0) for k in range(outputs)]
    for _ in range(p.depth if p.leaves > 1 else 0):
        each = max(1, PASS_CELLS // (len(columns) * bins))
        found = []
        for i in range(0, len(opened), each):
            found += best_splits(_pass(state, growers, opened[i:i + each], added, columns, width, bins, classes, p, round_), p).collect()
        opened = []
        for r in sorted(found, key=lambda r: (r["out"], r["node"])):
            grower = growers[r["out"]]
            if r["node"] == 0:
                grower.sums[0] = (r["g"], r["h"], r["n"])
            if r["gain"] is not None:
                left = r["left_g"], r["left_h"], r["left_n"]
                grower.divide(r["node"], r["gain"], r["feature"], r["bin"], left, tuple(r[c] - x for c, x in zip("ghn", left)))
                opened += [(r["out"], child) for child in grower.split[r["node"]][3:]]
        if not opened:
            break
    return growers


class _LevelGrower(_Grower):
    """A tree that grows by whole levels; node numbers are those of a complete tree, so a node without rows is no gap."""

    def __init__(self):
        self.levels: list[tuple[int, int, float]] = []  # feature, bin, gain
        self.sums = {0: (0.0, 0.0, 0.0)}
        self.split = {}

    def opened(self) -> range:
        return range((1 << len(self.levels)) - 1, (2 << len(self.levels)) - 1)

    def level(self, row) -> None:
        for i, node in enumerate(row["nodes"]):
            left = tuple(row[f"left_{c}"][i] for c in "ghn")
            self.sums[2 * node + 1], self.sums[2 * node + 2] = left, tuple(row[c][i] - x for c, x in zip("ghn", left))
        for node in self.opened():
            self.split[node] = row["gain"], row["feature"], row["bin"], 2 * node + 1, 2 * node + 2
        self.levels.append((row["feature"], row["bin"], row["gain"]))

    def tree(self, weight, edges: list[np.ndarray] | None = None) -> Tree:
        sums = [self.sums.get(node, (0.0, 0.0, 0.0)) for node in self.opened()]
        value, cover = np.array([[weight(g, h)] for g, h, _ in sums]), np.array([n for *_, n in sums], float)
        return LevelTree.of([(f, float(b if edges is None else edges[f][b])) for f, b, _ in self.levels], value, cover, np.array([x for *_, x in self.levels]))


def _grow_levels(state: DataFrame, added: list[list[Tree]], columns: np.ndarray, width: int, bins: int, classes: int, outputs: int, p: Boosting,
                 round_: int) -> list[_LevelGrower]:
    growers, live = [_LevelGrower() for _ in range(outputs)], set(range(outputs))
    for _ in range(p.depth):
        opened = [(k, node) for k in sorted(live) for node in growers[k].opened()]
        if not opened:
            break
        cells, each = None, max(1, PASS_CELLS // (len(columns) * bins))
        for i in range(0, len(opened), each):
            part = _pass(state, growers, opened[i:i + each], added, columns, width, bins, classes, p, round_)
            cells = part if cells is None else cells.unionAll(part)
        for r in best_level_split(cells, p, bins).collect():
            grower = growers[r["out"]]
            if not grower.levels:
                grower.sums[0] = tuple(r[c][0] for c in "ghn")
            if r["gain"] > 1e-12:
                grower.level(r)
            else:
                live.discard(r["out"])
    return growers


class BoostedModel:
    """Rounds of trees, one for each output, on top of a constant."""

    def __init__(self, rounds: list[list[Tree]], base: list[float], classes: int, width: int):
        self.rounds, self.base, self.classes, self.width = rounds, list(base), classes, width

    @property
    def featureImportances(self):  # noqa: N802 (the name that Spark's models have)
        """Share of each feature in the gain of all splits."""
        out = np.zeros(self.width)
        for tree in (t for group in self.rounds for t in group):
            np.add.at(out, tree.feature[tree.feature >= 0], tree.gain[tree.feature >= 0])
        return Vectors.dense(out / out.sum() if out.sum() > 0 else out)

    def margins(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(np.array(self.base, float), (len(x), 1))
        for group in self.rounds:
            for k, tree in enumerate(group):
                out[:, k] += tree.scores(x)[:, 0]
        return out

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities, or the one prediction."""
        m = self.margins(x)
        if self.classes > 2:
            return _softmax(m)
        if self.classes:
            p = 1.0 / (1.0 + np.exp(-m))
            return np.hstack((1.0 - p, p))
        return m

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and, for classes, ``probability``."""
        model = self

        @F.arrow_udf("array<double>")
        def scored(x: pa.Array) -> pa.Array:
            out = model.outputs(matrix(x, model.width) if model.width else np.zeros((len(x), 0)))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
        out = df.withColumn("_v", scored(vector_to_array("features")))
        if not self.classes:
            return out.withColumn("prediction", F.get("_v", F.lit(0))).drop("_v")
        best = (F.array_position("_v", F.array_max("_v")) - 1).cast("double")
        return out.withColumn("prediction", best).withColumn("probability", array_to_vector("_v")).drop("_v")
