"""Kernel machines on large tables: Nystroem landmarks, then a margin solver by Newton steps.

A bounded number of landmark rows spans the kernel: a row becomes its kernel values with the landmarks, whitened, and
products of such vectors come near the kernel's values.  On these vectors the squared hinge (classes) or the squared
epsilon-insensitive loss (numbers) is minimised.  Each step needs one scan: tasks add up gradient and curvature over the
rows that lie inside the margin, two small matrices, and the driver solves for the next step.  Vectors are worked out
anew in every scan, so nothing the width of the landmarks is stored for each row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.operators.trees import matrix

LANDMARKS = 256
# Groups in which the tasks' matrices are added up first.
SUM_PARTS = 32


class KernelMap:
    """Rows as vectors whose products come near ``kernel``: rbf exp(-gamma |x - y|^2) or poly (gamma x.y)^3."""

    def __init__(self, landmarks: np.ndarray, kernel: str, gamma: float):
        if kernel not in ("rbf", "poly"):
            raise ValueError(f"unknown kernel {kernel!r}")
        self.landmarks, self.kernel, self.gamma = landmarks, kernel, gamma
        values, vectors = np.linalg.eigh(self.values(landmarks, landmarks))
        keep = values > max(values.max(initial=0.0), 1e-12) * 1e-10
        self.whiten = vectors[:, keep] / np.sqrt(values[keep])

    def values(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        product = x @ y.T
        if self.kernel == "poly":
            return (self.gamma * product) ** 3
        return np.exp(-self.gamma * np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2.0 * product, 0.0))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self.values(x, self.landmarks) @ self.whiten


def kernel_map(df: DataFrame, kernel: str = "rbf", landmarks: int = LANDMARKS, gamma: float | None = None) -> KernelMap:
    """Map spanned by ``landmarks`` distinct rows, those with the smallest hashes; ``gamma`` is 1 / (columns * variance of all entries) unless given."""
    x = vector_to_array("features")
    picked = df.select(x.alias("x")).distinct().orderBy(F.xxhash64("x"), "x").limit(landmarks).collect()
    points = np.array([r["x"] for r in picked], float).reshape(len(picked), len(picked[0]["x"]) if picked else 0)
    if gamma is None:
        entries = df.select(F.explode(x).alias("v")).agg(F.var_pop("v"), F.count("*")).first()
        gamma = 1.0 / (max(points.shape[1], 1) * entries[0]) if entries[0] else 1.0
    return KernelMap(points, kernel, gamma)


def _with_one(z: np.ndarray) -> np.ndarray:
    return np.hstack((z, np.ones((len(z), 1))))


def _scan(rows: DataFrame, to: KernelMap, weights: np.ndarray, classes: int, epsilon: float) -> list[tuple[float, np.ndarray, np.ndarray]]:
    """For each output: the loss, and the sums of z z' and z t over the rows inside the margin (t is what a row should say)."""
    outputs, d = weights.shape

    def run(batches):
        loss, curve, pull = np.zeros(outputs), np.zeros((outputs, d, d)), np.zeros((outputs, d))
        for batch in batches:
            if not batch.num_rows:
                continue
            z = _with_one(to(matrix(batch.column("x"), to.landmarks.shape[1])))
            label, weight = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
            for k in range(outputs):
                said = z @ weights[k]
                if classes:
                    sign = np.where(label == (1 if outputs == 1 else k), 1.0, -1.0)
                    gap = np.maximum(1.0 - sign * said, 0.0)
                    wanted = sign
                else:
                    off = label - said
                    gap = np.maximum(np.abs(off) - epsilon, 0.0)
                    wanted = label - np.sign(off) * epsilon
                inside = gap > 0
                a, w = z[inside], weight[inside]
                loss[k] += (weight * gap * gap).sum()
                curve[k] += (a * w[:, None]).T @ a
                pull[k] += (a * w[:, None]).T @ wanted[inside]
        sums = [np.concatenate(([loss[k]], pull[k], curve[k].ravel())) for k in range(outputs)]
        yield pa.record_batch([pa.array(range(outputs), pa.int32()), pa.array(sums, pa.list_(pa.float64()))], ["out", "sums"])

    def add(table: pa.Table) -> pa.Table:
        total = np.sum([np.asarray(x) for x in table.column("sums").to_pylist()], axis=0)
        return pa.table({"out": table.column("out").slice(0, 1), "sums": pa.array([total], pa.list_(pa.float64()))})
    schema = "out int, sums array<double>"
    parts = rows.mapInArrow(run, schema).withColumn("part", F.spark_partition_id() % SUM_PARTS).groupBy("out", "part").applyInArrow(add, schema)
    found = {r["out"]: np.array(r["sums"]) for r in parts.groupBy("out").applyInArrow(add, schema).collect()}
    none = np.zeros(1 + d + d * d)
    return [(float(s[0]), s[1 + d:].reshape(d, d), s[1:1 + d]) for s in (found.get(k, none) for k in range(outputs))]


class KernelMachine:
    """Scores of a kernel machine, one for each class (one in all for two classes), or predictions."""

    def __init__(self, to: KernelMap, weights: np.ndarray, classes: int, sigmoids: list[tuple[float, float]] | None = None):
        self.to, self.weights, self.classes, self.sigmoids = to, weights, classes, sigmoids

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _with_one(self.to(x)) @ self.weights.T

    def outputs(self, x: np.ndarray) -> np.ndarray:
        """Class probabilities (each score through its sigmoid, sharing out to 1), or the one prediction."""
        s = self.scores(x)
        if not self.classes:
            return s
        p = np.column_stack([1.0 / (1.0 + np.exp(-np.clip(a * s[:, k] + b, -500, 500))) for k, (a, b) in enumerate(self.sigmoids)])
        if p.shape[1] == 1:
            return np.hstack((1.0 - p, p))
        total = p.sum(axis=1, keepdims=True)
        return np.where(total > 0, p / np.where(total > 0, total, 1.0), 1.0 / p.shape[1])

    def _column(self, of):
        width = self.to.landmarks.shape[1]

        @F.arrow_udf("array<double>")
        def scored(x: pa.Array) -> pa.Array:
            out = of(matrix(x, width))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
        return scored(vector_to_array("features"))

    def transform(self, df: DataFrame) -> DataFrame:
        out = df.withColumn("_v", self._column(self.outputs))
        if not self.classes:
            return out.withColumn("prediction", F.get("_v", F.lit(0))).drop("_v")
        best = (F.array_position("_v", F.array_max("_v")) - 1).cast("double")
        return out.withColumn("prediction", best).withColumn("probability", array_to_vector("_v")).drop("_v")


def fit_kernel_machine(df: DataFrame, classes: int = 0, c: float = 1.0, kernel: str = "rbf", epsilon: float = 0.1, landmarks: int = LANDMARKS,
                       gamma: float | None = None, steps: int = 30, tolerance: float = 1e-6) -> KernelMachine:
    """Fit on ``features``, ``label`` (classes 0..n-1, or any number when ``classes`` is 0) and, if there is one, ``weight``.

    Minimises |w|^2 / 2 + c * (sum of weight * loss), the constant being free of the penalty; every row counts.  More
    than two classes get a machine each, against the rest, all in the same scans.  A step is halved until the objective
    falls.  Sigmoids that turn scores into probabilities are fitted to the scores of the training rows.  The landmarks
    are a bounded sample; it shapes the kernel's approximation and leaves out no row.
    """
    weight = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    rows = df.select("features", vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), weight.cast("double").alias("weight"))
    to = kernel_map(rows, kernel, landmarks, gamma)
    outputs, d = (classes if classes > 2 else 1), to.whiten.shape[1] + 1
    weights, free = np.zeros((outputs, d)), np.append(np.ones(d - 1), 0.0)
    if not len(to.landmarks):
        return KernelMachine(to, weights, classes, [(1.0, 0.0)] * outputs if classes else None)

    def objective(k, w, loss):
        return 0.5 * float(free * w @ w) + c * loss
    found = _scan(rows, to, weights, classes, epsilon)
    now = [objective(k, weights[k], found[k][0]) for k in range(outputs)]
    for _ in range(steps):
        step = np.zeros_like(weights)
        for k, (_, curve, pull) in enumerate(found):
            step[k] = np.linalg.lstsq(np.diag(free) + 2.0 * c * curve + 1e-12 * np.eye(d), 2.0 * c * pull, rcond=None)[0] - weights[k]
        size, live = np.ones(outputs), np.abs(step).max(axis=1) > tolerance
        if not live.any():
            break
        while True:
            tried = weights + step * (size * live)[:, None]
            new = _scan(rows, to, tried, classes, epsilon)
            value = [objective(k, tried[k], new[k][0]) for k in range(outputs)]
            worse = np.array([live[k] and value[k] > now[k] + 1e-12 * abs(now[k]) for k in range(outputs)])
            if not worse.any():
                break
            size[worse] /= 2
            live &= size > 1e-4
        gain = max(a - b for a, b in zip(now, value))
        weights, found = tried, new
        was, now = now, value
        if gain <= tolerance * (1.0 + max(map(abs, was))):
            break
    return KernelMachine(to, weights, classes, _sigmoids(rows, KernelMachine(to, weights, classes), outputs) if classes else None)


def _sigmoids(rows: DataFrame, machine: KernelMachine, outputs: int) -> list[tuple[float, float]]:
    scored = rows.select("label", "weight", machine._column(machine.scores).alias("s"))
    out = []
    for k in range(outputs):
        one = scored.select((F.col("label") == (1 if outputs == 1 else k)).cast("double").alias("label"), "weight", array_to_vector(F.array(F.get("s", F.lit(k)))).alias("features"))
        model = LogisticRegression(weightCol="weight", regParam=1e-6, standardization=False).fit(one)
        a, b = float(model.coefficients[0]), float(model.intercept)
        out.append((a, float(np.clip(b, -500, 500))))
    return out
