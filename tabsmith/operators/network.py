"""Fully connected networks by mini-batches: tasks add up gradients, the driver holds the weights and Adam's moments.

Rows are dealt to batches by a hash of their content and written once, a folder for each batch, so a step reads only the
rows that it uses.  What a task sends is one gradient; gradients are added in two levels before the driver sees them.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.session import shared_folder
from tabsmith.operators.trees import matrix

SUM_PARTS = 32
# Adam's decay rates and the number that keeps its quotient finite.
DECAY, DECAY_SQUARES, TINY = 0.9, 0.999, 1e-8

Layers = list[tuple[np.ndarray, np.ndarray]]


def start_weights(sizes: Sequence[int], seed: int) -> Layers:
    """Uniform weights within sqrt(6 / (inputs + outputs)) of each layer."""
    rng = np.random.default_rng(seed)
    bounds = [np.sqrt(6.0 / (a + b)) for a, b in zip(sizes[:-1], sizes[1:])]
    return [(rng.uniform(-r, r, (a, b)), rng.uniform(-r, r, b)) for r, a, b in zip(bounds, sizes[:-1], sizes[1:])]


def forward(layers: Layers, x: np.ndarray) -> list[np.ndarray]:
    """Inputs of each layer (after the rectifier) and the last layer's outputs."""
    out = [x]
    for i, (w, b) in enumerate(layers):
        z = out[-1] @ w + b
        out.append(np.maximum(z, 0.0) if i < len(layers) - 1 else z)
    return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def loss_and_gradient(layers: Layers, x: np.ndarray, label: np.ndarray, weight: np.ndarray, classes: int) -> tuple[float, np.ndarray]:
    """Summed loss (cross entropy, or half the squared error) over rows, and its gradient by all weights in order."""
    values = forward(layers, x)
    if classes:
        p, at = _softmax(values[-1]), label.astype(np.int64)
        rows = np.arange(len(x))
        loss = float(-(weight * np.log(np.maximum(p[rows, at], 1e-300))).sum())
        back = p
        back[rows, at] -= 1.0
    else:
        back = values[-1] - label[:, None]
        loss = 0.5 * float((weight[:, None] * back * back).sum())
    back = back * weight[:, None]
    parts = []
    for (w, _), value in zip(reversed(layers), reversed(values[:-1])):
        parts = [(value.T @ back).ravel(), back.sum(axis=0), *parts]
        back = (back @ w.T) * (value > 0)
    return loss, np.concatenate(parts)


def _flat(layers: Layers) -> np.ndarray:
    return np.concatenate([x.ravel() for layer in layers for x in layer])


def _layers(flat: np.ndarray, sizes: Sequence[int]) -> Layers:
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append((flat[at:at + a * b].reshape(a, b), flat[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def _gradient(rows: DataFrame, flat: np.ndarray, sizes: Sequence[int], classes: int) -> tuple[float, float, np.ndarray]:
    """Weight of the rows, summed loss and summed gradient."""
    def run(batches):
        layers, total = _layers(flat, sizes), np.zeros(2 + len(flat))
        for batch in batches:
            if batch.num_rows:
                x, (label, weight) = matrix(batch.column("x"), sizes[0]), (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "weight"))
                loss, gradient = loss_and_gradient(layers, x, label, weight, classes)
                total += np.concatenate(([weight.sum(), loss], gradient))
        yield pa.record_batch([pa.array([total], pa.list_(pa.float64()))], ["sums"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"sums": pa.array([np.sum([np.asarray(x) for x in table.column("sums").to_pylist()], axis=0)], pa.list_(pa.float64()))})
    parts = rows.select("x", "label", "weight").mapInArrow(run, "sums array<double>").withColumn("part", F.spark_partition_id() % SUM_PARTS)
    found = parts.groupBy("part").applyInArrow(add, "sums array<double>").toArrow().column("sums")
    total = np.sum([np.asarray(x.as_py()) for x in found], axis=0) if len(found) else np.zeros(2 + len(flat))
    return float(total[0]), float(total[1]), total[2:]


class Network:
    """A fitted network; ``losses`` has the mean loss of each epoch."""

    def __init__(self, flat: np.ndarray, sizes: Sequence[int], classes: int, losses: Sequence[float] = ()):
        self.flat, self.sizes, self.classes, self.losses = np.asarray(flat, float), list(sizes), classes, list(losses)

    def outputs(self, x: np.ndarray) -> np.ndarray:
        out = forward(_layers(self.flat, self.sizes), x)[-1]
        return _softmax(out) if self.classes else out

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction`` and, for classes, ``probability``."""
        model = self

        @F.arrow_udf("array<double>")
        def scored(x: pa.Array) -> pa.Array:
            out = model.outputs(matrix(x, model.sizes[0]))
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
        out = df.withColumn("_v", scored(vector_to_array("features")))
        if not self.classes:
            return out.withColumn("prediction", F.get("_v", F.lit(0))).drop("_v")
        best = (F.array_position("_v", F.array_max("_v")) - 1).cast("double")
        return out.withColumn("prediction", best).withColumn("probability", array_to_vector("_v")).drop("_v")


def fit_network(df: DataFrame, classes: int = 0, hidden: Sequence[int] = (64,), penalty: float = 1e-4, rate: float = 1e-3, epochs: int = 40, batches: int = 8,
                tolerance: float = 1e-4, patience: int = 10, seed: int = 42) -> Network:
    """Fit on ``features``, ``label`` (classes 0..n-1, or any number when ``classes`` is 0) and, if there is one, ``weight``.

    A step takes the mean gradient of one batch plus ``penalty`` times the weights (not the constants) over the batch's
    rows, and moves by Adam at ``rate``.  Batches come in another order in every epoch.  The fit ends after ``epochs``, or
    when the epoch's loss has not fallen by ``tolerance`` for ``patience`` epochs.  Every row is in one batch, whatever its
    place in the table, so the result depends on partitions only by the order in which sums are added.
    """
    spark = df.sparkSession
    x = vector_to_array("features")
    weight = F.col("weight") if "weight" in df.columns else F.lit(1.0)
    rows = df.select(x.alias("x"), F.col("label").cast("double").alias("label"), weight.cast("double").alias("weight"))
    folder = shared_folder(spark, "batches")
    rows.withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), "x", "label"), F.lit(batches)).cast("int")).write.partitionBy("batch").parquet(folder)
    stored = spark.read.schema("x array<double>, label double, weight double, batch int").parquet(folder)
    first = stored.select("x").first()
    sizes = [len(first["x"]) if first else 0, *hidden, classes if classes else 1]
    flat = _flat(start_weights(sizes, seed))
    if first is None:
        return Network(flat, sizes, classes)
    decayed = np.concatenate([np.concatenate((np.ones(a * b), np.zeros(b))) for a, b in zip(sizes[:-1], sizes[1:])])
    moment, squares, step, losses, best, waited = np.zeros_like(flat), np.zeros_like(flat), 0, [], np.inf, 0
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        total, seen = 0.0, 0.0
        for b in rng.permutation(batches).tolist():
            n, loss, gradient = _gradient(stored.where(F.col("batch") == b), flat, sizes, classes)
            if n <= 0:
                continue
            total, seen, step = total + loss, seen + n, step + 1
            gradient = (gradient + penalty * decayed * flat) / n
            moment = DECAY * moment + (1 - DECAY) * gradient
            squares = DECAY_SQUARES * squares + (1 - DECAY_SQUARES) * gradient * gradient
            flat = flat - rate * (moment / (1 - DECAY**step)) / (np.sqrt(squares / (1 - DECAY_SQUARES**step)) + TINY)
        losses.append(total / max(seen, 1e-300))
        waited = 0 if losses[-1] < best - tolerance else waited + 1
        best = min(best, losses[-1])
        if waited >= patience:
            break
    return Network(flat, sizes, classes, losses)
