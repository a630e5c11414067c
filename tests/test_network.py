"""Networks: gradients by differences, steps by hand, partitions, penalty, a task that no line solves."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabsmith.operators import network as nw
from tabsmith.operators.models import Task, registry, requested_families, score
from tabsmith.sources import runs as run_store


def frame(spark, x, y, w=None, parts=3):
    rows = [(Vectors.dense(a), float(b), 1.0 if w is None else float(w[i])) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["features", "label", "weight"]).repartition(parts)


@pytest.fixture(scope="module")
def corners():
    rng = np.random.default_rng(1)
    x = rng.uniform(-1, 1, size=(400, 2))
    return x, ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)


@pytest.mark.parametrize("classes", [0, 3])
def test_gradient_by_differences(classes):
    rng = np.random.default_rng(0)
    sizes = [3, 5, 4, classes or 1]
    layers = nw.start_weights(sizes, 1)
    x, w = rng.normal(size=(20, 3)), rng.random(20) + 0.5
    y = rng.integers(0, 3, 20).astype(float) if classes else rng.normal(size=20)
    flat = nw._flat(layers)
    _, got = nw.loss_and_gradient(layers, x, y, w, classes)
    want = np.empty_like(flat)
    for i in range(len(flat)):
        e = np.zeros_like(flat)
        e[i] = 1e-6
        want[i] = (nw.loss_and_gradient(nw._layers(flat + e, sizes), x, y, w, classes)[0] - nw.loss_and_gradient(nw._layers(flat - e, sizes), x, y, w, classes)[0]) / 2e-6
    assert np.allclose(got, want, atol=1e-5)


def test_steps_by_hand(spark, corners):
    """One batch an epoch: every step is Adam's on the whole table."""
    x, y = corners
    w = np.where(np.arange(400) % 5 == 0, 3.0, 1.0)
    got = nw.fit_network(frame(spark, x, y, w), 2, (4,), penalty=0.5, rate=0.01, epochs=3, batches=1, seed=3)
    sizes = [2, 4, 2]
    flat = nw._flat(nw.start_weights(sizes, 3))
    m, v = np.zeros_like(flat), np.zeros_like(flat)
    decayed = np.concatenate([np.ones(8), np.zeros(4), np.ones(8), np.zeros(2)])
    for t in range(1, 4):
        _, g = nw.loss_and_gradient(nw._layers(flat, sizes), x, y, w, 2)
        g = (g + 0.5 * decayed * flat) / w.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        flat = flat - 0.01 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert np.allclose(got.flat, flat, atol=1e-9) and len(got.losses) == 3


def test_partitions_and_penalty(spark, corners):
    x, y = corners
    one, five = (nw.fit_network(frame(spark, x, y, parts=n), 2, (6,), rate=0.01, epochs=2, batches=3) for n in (1, 5))
    assert np.allclose(one.flat, five.flat, atol=1e-9)
    heavy = nw.fit_network(frame(spark, x, y), 2, (6,), penalty=300.0, rate=0.05, epochs=8, batches=2)
    light = nw.fit_network(frame(spark, x, y), 2, (6,), penalty=0.0, rate=0.05, epochs=8, batches=2)
    assert np.linalg.norm(heavy.flat) < 0.7 * np.linalg.norm(light.flat)


def test_what_no_line_separates(spark, corners):
    x, y = corners
    train, test = frame(spark, x[:300], y[:300]), frame(spark, x[300:], y[300:])
    model = registry(True)["network"].fit(train, Task(True, 2, 300, 2), {"hidden": (16,), "penalty": 1e-4, "rate": 0.05, "epochs": 20, "batches": 2})
    right = score(model, test).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    assert right > 0.9 and model.losses[-1] < 0.5 * model.losses[0]


def test_end_by_patience_odd_tables_and_saved_network(spark, corners, tmp_path):
    x, y = corners
    model = nw.fit_network(frame(spark, x[:40], np.zeros(40)), 0, (3,), rate=1e-9, epochs=30, batches=1, patience=2)
    assert len(model.losses) == 3
    run_store.save_model(spark, model, str(tmp_path / "m"))
    assert np.allclose(run_store.load_model(spark, str(tmp_path / "m")).outputs(x), model.outputs(x))
    none = frame(spark, x[:2], [0, 1]).where("label > 5")
    assert score(nw.fit_network(none, 2), none).count() == 0
    assert list(requested_families(["mlp"], True)) == ["network"] and list(requested_families(["neural_net"], False)) == ["network"]
