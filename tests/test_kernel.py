"""Kernel machines: the approximated kernel, the solver against a dense one, tasks that no linear model solves."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabsmith.operators import kernel as km
from tabsmith.operators.models import Task, registry, requested_families, score
from tabsmith.sources import runs as run_store


def frame(spark, x, y, w=None):
    rows = [(Vectors.dense(a), float(b), 1.0 if w is None else float(w[i])) for i, (a, b) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, ["features", "label", "weight"]).repartition(3)


@pytest.fixture(scope="module")
def rings():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(500, 2))
    r = np.sqrt((x * x).sum(axis=1))
    return x, np.where(r < 0.8, 0, np.where(r < 1.5, 1, 2))


def test_products_come_near_the_kernel(spark, rings):
    x, y = rings
    errors = {}
    for kernel in ("rbf", "poly"):
        for m in (30, 120):
            to = km.kernel_map(frame(spark, x, y), kernel, m)
            exact = to.values(x, x)
            z = to(x)
            errors[kernel, m] = np.linalg.norm(z @ z.T - exact) / np.linalg.norm(exact)
            on = to(to.landmarks)
            assert len(to.landmarks) == m and np.allclose(on @ on.T, to.values(to.landmarks, to.landmarks), atol=1e-3)
    # A cubic kernel of two columns has four dimensions, so thirty landmarks span it.
    assert errors["rbf", 120] < 0.01 and errors["rbf", 120] <= errors["rbf", 30] < 0.1 and errors["poly", 30] < 1e-6
    assert abs(to.gamma - 1 / (2 * x.var())) < 1e-9


def dense(z, y, w, c, classes, epsilon=0.1, steps=20000):
    """Gradient descent on the same objective."""
    u = np.zeros(z.shape[1])
    free = np.append(np.ones(z.shape[1] - 1), 0.0)
    rate = 1.0 / (1.0 + 2 * c * np.linalg.norm((z * w[:, None]).T @ z, 2))
    for _ in range(steps):
        s = z @ u
        if classes:
            slope = -2 * w * y * np.maximum(1 - y * s, 0)
        else:
            off = y - s
            slope = -2 * w * np.sign(off) * np.maximum(np.abs(off) - epsilon, 0)
        u = u - rate * (free * u + c * z.T @ slope)
    return u


def test_solver_reaches_the_minimum(spark, rings):
    x, y = rings
    w = np.where(np.arange(len(x)) % 3 == 0, 2.0, 1.0)
    two = km.fit_kernel_machine(frame(spark, x, y == 1, w), 2, 0.5, landmarks=20)
    z = km._with_one(two.to(x))
    want = dense(z, np.where(y == 1, 1.0, -1.0), w, 0.5, True)
    assert np.abs(z @ want - two.scores(x)[:, 0]).max() < 0.01
    target = np.sin(x[:, 0] * 2) * 3
    number = km.fit_kernel_machine(frame(spark, x, target, w), 0, 0.5, epsilon=0.2, landmarks=20)
    want = dense(km._with_one(number.to(x)), target, w, 0.5, False, 0.2)
    assert np.abs(km._with_one(number.to(x)) @ want - number.outputs(x)[:, 0]).max() < 0.02


def test_what_no_line_separates(spark, rings):
    x, y = rings
    train, test = frame(spark, x[:350], y[:350]), frame(spark, x[350:], y[350:])
    right = lambda m: score(m, test).agg(F.avg((F.col("prediction") == F.col("label")).cast("int"))).first()[0]
    curved = registry(True)["kernel_svm"].fit(train, Task(True, 3, 350, 2), {"C": 10.0, "kernel": "rbf", "landmarks": 80})
    straight = registry(True)["logistic_regression"].fit(train, Task(True, 3, 350, 2), {"C": 1.0})
    assert right(curved) > 0.9 > 0.7 > right(straight)
    p = curved.outputs(x)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == curved.scores(x).argmax(axis=1)).mean() > 0.95
    wave = np.sin(x[:, 0] * 3)
    number = registry(False)["kernel_svm"].fit(frame(spark, x[:350], wave[:350]), Task(False), {"C": 10.0, "kernel": "rbf", "landmarks": 80})
    assert np.mean((number.outputs(x[350:])[:, 0] - wave[350:]) ** 2) < 0.1 * wave.var()


def test_odd_tables_and_saved_machine(spark, rings, tmp_path):
    x, y = rings
    same = frame(spark, np.ones((6, 2)), [0, 1, 1, 1, 1, 1])
    assert score(km.fit_kernel_machine(same, 2), same).select("prediction").distinct().collect()[0][0] == 1.0
    none = same.where("label > 5")
    assert score(km.fit_kernel_machine(none, 2), none).count() == 0
    assert list(requested_families(["svm"], False)) == ["kernel_svm"] and list(requested_families(["svm"], True)) == ["kernel_svm"]
    model = km.fit_kernel_machine(frame(spark, x, y), 3, kernel="poly", landmarks=15)
    run_store.save_model(spark, model, str(tmp_path / "m"))
    assert np.allclose(run_store.load_model(spark, str(tmp_path / "m")).outputs(x), model.outputs(x))
