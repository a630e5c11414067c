"""Histogram boosting: first splits, leaf-wise order, sampling, held-out gain, odd tables, saved models."""

import numpy as np
import pytest
from pyspark.ml.classification import GBTClassifier, OneVsRest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tabsmith.operators import boosting
from tabsmith.operators.boosting import Boosting, fit_boosting
from tabsmith.operators.models import Task, registry, requested_families, score
from tabsmith.sources import runs as run_store


def frame(spark, x, y, w=None, parts=3):
    rows = [(Vectors.dense(a), float(b), *([] if w is None else [float(c)])) for a, b, c in zip(x, y, y if w is None else w)]
    return spark.createDataFrame(rows, ["features", "label"] + ["weight"] * (w is not None)).repartition(parts)


def classes_of(x):
    """Three classes in rings and stripes, which no class boundary alone separates."""
    r = x[:, 0] ** 2 + x[:, 1] ** 2
    return np.where(r < 0.6, 0, np.where((x[:, 2] > 0) ^ (x[:, 0] > 0), 1, 2))


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 4)), 2)
    x[:, 3] = rng.integers(0, 3, 900)
    y = classes_of(x)
    y[rng.random(900) < 0.05] = 0
    return x, y


def naive_tree(x, g, h, w, p, columns):
    """Leaf-wise growth by trying all thresholds: a list of (leaf rows, value) and the gains in order."""
    def value(a, b):
        return max(abs(a) - p.l1, 0.0) ** 2 / (b + p.l2 + 1e-12)

    def best(rows, depth):
        out = (0.0,)
        if depth < p.depth:
            for j in columns:
                for t in np.unique(x[rows, j])[:-1]:
                    left = rows[x[rows, j] <= t]
                    right = rows[x[rows, j] > t]
                    if min(w[left].sum(), w[right].sum()) < p.min_rows or min(h[left].sum(), h[right].sum()) < p.min_hessian:
                        continue
                    gain = 0.5 * (value(g[left].sum(), h[left].sum()) + value(g[right].sum(), h[right].sum()) - value(g[rows].sum(), h[rows].sum())) - p.min_gain
                    if gain > max(out[0] + 1e-9, 1e-12):
                        out = (gain, j, t, left, right)
        return out
    leaves = [(np.arange(len(x)), 0, best(np.arange(len(x)), 0))]
    while len(leaves) < p.leaves:
        i = max(range(len(leaves)), key=lambda k: leaves[k][2][0])
        if leaves[i][2][0] <= 0:
            break
        _, depth, (_, _, _, left, right) = leaves.pop(i)
        leaves += [(r, depth + 1, best(r, depth + 1)) for r in (left, right)]
    out = np.zeros(len(x))
    for rows, *_ in leaves:
        a, b = g[rows].sum(), h[rows].sum()
        out[rows] = -p.rate * np.sign(a) * max(abs(a) - p.l1, 0.0) / (b + p.l2 + 1e-12)
    return out


@pytest.mark.parametrize("classes", [0, 2, 3])
def test_trees_equal_naive_growth(spark, data, classes):
    x, y = data
    x, y = x[:250], y[:250]
    x = np.round(x, 1)
    w = np.where(np.arange(250) % 4 == 0, 2.0, 1.0)
    y = x[:, 0] * 2 + x[:, 1] if classes == 0 else np.minimum(y, classes - 1)
    p = Boosting(rounds=2, depth=4, leaves=6, rate=0.5, l1=0.2, l2=0.7, min_rows=5, bins=200)
    model = fit_boosting(frame(spark, x, y, w), classes, p)
    margin = np.tile(model.base, (len(x), 1)).astype(float)
    for group in model.rounds:
        g, h = boosting.gradients(margin, y.astype(float), w, classes)
        for k in range(margin.shape[1]):
            got = group[k].scores(x)[:, 0]
            assert np.allclose(got, naive_tree(x, g[:, k], h[:, k], w, p, range(4)), atol=1e-9)
        margin += np.column_stack([t.scores(x)[:, 0] for t in group])
    assert np.allclose(margin, model.margins(x))


@pytest.mark.parametrize("classes", [2, 3])
def test_gradients_by_differences(classes):
    rng = np.random.default_rng(0)
    outputs = 1 if classes == 2 else classes
    m, y, w = rng.normal(size=(40, outputs)), rng.integers(0, classes, 40).astype(float), rng.random(40) + 0.5

    def loss(m):
        if classes == 2:
            return w * (np.log1p(np.exp(m[:, 0])) - y * m[:, 0])
        return w * (np.log(np.exp(m).sum(axis=1)) - m[np.arange(40), y.astype(int)])
    g, h = boosting.gradients(m, y, w, classes)
    for k in range(outputs):
        e = np.zeros_like(m)
        e[:, k] = 1e-4
        assert np.allclose((loss(m + e) - loss(m - e)) / 2e-4, g[:, k], atol=1e-6)
        assert np.allclose((loss(m + e) - 2 * loss(m) + loss(m - e)) / 1e-8, h[:, k], atol=1e-3)


def test_partitions_do_not_matter(spark, data, monkeypatch):
    x, y = data
    p = Boosting(rounds=3, depth=3, leaves=5, rows=0.7, columns=0.6, bins=64)
    one = fit_boosting(frame(spark, x, y, parts=1), 3, p)
    monkeypatch.setattr(boosting, "ROUNDS_KEPT", 2)
    monkeypatch.setattr(boosting, "PASS_CELLS", 900)
    five = fit_boosting(frame(spark, x, y, parts=5), 3, p)
    assert np.allclose(one.margins(x), five.margins(x)) and len(one.rounds) == len(five.rounds) == 3


def test_one_booster_beats_one_vs_rest(spark, data):
    x, y = data
    train, test = frame(spark, x[:600], y[:600]), frame(spark, x[600:], y[600:])
    common = {"trees": 8, "max_depth": 3, "learning_rate": 0.4}
    ours = registry(True)["histogram_boosting"].fit(train, Task(True, 3, 600, 4), common)
    theirs = OneVsRest(classifier=GBTClassifier(maxIter=8, maxDepth=3, stepSize=0.4, seed=1), parallelism=3).fit(train)
    right = [score(m, test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] for m in (ours, theirs)]
    assert right[0] >= 0.8 and right[0] >= right[1]


def test_edges_are_values_or_quantiles(spark, data, monkeypatch):
    x = np.column_stack([np.arange(5000) % 7, np.random.default_rng(1).permutation(5000), np.full(5000, np.nan), np.zeros(5000)])
    monkeypatch.setattr(boosting, "SUMMARY_PARTS", 2)
    edges = boosting.bin_edges(frame(spark, x, np.zeros(5000), parts=6), 4, 16)
    assert edges[0].tolist() == [0, 1, 2, 3, 4, 5] and len(edges[2]) == len(edges[3]) == 0
    assert len(edges[1]) == 15 and np.abs(edges[1] - np.arange(1, 16) * 5000 / 16).max() < 2 * 5000 / 16 / 8


def test_odd_tables(spark):
    p = Boosting(rounds=3, depth=2, min_rows=1)
    one = frame(spark, np.ones((5, 2)), [1, 1, 0, 1, 1])
    model = fit_boosting(one, 2, p)
    assert model.rounds == [] and score(model, one).select("prediction").distinct().collect()[0][0] == 1.0
    assert np.allclose(model.featureImportances.toArray(), 0)
    gaps = frame(spark, np.array([[np.nan], [np.nan], [1.0], [2.0]]), [5, 5, 1, 1])
    out = {r["label"]: r["prediction"] for r in score(fit_boosting(gaps, 0, Boosting(rounds=12, depth=2, rate=0.7, l2=0.0)), gaps).collect()}
    assert abs(out[5.0] - 5) < 0.01 and abs(out[1.0] - 1) < 0.01
    none = one.where("label > 5")
    assert score(fit_boosting(none, 3, p), none).count() == 0
    far = frame(spark, np.array([[1.0], [2.0]]), [0, 2])  # class 1 never seen
    assert fit_boosting(far, 3, p).outputs(np.array([[1.0]])).argmax() == 0


def test_names_and_saved_model(spark, data, tmp_path):
    assert list(requested_families(["xgboost", "lightgbm"], True)) == ["histogram_boosting", "leafwise_boosting"]
    x, y = data
    model = registry(False)["leafwise_boosting"].fit(frame(spark, x, x[:, 0]), Task(False), {"trees": 3, "max_depth": 3, "leaves": 4, "learning_rate": 0.5})
    run_store.save_model(spark, model, str(tmp_path / "m"))
    again = run_store.load_model(spark, str(tmp_path / "m"))
    assert np.allclose(model.margins(x), again.margins(x)) and model.featureImportances[0] > 0.9
