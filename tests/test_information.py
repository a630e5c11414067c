"""Nearest-neighbour mutual information against sums over all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import information
from tabsmith.operators.information import digamma, neighbour_information
from tabsmith.operators.select import best_by_information


def psi(n):
    return -0.5772156649015329 + sum(1.0 / i for i in range(1, int(n)))


def inside(x, r):
    return np.array([np.sum(x == a) if b == 0 else np.sum((x > a - b) & (x < a + b)) for a, b in zip(x, r)])


def of_classes(x, y, k):
    keep = np.array([np.sum(y == c) > 1 for c in y])
    x, y = x[keep], y[keep]
    used = np.array([min(k, np.sum(y == c) - 1) for c in y])
    r = np.array([np.sort(np.abs(np.delete(x, i)[np.delete(y, i) == y[i]] - x[i]))[used[i] - 1] for i in range(len(x))])
    mean = lambda v: np.mean([psi(a) for a in v])
    return max(0.0, psi(len(x)) + mean(used) - mean([np.sum(y == c) for c in y]) - mean(inside(x, r)))


def of_numbers(x, y, k):
    x, y = (v / float(f"{v.std():.9g}") for v in (x, y))
    r = np.array([np.sort(np.maximum(np.abs(np.delete(x, i) - x[i]), np.abs(np.delete(y, i) - y[i])))[k - 1] for i in range(len(x))])
    return max(0.0, psi(len(x)) + psi(k) - np.mean([psi(m) for m in inside(x, r)]) - np.mean([psi(m) for m in inside(y, r)]))


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    y = rng.choice(["a", "b", "c", "d"], 400, p=[0.7, 0.2, 0.09, 0.01])
    y[0] = "alone"
    near = rng.normal(np.char.equal(y, "b") * 2.0, 1.0)
    ties = rng.integers(0, 6, 400).astype(float)
    number = near * 2 + rng.normal(size=400) * 0.3
    rows = list(zip(near.tolist(), ties.tolist(), np.ones(400).tolist(), number.tolist(), y.tolist()))
    return spark.createDataFrame(rows, "near double, ties double, same double, number double, y string").repartition(3).persist()


@pytest.mark.parametrize("k, stretch", [(1, 100_000), (3, 100_000), (5, 20)])
def test_about_classes(table, monkeypatch, k, stretch):
    monkeypatch.setattr(information, "NEIGHBOUR_ROWS", stretch)
    pdf = table.toPandas()
    got = {r["feature"]: r["mi"] for r in neighbour_information(table, ["near", "ties", "same"], "y", True, k).collect()}
    for f in ("near", "ties", "same"):
        assert abs(got[f] - of_classes(pdf[f].to_numpy(), pdf["y"].to_numpy(), k)) < 1e-9
    assert got["near"] > got["same"]


def test_about_numbers(table):
    pdf = table.toPandas()
    got = {r["feature"]: r["mi"] for r in neighbour_information(table, ["near", "ties"], "number", False, 3).collect()}
    for f in ("near", "ties"):
        assert abs(got[f] - of_numbers(pdf[f].to_numpy(), pdf["number"].to_numpy(), 3)) < 1e-9
    assert got["near"] > 1 > got["ties"]


def test_buckets_of_prefix_sums(table, monkeypatch):
    pdf, real = table.toPandas(), information.running_totals
    monkeypatch.setattr(information, "running_totals", lambda *a: real(*a, bucket_rows=60))
    got = neighbour_information(table, ["near"], "y", True).first()["mi"]
    assert abs(got - of_classes(pdf["near"].to_numpy(), pdf["y"].to_numpy(), 3)) < 1e-9


def test_gaps_and_small_tables(spark, table):
    gaps = table.withColumn("near", F.when(F.xxhash64("number") % 4 != 0, F.col("near")))
    pdf = gaps.toPandas()
    filled = pdf["near"].fillna(pdf["near"].median()).to_numpy()
    got = neighbour_information(gaps, ["near"], "y", True).first()["mi"]
    assert abs(got - of_classes(filled, pdf["y"].to_numpy(), 3)) < 1e-9
    for rows in ([], [(1.0, 2.0, "a")], [(1.0, 2.0, "a"), (1.0, None, None)]):
        few = spark.createDataFrame(rows, "x double, z double, y string")
        assert [tuple(r) for r in neighbour_information(few, ["x"], "y", True).collect()] == [("x", 0.0)]
        assert [tuple(r) for r in neighbour_information(few, ["x"], "z", False).collect()] == [("x", 0.0)]


def test_digamma_and_selection(spark, table):
    got = spark.range(1, 60).select("id", digamma(F.col("id").cast("double")).alias("p")).collect()
    assert all(math.isclose(r["p"], psi(r["id"]), abs_tol=1e-10) for r in got)
    assert best_by_information(table, ["ties", "near", "same"], "number", 1, False, "neighbours") == ["near"]
