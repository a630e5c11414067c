"""Chained imputation with Bayesian ridge regression against a dense computation."""

import numpy as np
import pytest

from tabsmith.operators.impute import ChainedFill, bayesian_ridge, imputer


def dense_bayes(x, y, steps=300, tol=1e-3):
    """The evidence updates on the rows themselves."""
    mx, my = x.mean(axis=0), y.mean()
    a, b = x - mx, y - my
    noise, weight, coef = 1.0 / (b.var() + np.finfo(float).eps), 1.0, np.zeros(x.shape[1])
    solve = lambda: np.linalg.solve(noise * a.T @ a + weight * np.eye(x.shape[1]), noise * a.T @ b)
    for step in range(steps):
        old, coef = coef, solve()
        spread = np.linalg.inv(noise * a.T @ a + weight * np.eye(x.shape[1]))
        known = x.shape[1] - weight * np.trace(spread)
        weight = (known + 2e-6) / (coef @ coef + 2e-6)
        noise = (len(x) - known + 2e-6) / (((b - a @ coef) ** 2).sum() + 2e-6)
        if step and np.abs(old - coef).sum() < tol:
            break
    coef = solve()
    return coef, my - mx @ coef


def test_updates_equal_the_dense_ones():
    rng = np.random.default_rng(0)
    for n, scale in ((12, 5.0), (400, 0.1)):
        x = rng.normal(size=(n, 4)) * [1, 10, 0.1, 3]
        y = x @ [1.0, 0.1, 0.0, -2.0] + rng.normal(size=n) * scale
        a, b = x - x.mean(axis=0), y - y.mean()
        got = bayesian_ridge(a.T @ a, a.T @ b, float(b @ b), n)
        assert np.allclose(got, dense_bayes(x, y)[0], rtol=1e-6, atol=1e-8)


def test_noise_shrinks_the_weights():
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=(20, 3)), rng.normal(size=20)
    a, b = x - x.mean(axis=0), y - y.mean()
    got, plain = bayesian_ridge(a.T @ a, a.T @ b, float(b @ b), 20), np.linalg.lstsq(a, b, rcond=None)[0]
    assert np.linalg.norm(got) < 0.7 * np.linalg.norm(plain)


@pytest.mark.parametrize("rounds", [1, 3])
def test_rounds_equal_the_dense_ones(spark, rounds):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    x[:, 1] += 2 * x[:, 0] + 5
    x[:, 2] = 100 * (x[:, 0] - x[:, 1]) + rng.normal(size=300) * 30
    gaps = np.zeros(x.shape, bool)
    gaps[rng.random(300) < 0.1, 1] = True
    gaps[rng.random(300) < 0.3, 2] = True
    rows = [(i, *(None if g else float(v) for v, g in zip(r, m))) for i, (r, m) in enumerate(zip(x, gaps))]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double").repartition(3)
    out = ChainedFill.of(["a", "b", "c"], rounds=rounds, tol=0.0, estimator="bayesian").fit(df).transform(df)
    got = np.array([(r["a"], r["b"], r["c"]) for r in out.orderBy("id").collect()])
    want = np.where(gaps, np.array([x[~gaps[:, j], j].mean() for j in range(3)]), x)
    for _ in range(rounds):
        for j in (1, 2):  # fewest gaps first
            others = [i for i in range(3) if i != j]
            coef, start = dense_bayes(want[~gaps[:, j]][:, others], want[~gaps[:, j], j])
            want[gaps[:, j], j] = want[gaps[:, j]][:, others] @ coef + start
    assert np.allclose(got, want, rtol=1e-5, atol=1e-5)


def test_unknown_estimator(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0)], "a double, b double")
    with pytest.raises(ValueError, match="unknown estimator"):
        ChainedFill.of(["a", "b"], estimator="magic").fit(df)
    assert imputer("iterative", ["a", "b"]).fit(df).transform(df).where("a is null").count() == 0
