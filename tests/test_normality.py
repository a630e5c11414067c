"""Shapiro-Wilk against published tables, Shapiro-Francia against a dense computation."""

from statistics import NormalDist

import numpy as np
import pytest

from tabsmith.operators.normality import shapiro_francia, shapiro_table, shapiro_weights, shapiro_wilk


def test_published_example():
    """Weights of eleven men, the example of the test's first paper: W is 0.79, significant at 1 %."""
    w, p = shapiro_wilk([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236])
    assert abs(w - 0.79) < 0.002 and 0.005 < p < 0.01


@pytest.mark.parametrize("n, weights", [(10, (0.5739, 0.3291, 0.2141, 0.1224, 0.0399)), (20, (0.4734, 0.3211, 0.2565, 0.2085, 0.1686))])
def test_published_weights(n, weights):
    a = shapiro_weights(n)
    assert np.allclose(a[::-1][:len(weights)], weights, atol=2e-3) and abs(a @ a - 1) < 1e-9 and np.allclose(a, -a[::-1])


@pytest.mark.parametrize("n, five, one", [(7, 0.803, 0.730), (10, 0.842, 0.781), (20, 0.905, 0.868)])
def test_published_points(n, five, one):
    """Values made so that W is the tabulated 5 % and 1 % point."""
    a = shapiro_weights(n)
    rng = np.random.default_rng(n)
    for point, level in ((five, 0.05), (one, 0.01)):
        found = []
        for _ in range(400):
            x = np.sort(rng.exponential(size=n) ** rng.uniform(0.3, 2))
            found.append(x)
        x = min(found, key=lambda v: abs((a @ v) ** 2 / ((v - v.mean()) ** 2).sum() - point))
        w, p = shapiro_wilk(x)
        assert abs(w - point) < 0.01 and abs(p - level) < 0.02


def test_level_and_limits():
    rng = np.random.default_rng(0)
    p = [shapiro_wilk(rng.normal(size=30))[1] for _ in range(600)]
    assert 0.02 < np.mean(np.array(p) < 0.05) < 0.08
    assert shapiro_wilk([2.0] * 9) == (1.0, 1.0) and shapiro_wilk([1, 2, 3])[0] == pytest.approx(1.0)
    assert shapiro_wilk(rng.exponential(size=500))[1] < 1e-10
    with pytest.raises(ValueError):
        shapiro_wilk([1, 2])


def test_tables(spark):
    rng = np.random.default_rng(1)
    x, ties = rng.normal(size=700), rng.integers(0, 9, 700).astype(float)
    rows = [(float(a), float(b) if i % 5 else None, 1.0, float(a) if i < 5 else None) for i, (a, b) in enumerate(zip(x, ties))]
    df = spark.createDataFrame(rows, "x double, ties double, same double, few double").repartition(3)
    got = {r["column"]: r for r in shapiro_table(df, df.columns).collect()}
    assert set(got) == {"x", "ties", "same"} and got["x"]["n"] == 500 and got["x"]["normal"] and not got["ties"]["normal"]
    for buckets in (None, 40):
        found = {r["column"]: r for r in shapiro_francia(df, df.columns, buckets).collect()}
        assert set(found) == {"x", "ties", "few"}
        for c, v in (("x", x), ("ties", ties[np.arange(700) % 5 > 0])):
            v = np.sort(v)
            m = np.array([NormalDist().inv_cdf((i - 0.375) / (len(v) + 0.25)) for i in range(1, len(v) + 1)])
            assert abs(found[c]["w"] - np.corrcoef(v, m)[0, 1] ** 2) < 1e-6 and found[c]["n"] == len(v)
    assert shapiro_francia(df.where("x > 99"), ["x"]).count() == 0
