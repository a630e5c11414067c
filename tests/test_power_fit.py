"""Yeo-Johnson exponents: likelihoods as computed directly, no exponent twice, and the exponent of the best one."""

import math

import numpy as np
import pytest

from tabsmith.operators import scale


def direct(x, lam):
    with np.errstate(over="ignore", invalid="ignore"):
        up = np.log1p(np.abs(x)) if abs(lam) < 1e-12 else ((np.abs(x) + 1) ** lam - 1) / lam
        low = -np.log1p(np.abs(x)) if abs(lam - 2) < 1e-12 else -((np.abs(x) + 1) ** (2 - lam) - 1) / (2 - lam)
    v = np.where(x >= 0, up, low).var()
    return -len(x) / 2 * math.log(v) + (lam - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


def test_exponents(spark, monkeypatch):
    rng = np.random.default_rng(2)
    cols = {"up": rng.exponential(2.0, 900), "both": rng.normal(0.5, 2, 900) ** 3, "down": -rng.exponential(1.0, 900), "even": rng.normal(size=900)}
    rows = [(None, float("nan"), *map(float, r)) for r in zip(*cols.values())]
    rows += [(None, None, None, float("nan"), None, None)]
    df = spark.createDataFrame(rows, "nothing double, nan double, up double, both double, down double, even double").repartition(5)
    asked, plain = [], scale._likelihoods

    def spied(df, wanted):
        asked.append(wanted)
        got = plain(df, wanted)
        for (c, lam), fit in got.items():
            assert fit == pytest.approx(direct(cols[c], lam), rel=1e-9)
        return got
    monkeypatch.setattr(scale, "_likelihoods", spied)
    got = scale.fit_yeo_johnson(df, ["nothing", "nan", *cols])
    assert got["nothing"] == got["nan"] == 1.0
    for c, x in cols.items():
        assert 7 <= sum(len(w.get(c, ())) for w in asked) <= 27  # 35 before
        near = got[c] + np.linspace(-0.05, 0.05, 11)
        assert direct(x, got[c]) >= max(direct(x, lam) for lam in near) - 1e-3
    assert scale.fit_yeo_johnson(df.where("up < -1"), ["up"]) == {"up": 1.0}
