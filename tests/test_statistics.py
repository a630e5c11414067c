"""Edge cases of the statistics: ties, gaps, constants, tiny tables, bucketed paths."""

import math
import random
import statistics

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabsmith.functions.special import chi2_sf, kolmogorov_p
from tabsmith.operators import correlation, drift, metrics
from tabsmith.operators.order_stats import running_totals
from tabsmith.operators.profile import TableProfile, histogram, top_values
from tabsmith.operators.stats import summarize


def frame(spark, **cols):
    return spark.createDataFrame(pd.DataFrame(cols))


@pytest.mark.parametrize("seed", range(4))
def test_quantiles_are_exact(spark, seed):
    rng = np.random.default_rng(seed)
    x = [rng.normal(0, 1, 997), rng.choice([1.0, 2.0, 7.5], 997), rng.pareto(0.5, 997) * 1e9, np.r_[np.zeros(400), rng.normal(0, 1e-12, 597)]][seed]
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    s = summarize(frame(spark, x=x), ["x"], probs)["x"]
    for p in probs:
        assert s.quantiles[p] == pytest.approx(float(np.quantile(x, p)), rel=1e-12, abs=1e-300)


def test_moments_match_pandas(spark):
    x = pd.Series([1.0, 2.0, 2.0, 9.0, 4.0])
    s = summarize(frame(spark, x=x), ["x"])["x"]
    assert s.skew == pytest.approx(1.6607968, abs=1e-6) and s.kurtosis == pytest.approx(2.7118484, abs=1e-6)
    assert s.std == pytest.approx(3.2093614, abs=1e-6) and s.quantiles[0.25] == 2.0


def test_constant_and_empty_columns(spark):
    df = spark.createDataFrame([(5.0, None, "a"), (5.0, None, "a"), (5.0, None, None)], "c double, n double, t string")
    p = TableProfile(df, "t")
    s = p.stats["c"]
    assert s.skew is None and s.kurtosis is None and s.std == 0.0
    assert [r["column"] for r in p.numeric_stats().collect()] == ["c"]
    assert p.pearson().first()["r"] is None
    bins = histogram(df, ["c"], 20, min_rows=1).collect()
    assert sum(b["count"] for b in bins) == 3 and min(b["lower"] for b in bins) == 4.5
    p.run()


def test_nan_counts_as_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (None,)], "x double")
    p = TableProfile(df, "x")
    assert p.missing_counts["x"] == 2 and p.stats["x"].n == 1


def test_fingerprint_tells_nulls_apart(spark):
    df = spark.createDataFrame([(None, 5), (5, None), (5, None)], "a int, b int")
    assert TableProfile(df, "a").distinct_rows == 2


def test_histogram_counts_add_up(spark):
    x = np.random.default_rng(1).normal(size=500)
    got = histogram(frame(spark, x=x), ["x"]).orderBy("bin").collect()
    assert [r["count"] for r in got] == np.histogram(x, bins=20)[0].tolist()


def test_top_values_break_ties_by_value(spark):
    got = top_values(frame(spark, s=["b", "a", "c", "c"]), ["s"], 2).orderBy("rank").collect()
    assert [(r["value"], r["count"]) for r in got] == [("c", 2), ("a", 1)]


@pytest.mark.parametrize("bucket_rows", [10 ** 6, 40])
def test_running_totals_in_buckets(spark, bucket_rows):
    rng = random.Random(3)
    values = {rng.randint(0, 10 ** 6): rng.randint(1, 9) for _ in range(500)}
    df = spark.createDataFrame([("g", float(v), n) for v, n in values.items()], "g string, v double, n long")
    got = {r["v"]: r["cum_n"] for r in running_totals(df, ["g"], "v", ["n"], 500, bucket_rows).collect()}
    total = 0
    for v in sorted(values):
        total += values[v]
        assert got[float(v)] == total


def test_spearman_with_ties_gaps_and_buckets(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": range(300), "a": rng.integers(0, 5, 300).astype(float), "b": rng.normal(size=300)})
    pdf["c"] = pdf["a"] + pdf["b"]
    pdf.loc[pdf["id"] % 7 == 0, "c"] = np.nan
    df = spark.createDataFrame(pdf)
    got = {(r["f1"], r["f2"]): r["r"] for r in correlation.spearman_pairs(df, ["a", "b", "c"], ["id"], bucket_rows=50).collect()}
    want = pdf[["a", "b", "c"]].rank().corr()
    assert got[("a", "b")] == pytest.approx(want.loc["a", "b"], abs=1e-12)
    both = pdf.dropna()[["a", "c"]].rank().corr().loc["a", "c"]
    assert got[("a", "c")] == pytest.approx(both, abs=1e-12)


def test_auc_equals_pair_counting(spark):
    rng = np.random.default_rng(2)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 20, 200) / 20
    pairs = [(a > b) + 0.5 * (a == b) for a, ya in zip(s, y) if ya for b, yb in zip(s, y) if not yb]
    got = metrics.roc_auc(frame(spark, y=y, s=s), "y", "s", bucket_rows=5).first()[0]
    assert got == pytest.approx(float(np.mean(pairs)), abs=1e-12)


def test_drift_of_identical_and_shifted_tables(spark):
    rng = np.random.default_rng(0)
    a, b = frame(spark, x=rng.normal(0, 1, 200)), frame(spark, x=rng.normal(10, 1, 100))
    same = drift.drift_report(a, a).first()
    assert same["ks"] == 0.0 and same["psi"] == 0.0 and not same["drifted"]
    far = drift.drift_report(a, b).first()
    assert far["ks"] > 0.9 and far["ks_p"] < 1e-6 and far["drifted"]


def test_new_category_drifts_without_a_statistic(spark):
    r = drift.drift_report(frame(spark, s=["a"] * 20), frame(spark, s=["a"] * 19 + ["b"])).first()
    assert r["chi2"] is None and r["chi2_p"] == 0.0 and r["drifted"]


def test_tail_probabilities():
    assert chi2_sf(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    assert chi2_sf(9.487729036781154, 4) == pytest.approx(0.05, abs=1e-9)
    assert kolmogorov_p(0.0, 10, 10) == 1.0
    assert kolmogorov_p(1.3581015157406195 / math.sqrt(50), 100, 100) == pytest.approx(0.05, abs=1e-6)


def test_jarque_bera_accepts_a_normal_sample(spark):
    q = [statistics.NormalDist().inv_cdf((i + 0.5) / 1000) for i in range(1000)]
    row = TableProfile(frame(spark, x=q, y=[v ** 3 for v in q]), "y").normality().orderBy("column").collect()
    assert row[0]["is_normal"] and not row[1]["is_normal"]
