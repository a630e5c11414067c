"""Stored sketches: merged parts against the whole, stated errors, tables that grow."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import sketches as sk


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(7)
    rows = [(i, float(x) if i % 7 else None, float("nan") if i % 11 == 0 else float(i % 50), f"w{rng.integers(0, 3000)}" if i % 3 else None, i % 5) for i, x in enumerate(rng.lognormal(size=20_000))]
    return spark.createDataFrame(rows, "id long, x double, few double, word string, day int").repartition(4).persist()


def test_parts_equal_the_whole_within_the_error(spark, table, tmp_path):
    path = str(tmp_path / "sketches")
    for day in range(5):
        sk.append_sketches(table.where(F.col("day") == day), F.col("day"), path)
    stored = sk.stored_sketches(spark, path)
    probs = [0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.99]
    merged = {r["column"]: r for r in sk.profile_of(stored, probs).collect()}
    whole = {r["column"]: r for r in sk.profile_of(sk.column_sketches(table, F.lit("all")), probs).collect()}
    pdf = table.toPandas()
    for c in ("x", "few", "id"):
        v = np.sort(pdf[c].dropna().to_numpy(float))
        m, w = merged[c], whole[c]
        assert m["parts"] == 5 and w["parts"] == 1 and m["rows"] == w["rows"] == 20_000 and m["missing"] == w["missing"] == 20_000 - len(v)
        assert np.allclose([m["mean"], m["std"], m["low"], m["high"]], [v.mean(), v.std(ddof=1), v[0], v[-1]])
        for p, q in zip(probs, m["quantiles"]):
            low, high = np.searchsorted(v, q, "left") / len(v), np.searchsorted(v, q, "right") / len(v)
            assert low - 2 * sk.rank_error() <= p <= high + 2 * sk.rank_error()
        assert abs(m["distinct"] - len(np.unique(v))) <= 0.04 * len(np.unique(v)) + 1
        # A merged HLL sketch has the registers of the whole one.
        assert abs(m["distinct"] - w["distinct"]) <= 0.03 * w["distinct"] + 1
    words = pdf["word"].dropna()
    assert abs(merged["word"]["distinct"] - words.nunique()) <= 0.04 * words.nunique() and merged["word"]["quantiles"] is None and merged["word"]["missing"] == 20_000 - len(words)
    x = pdf["x"].dropna().to_numpy()
    assert abs(sk.rank_of(stored, "x", 1.0) - (x <= 1.0).mean()) <= 2 * sk.rank_error()


def test_a_part_counts_once(spark, table, tmp_path):
    path = str(tmp_path / "s")
    assert sk.stored_sketches(spark, path) is None
    sk.append_sketches(table, F.col("day"), path, ["x", "word"])
    with pytest.raises(ValueError, match="one of these parts"):
        sk.append_sketches(table.where("day = 2"), F.col("day"), path)
    assert sk.stored_sketches(spark, path).count() == 10


def test_odd_tables(spark):
    none = spark.createDataFrame([], "x double, word string")
    assert sk.profile_of(sk.column_sketches(none, F.lit("a"))).count() == 0
    gaps = spark.createDataFrame([(None, None), (float("nan"), None)], "x double, word string")
    got = {r["column"]: r for r in sk.profile_of(sk.column_sketches(gaps, F.lit(None))).collect()}
    assert got["x"]["missing"] == 2 and got["x"]["mean"] is None and got["x"]["quantiles"] is None and got["word"]["distinct"] == 0
    one = sk.profile_of(sk.column_sketches(spark.createDataFrame([(3.0,)], "x double"), F.lit("p"))).first()
    assert one["quantiles"] == [3.0, 3.0, 3.0] and one["std"] is None and one["distinct"] == 1
    assert sk.column_sketches(spark.createDataFrame([(True,)], "flag boolean"), F.lit("p")).count() == 0
