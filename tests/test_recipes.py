"""Recipes share what derives from the same columns, and a scan does its work once."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import impute, information, roles, scale, select
from tabsmith.operators.models import Task
from tabsmith.operators.roles import ColumnRoles
from tabsmith.plans import recipe

GRID = (("median", "robust", "onehot"), ("mean", "minmax", "ordinal"), ("median", "quantile", "target"))
ROLES = ColumnRoles(numeric=["a", "b"], low_card=["c"], date=["d"])


def rows(spark, gaps: bool):
    df = spark.range(400).select(
        (F.col("id") * 37 % 101).cast("double").alias("a"), F.exp((F.col("id") * 53 % 97) / 20.0).alias("b"),
        F.concat(F.lit("k"), (F.col("id") % 4).cast("string")).alias("c"),
        F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, cast(id % 300 as int))").alias("d"),
        ((F.col("id") * 7 + F.col("id") % 4) % 3).cast("double").alias("label"))
    return df.withColumn("a", F.when(F.col("a") % 7 != 0, F.col("a"))) if gaps else df


def fitted(found: recipe.FittedRecipe) -> list:
    return [(type(s).__name__, s.getOrDefault("spec")) for s in found.model.stages]


@pytest.mark.parametrize("gaps", [False, True])
def test_shared_fits_are_those_of_each_recipe_alone(spark, gaps):
    df, cache = rows(spark, gaps).coalesce(1).cache(), recipe.StageCache()
    for parts in GRID:
        shared = recipe.fit_recipe(df, recipe.Recipe(*parts), ROLES, True, 3, complete=not gaps, cache=cache)
        assert fitted(shared) == fitted(recipe.fit_recipe(df, recipe.Recipe(*parts), ROLES, True, 3))


def test_columns_behind_no_scaler_are_measured_once(spark, monkeypatch):
    df, measured, modes = rows(spark, True).cache(), [], []
    summarize, most = select.summarize, impute.modes
    for module in (select, information):
        monkeypatch.setattr(module, "summarize", lambda df, cols, *a, m=module.__name__, **k: measured.extend((m, c) for c in cols) or summarize(df, cols, *a, **k))
    monkeypatch.setattr(impute, "modes", lambda df, cols: modes.append(tuple(cols)) or most(df, cols))
    cache = recipe.StageCache()
    for parts in GRID:
        recipe.fit_recipe(df, recipe.Recipe(*parts), ROLES, True, 3, cache=cache)
    assert measured.count(("tabsmith.operators.select", "d_month")) == 1 and measured.count(("tabsmith.operators.information", "d_month")) == 1
    assert measured.count(("tabsmith.operators.select", "a")) == len(GRID)  # every scaler gives other numbers
    assert modes == [("c",)]


def test_a_failed_measure_is_not_shared():
    cache = recipe.StageCache()

    def broken(cols):
        raise ValueError(cols)
    with pytest.raises(ValueError):
        cache.measure({"x": ("m", 1), "y": ("m", 2)}, broken)
    assert cache.measure({"x": ("m", 1)}, lambda cols: dict.fromkeys(cols, 5.0)) == {"x": 5.0}


def test_a_column_written_over_by_an_encoder_is_another_column(spark):
    df = spark.createDataFrame([("p", 1.0, 0.0), ("q", 2.0, 1.0), ("q", 9.0, 2.0), ("p", 4.0, 2.0)] * 20, "c string, c_c0 double, label double").coalesce(1)
    mixed, cache = ColumnRoles(numeric=["c_c0"], low_card=["c"]), recipe.StageCache()
    for parts in (("median", "minmax", "ordinal"), ("median", "minmax", "target")):
        shared = recipe.fit_recipe(df, recipe.Recipe(*parts), mixed, True, 3, complete=True, cache=cache)
        assert fitted(shared) == fitted(recipe.fit_recipe(df, recipe.Recipe(*parts), mixed, True, 3))


def test_normal_scores_take_each_step_once(spark):
    p = [0.0, 1e-6, 0.001, 0.02, 0.02425, 0.3, 0.5, 0.8, 0.97575, 0.99, 0.999999, 1.0, None]
    df = spark.createDataFrame([(v,) for v in p], "p double")
    both = scale.with_normal_quantiles(df, {"z": F.col("p")}).where("p is not null").withColumn("w", scale.normal_quantile(F.col("p")))
    assert all(r["z"] == r["w"] for r in both.collect())
    model = scale.QuantileScale.of(["x"], levels=50).fit(spark.range(200).select((F.col("id") * 1.5).alias("x")))
    plan = model.transform(spark.range(9).select(F.col("id").cast("double").alias("x")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("ln(") <= 2 and plan.lower().count("bucketizer") <= 1


def test_quantile_scale_of_ties_gaps_and_constants(spark):
    values = [float(v) for v in [1, 1, 1, 2, 3, 3, 8, 9]]
    df = spark.createDataFrame([(v, 4.0) for v in values], "x double, k double")
    model = scale.QuantileScale.of(["x", "k"]).fit(df)
    new = spark.createDataFrame([(v, v) for v in [None, 0.0, 1.0, 2.0, 2.5, 3.0, 8.5, 9.0, 99.0]], "x double, k double")
    got = [r["x"] for r in model.transform(new).collect()]
    u = [0.0, 0.0, 3 / 7, (3 + 0.5) / 7, 4.5 / 7, 6.5 / 7, 1.0, 1.0]  # places among the eight knots
    want = [r[0] for r in spark.createDataFrame([(v,) for v in u], "u double").select(scale.normal_quantile(F.col("u"))).collect()]
    assert got[0] is None and got[1:] == pytest.approx(want, abs=1e-12)


def test_information_reads_the_table_once(spark):
    df = spark.range(500).select((F.col("id") % 50).cast("double").alias("x"), (F.col("id") % 50 >= 25).cast("int").alias("y"))
    found = information.mutual_information(df, ["x"], "y", True)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    assert found.first()["mi"] == pytest.approx(np.log(2))


def test_date_texts_count_by_rows(spark):
    many = [("2024-05-06", f"x{i}") for i in range(45)] + [(f"no date {i}", "2024-01-02") for i in range(5)]
    found = roles.split_columns(spark.createDataFrame(many, "often string, seldom string"), None)
    assert found.date == ["often"] and "seldom" in found.low_card
