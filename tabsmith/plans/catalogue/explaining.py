"""Explanations: importance, Shapley values, surrogates, what-if grids."""

from __future__ import annotations

from itertools import combinations
from math import factorial

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsmith.operators import explain, tree_shapley
from tabsmith.operators.models import Task, registry
from tabsmith.operators.stats import round_doubles, summarize
from tabsmith.operators.trees import Tree
from tabsmith.plans.catalogue import query, table
from tabsmith.plans.catalogue.modelling import trained

COEFS = {"l_quantity": 2.0, "l_discount": -30.0, "l_tax": 50.0}
SHAP_SQL = " union all ".join(
    f"select '{c}' as feature, round(avg(abs({w} * ({c} - m))), 6) as mean_abs_shap from lineitem, (select avg({c}) as m from lineitem)" for c, w in COEFS.items())


class FixedLinear:
    """A linear model with given coefficients, so that every explanation has a closed form."""

    def transform(self, df):
        x = vector_to_array("features")
        y = F.lit(0.0)
        for i, w in enumerate(COEFS.values()):
            y = y + F.get(x, F.lit(i)) * w
        return df.withColumn("prediction", y)


def _keyed(df):
    """The rows with a key that does not change when a task runs again; no two rows of the table are equal."""
    return df.withColumn("row", F.xxhash64(*df.columns))


def _vectors(spark, sf_dir):
    df = _keyed(table(spark, sf_dir, "lineitem"))
    return VectorAssembler(inputCols=list(COEFS), outputCol="features").transform(df).select("row", "features", "l_extendedprice")


@query("shap_linear", SHAP_SQL)
def shap_linear(spark, sf_dir):
    return round_doubles(explain.linear_shapley(table(spark, sf_dir, "lineitem"), COEFS), 6)


@query("shap_sampled", SHAP_SQL)
def shap_sampled(spark, sf_dir):
    values = explain.shapley_values(FixedLinear(), _vectors(spark, sf_dir), list(COEFS), ["row"], permutations=6)
    return round_doubles(explain.mean_abs_shapley(values), 6)


# A tree with given splits: node -> (feature, threshold, left, right) or the value of a leaf.
GIVEN_TREE = {0: ("l_quantity", 24.0, 1, 2), 1: ("l_discount", 0.04, 3, 4), 2: ("l_tax", 0.03, 5, 6), 3: 1.0, 4: 2.5, 5: -1.0,
              6: ("l_quantity", 40.0, 7, 8), 7: 0.5, 8: 4.0}


def _coalition_sql(inside: tuple, node: int = 0) -> str:
    """What the given tree says when only the features ``inside`` are known: others weigh both sides by their rows."""
    if not isinstance(GIVEN_TREE[node], tuple):
        return str(GIVEN_TREE[node])
    column, at, left, right = GIVEN_TREE[node]
    sides = _coalition_sql(inside, left), _coalition_sql(inside, right)
    if column in inside:
        return f"(case when {column} <= {at} then {sides[0]} else {sides[1]} end)"
    return f"(s{node} * {sides[0]} + (1 - s{node}) * {sides[1]})"


def _given_shares_sql(node: int = 0, way: str = "true") -> list[str]:
    if not isinstance(GIVEN_TREE[node], tuple):
        return []
    column, at, left, right = GIVEN_TREE[node]
    here = f"count(*) filter ({way} and {column} <= {at}) / count(*) filter ({way}) as s{node}"
    return [here, *_given_shares_sql(left, f"{way} and {column} <= {at}"), *_given_shares_sql(right, f"{way} and {column} > {at}")]


def _enumerated_sql(feature: str) -> str:
    others = [c for c in COEFS if c != feature]
    terms = [f"{factorial(k) * factorial(2 - k)} / 6.0 * ({_coalition_sql((*s, feature))} - {_coalition_sql(s)})" for k in range(3) for s in combinations(others, k)]
    return " + ".join(terms)


TREE_SQL = f"""with shares as (select {', '.join(_given_shares_sql())} from lineitem),
  v as ({' union all '.join(f"select '{c}' as feature, {_enumerated_sql(c)} as value from lineitem, shares" for c in COEFS)})
  select feature, round(avg(abs(value)), 6) as mean_abs_shap, round(avg(value), 6) as mean_shap, round(min(value), 6) as low, round(max(value), 6) as high from v group by feature"""


def given_tree(df) -> Tree:
    """The given splits with the rows of ``df`` counted in every node."""
    way = {0: F.lit(True)}
    for node, split in sorted(GIVEN_TREE.items()):
        if isinstance(split, tuple):
            way[split[2]], way[split[3]] = way[node] & (F.col(split[0]) <= split[1]), way[node] & (F.col(split[0]) > split[1])
    cover = df.agg(*(F.count_if(way[n]).alias(f"n{n}") for n in sorted(way))).first()
    inner = [GIVEN_TREE[n] if isinstance(GIVEN_TREE[n], tuple) else (None, 0.0, -1, -1) for n in sorted(GIVEN_TREE)]
    names = list(COEFS)
    return Tree(np.array([names.index(f) if f else -1 for f, *_ in inner]), np.array([t for _, t, *_ in inner]), np.array([x[2] for x in inner]),
                np.array([x[3] for x in inner]), np.array([[0.0 if isinstance(GIVEN_TREE[n], tuple) else GIVEN_TREE[n]] for n in sorted(GIVEN_TREE)]),
                np.array(list(cover), float))


@query("tree_shapley", TREE_SQL)
def exact_tree_shapley(spark, sf_dir):
    """Exact values of a tree with given splits for every row; the SQL adds up all coalitions."""
    model = tree_shapley.Ensemble([given_tree(table(spark, sf_dir, "lineitem"))], [0.0])
    values = tree_shapley.tree_shapley(model, _vectors(spark, sf_dir), list(COEFS), ["row"])
    return round_doubles(values.groupBy("feature").agg(
        F.avg(F.abs("value")).alias("mean_abs_shap"), F.avg("value").alias("mean_shap"), F.min("value").alias("low"), F.max("value").alias("high")), 6)


@query("local_surrogate")
def local_surrogate(spark, sf_dir):
    df = _vectors(spark, sf_dir)
    out = explain.local_surrogate(FixedLinear(), df, list(COEFS), ["row"], [1.0, 0.1, 0.1], samples=40)
    return out.groupBy("feature").agg(F.count("*").alias("n"), F.avg("weight").alias("mean_weight"))


@query("forest_importance")
def forest_importance(spark, sf_dir):
    df = _vectors(spark, sf_dir).withColumnRenamed("l_extendedprice", "label")
    model = registry(False)["random_forest"].fit(df, Task(False), {"trees": 5, "max_depth": 5})
    return explain.feature_importance(spark, model, list(COEFS))


@query("linear_importance")
def linear_importance(spark, sf_dir):
    return trained(spark, sf_dir).importance()


FEATURES = ["l_quantity", "l_discount", "l_tax"]
LINEAR = " + ".join(f"{w} * {c}" for c, w in COEFS.items())


def _linear_scorer(df):
    return df.withColumn("prediction", F.expr(LINEAR))


@query("sensitivity_grid", " union all ".join(f"""select '{c}' as feature, round(abs({w}) * 4 * s, 4) as mean_impact, round(abs({w}) * 4 * s, 4) as max_impact,
  {1.0 if w > 0 else 0.0}::double as positive_share from (select stddev_samp({c}) as s from lineitem)""" for c, w in COEFS.items()))
def sensitivity_grid(spark, sf_dir):
    df = _keyed(table(spark, sf_dir, "lineitem")).select("row", *FEATURES)
    stats = summarize(df, FEATURES, (0.5,), moments=2)
    rows = explain.sensitivity(df, _linear_scorer, FEATURES, ["row"], stats)
    return round_doubles(explain.sensitivity_summary(rows))


def _class_scorer(df):
    return df.withColumn("prediction", (F.expr(LINEAR) > 50).cast("double"))


_MOVES = ", ".join(f"({i}, {j}, '{c}', {m})" for i, c in enumerate(FEATURES) for j, m in enumerate((1.0, -1.0, 2.0, -2.0, 0.5, -0.5)))


@query("counterfactual", f"""with st as ({' union all '.join(f"select '{c}' as feature, min({c}) as lo, max({c}) as hi, median({c}) as med, stddev_samp({c}) as sd from lineitem" for c in FEATURES)}),
  mv as (select fo, mo, feature, greatest(lo, least(hi, med + m * sd)) as v from (values {_MOVES}) t(fo, mo, feature, m) join st using (feature)),
  b as (select *, row_number() over () as row, {LINEAR} > 50 as base from lineitem),
  t as (select row, fo, mo, feature, v, base, {' + '.join(f"{w} * (case when feature = '{c}' then v else {c} end)" for c, w in COEFS.items())} > 50 as p,
    case feature {' '.join(f"when '{c}' then {c}" for c in FEATURES)} end as o from b, mv),
  f as (select * from t where p <> base qualify row_number() over (partition by row, fo order by mo) = 1)
  select feature, count(*) as n, round(avg(v), 4) as changed_to, round(sum(v - o), 2) as delta, cast(sum(p::int) as double) as positives from f group by 1""")
def counterfactual(spark, sf_dir):
    df = _keyed(table(spark, sf_dir, "lineitem")).select("row", *FEATURES)
    stats = summarize(df, FEATURES, (0.5,), moments=2)
    rows = explain.counterfactuals(df, _class_scorer, FEATURES, ["row"], stats)
    return rows.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.avg("changed_to"), 4).alias("changed_to"),
                                       F.round(F.sum("delta"), 2).alias("delta"), F.sum("new_prediction").alias("positives"))


@query("model_sensitivity")
def model_sensitivity(spark, sf_dir):
    """What-if rows scored by a trained model, preprocessing included."""
    auto = trained(spark, sf_dir)
    return explain.sensitivity_summary(auto.sensitivity(table(spark, sf_dir, "customer"), ["c_custkey"]))
