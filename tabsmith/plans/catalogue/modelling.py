"""Metrics, model families, tuning, ensembles and search."""

from __future__ import annotations

from pyspark.ml.classification import NaiveBayes
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tabsmith.functions.session import cut_lineage
from tabsmith.operators import boosting, knn, metrics, near
from tabsmith.operators.models import Task, registry, score
from tabsmith.operators.profile import TableProfile
from tabsmith.operators.stats import report, round_doubles
from tabsmith.plans import search
from tabsmith.plans.autotable import AutoTable
from tabsmith.plans.catalogue import query, table
from tabsmith.plans.recipe import scores_table

# Small ensembles keep the checks quick; sizes are parameters, not limits.
LIGHT = {"random_forest": {"trees": 5, "max_depth": 4}, "gradient_boosting": {"trees": 3, "max_depth": 2},
         "adaboost": {"rounds": 4}, "logistic_regression": {"max_iter": 20}, "mlp": {"hidden": [8], "max_iter": 20}}
ONE = (("median", "robust", "onehot"),)

SCORED = "(select doc_id, quality as y, toxic, (doc_id * 7 + quality * 3) % 5 < 3 as p, ((doc_id * 37) % 101 + quality * 20) / 100.0 as s from labels)"


def _scored(spark, sf_dir):
    return table(spark, sf_dir, "labels").selectExpr(
        "doc_id", "quality as y", "toxic", "cast((doc_id * 7 + quality * 3) % 5 < 3 as int) as p",
        "((doc_id * 37) % 101 + quality * 20) / 100.0D as s")


@query("clf_metrics", f"""with k as (select c, sum(a) as a, sum(b) as b, sum(t) as t from (select y as c, 1 as a, 0 as b, (y = p::int)::int as t from {SCORED}
    union all select p::int, 0, 1, 0 from {SCORED}) group by 1)
  select round(sum(t) / sum(a), 6) as accuracy, round(sum(2.0 * t / (a + b) * a) / sum(a), 6) as f1_weighted, round(avg(2.0 * t / (a + b)), 6) as f1_macro from k""")
def clf_metrics(spark, sf_dir):
    return round_doubles(metrics.classification_metrics(_scored(spark, sf_dir), "y", "p"), 6)


def _auc_sql(tab, y, s):
    return f"""select (sum(r) filter (y = 1) - count(*) filter (y = 1) * (count(*) filter (y = 1) + 1) / 2.0) / (count(*) filter (y = 1) * count(*) filter (y <> 1)) as auc,
      count(*) filter (y = 1) as n from (select {y} as y, rank() over (order by {s}) + (count(*) over (partition by {s}) - 1) / 2.0 as r from {tab})"""


@query("roc_auc", f"select round(auc, 6) as roc_auc from ({_auc_sql(SCORED, 'y', 's')})")
def roc_auc(spark, sf_dir):
    return round_doubles(metrics.roc_auc(_scored(spark, sf_dir), "y", "s"), 6)


@query("roc_auc_bucketed", f"select round(auc, 6) as roc_auc from ({_auc_sql('lineitem', '(l_returnflag = $$R$$)::int', 'l_extendedprice')})")
def roc_auc_bucketed(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), "l_extendedprice")
    return round_doubles(metrics.roc_auc(df, "y", "l_extendedprice", bucket_rows=4000), 6)


CLASS_SCORES = {"A": "l_quantity", "N": "l_discount", "R": "l_tax"}


@query("roc_auc_ovr", f"""select round(sum(auc * n) / sum(n), 6) as roc_auc from ({' union all '.join(
    _auc_sql('lineitem', f"(l_returnflag = '{c}')::int", s) for c, s in CLASS_SCORES.items())})""")
def roc_auc_ovr(spark, sf_dir):
    return round_doubles(metrics.roc_auc_ovr(table(spark, sf_dir, "lineitem"), "l_returnflag", CLASS_SCORES), 6)


@query("reg_metrics", """select round(sqrt(avg(e * e)), 4) as rmse, round(avg(abs(e)), 4) as mae, round(1 - avg(e * e) / var_pop(y), 6) as r2,
  round(100 * avg(abs(e) / (abs(y) + 1e-8)), 4) as mape from (select l_extendedprice as y, l_extendedprice - l_quantity * 1500 as e from lineitem)""")
def reg_metrics(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select("l_extendedprice", (F.col("l_quantity") * 1500).alias("p"))
    return round_doubles(metrics.regression_metrics(df, "l_extendedprice", "p"), 4, r2=6)


@query("error_table", f"""select y as label, count(*) as n, cast(sum((y <> p::int)::int) as bigint) as errors, round(avg((y <> p::int)::int), 6) as error_rate from {SCORED} group by 1""")
def error_table(spark, sf_dir):
    return round_doubles(metrics.error_table(_scored(spark, sf_dir), "y", "p"), 6)


NEAR_SQL = """near as (select q.vec_id as id, d.label, d.vec_id as d_id, list_distance(q.embedding::double[], d.embedding::double[]) as distance,
    row_number() over (partition by q.vec_id order by list_distance(q.embedding::double[], d.embedding::double[]), d.vec_id) as r
    from embeddings q join embeddings d on q.vec_id <> d.vec_id qualify r <= 5)"""


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"), "label")


@query("knn_classify", f"""with {NEAR_SQL} select id, label as prediction, cast(n as double) as votes from (select id, label, count(*) as n from near group by 1, 2)
  qualify row_number() over (partition by id order by n desc, label) = 1""")
def knn_classify(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return knn.knn_classify(v, v, 5, exclude_self=True)


@query("knn_regress", f"with {NEAR_SQL} select id, round(avg(label), 6) as prediction from near group by 1")
def knn_regress(spark, sf_dir):
    """Cut into many cells and blocks, the way a large table is."""
    v = _vectors(spark, sf_dir)
    return round_doubles(knn.knn_regress(v, v, 5, exclude_self=True, cell_rows=64, query_rows=100), 6)


@query("cell_search", """with n as (select q.vec_id as q_id, d.vec_id as d_id, list_distance(q.embedding::double[], d.embedding::double[]) as distance,
    row_number() over (partition by q.vec_id order by list_distance(q.embedding::double[], d.embedding::double[]), d.vec_id) as rank
    from embeddings q join embeddings d on q.vec_id % 50 = 0 and q.vec_id <> d.vec_id qualify rank <= 10)
  select q_id, cast(rank as int) as rank, d_id, round(distance, 6) as distance from n""")
def cell_search(spark, sf_dir):
    """Every cell of the index is searched, which is exact; the queries are the ids divisible by 50."""
    v = _vectors(spark, sf_dir).select("id", "vec")
    index = near.cell_index(v)
    return round_doubles(index.search(v.where("id % 50 = 0"), 10, len(index.centres), exclude_self=True).select("q_id", "rank", "d_id", "distance"), 6)


@query("gaussian_nb_fit", """with f as (select (dense_rank() over (order by l_returnflag) - 1) as c, l_quantity as q, l_discount as d, l_tax as t from lineitem)
  select cast(c as int) as class, round(avg(q), 4) as mean_q, round(avg(d), 4) as mean_d, round(avg(t), 4) as mean_t, round(var_pop(q), 4) as var_q from f group by 1""")
def gaussian_nb_fit(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(
        F.expr("case l_returnflag when 'A' then 0.0D when 'N' then 1.0D else 2.0D end").alias("label"), "l_quantity", "l_discount", "l_tax")
    vec = VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(df)
    model = registry(True)["naive_bayes"].fit(vec, Task(True, 3), {})
    theta, sigma = model.theta.toArray(), model.sigma.toArray()
    rows = [(i, *map(float, theta[i]), float(sigma[i][0])) for i in range(3)]
    return round_doubles(report(spark, rows, "class int, mean_q double, mean_d double, mean_t double, var_q double"))


@query("ridge_fit", """select round(sxy / (sxx + 1000.0), 4) as slope from (select sum((l_quantity - mx) * (l_extendedprice - my)) as sxy, sum(pow(l_quantity - mx, 2)) as sxx
  from lineitem, (select avg(l_quantity) as mx, avg(l_extendedprice) as my from lineitem))""")
def ridge_fit(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").alias("label"), "l_quantity")
    vec = VectorAssembler(inputCols=["l_quantity"], outputCol="features").transform(df)
    info = df.agg(F.count("*").alias("n"), F.stddev_pop("label").alias("s")).first()
    model = registry(False)["ridge"].fit(vec, Task(False, rows=info["n"], width=1, label_std=info["s"]), {"alpha": 1000.0})
    return round_doubles(report(spark, [(float(model.coefficients[0]),)], "slope double"))


def _best_split_sql(name: str, side: str) -> str:
    """Best split of each group by second-order gain, from the cells of a frame with (out, side, j, v, g, h)."""
    return f"""{name}_cells as (select out, {side} as side, j, v, sum(g) as g, sum(h) as h from {name}_long group by all),
  {name}_sums as (select *, sum(g) over along as lg, sum(h) over along as lh, sum(g) over whole as tg, sum(h) over whole as th, count(*) over whole as bins,
    row_number() over along as bin from {name}_cells window along as (partition by out, side, j order by v), whole as (partition by out, side, j)),
  {name}_best as (select *, 0.5 * (lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1)) as gain from {name}_sums where bin < bins
    qualify row_number() over (partition by out, side order by gain desc, j, v) = 1)"""


def _long_sql(rows: str, keep: str) -> str:
    return " union all ".join(f"select {keep}, {j} as j, x{j} as v, g, h from {rows}" for j in range(3))


# Every feature has fewer distinct values than bins, so the bins are the values.
FIRST_TREE_SQL = f"""with f as (select (dense_rank() over (order by l_returnflag) - 1)::int as y, l_quantity as x0, l_discount as x1, l_tax as x2 from lineitem),
  shares as (select y as out, count(*) / (select count(*) from f) as p from f group by y),
  r as (select out, x0, x1, x2, p - (y = out)::int as g, p * (1 - p) as h from f, shares),
  root_long as ({_long_sql('r', 'out')}), {_best_split_sql('root', '0')},
  s as (select r.*, (case b.j when 0 then x0 when 1 then x1 else x2 end > b.v)::int as side from r join root_best b using (out)),
  child_long as ({_long_sql('s', 'out, side')}), {_best_split_sql('child', 'side')},
  deeper as (select * from child_best qualify row_number() over (partition by out order by gain desc, side) = 1)
  select b.out, b.j as root_feature, b.v as root_threshold, d.side, d.j as child_feature, d.v as child_threshold, round(b.gain, 6) as root_gain,
    round(-d.lg / (d.lh + 1), 6) as left_value, round(-(d.tg - d.lg) / (d.th - d.lh + 1), 6) as right_value,
    round(case when d.side = 0 then -(b.tg - b.lg) / (b.th - b.lh + 1) else -b.lg / (b.lh + 1) end, 6) as other_value
  from root_best b join deeper d using (out)"""


def flag_vectors(spark, sf_dir):
    """Three numbers of ``lineitem`` as features and the return flag as class."""
    df = table(spark, sf_dir, "lineitem").select(
        F.expr("case l_returnflag when 'A' then 0.0D when 'N' then 1.0D else 2.0D end").alias("label"), "l_quantity", "l_discount", "l_tax")
    return VectorAssembler(inputCols=["l_quantity", "l_discount", "l_tax"], outputCol="features").transform(df)


@query("boosted_first_tree", FIRST_TREE_SQL)
def boosted_first_tree(spark, sf_dir):
    """The first round of a booster for three classes: one leaf-wise tree with three leaves for each class."""
    p = boosting.Boosting(rounds=1, depth=2, leaves=3, rate=1.0, l2=1.0)
    rows = []
    for out, t in enumerate(boosting.fit_boosting(flag_vectors(spark, sf_dir), 3, p).rounds[0]):
        side = int(t.feature[t.left[0]] < 0)
        child, other = (t.right[0], t.left[0]) if side else (t.left[0], t.right[0])
        rows.append((out, int(t.feature[0]), float(t.threshold[0]), side, int(t.feature[child]), float(t.threshold[child]), float(t.gain[0]),
                     *(float(t.value[i, 0]) for i in (t.left[child], t.right[child], other))))
    return round_doubles(report(spark, rows, "out int, root_feature int, root_threshold double, side int, child_feature int, child_threshold double, "
                                             "root_gain double, left_value double, right_value double, other_value double"), 6)


@query("balanced_weights", """with v as (select dense_rank() over (order by toxic) - 1 as label, count(*) as n from labels group by toxic)
  select cast(label as double) as label, n, round((select sum(n) from v) / (2 * n), 6) as weight from v""")
def balanced_weights(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select(F.col("toxic").cast("double").alias("label"))
    out = search.balanced_weights(df, 2)
    return out.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("weight"), 6).alias("weight"))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders")


@query("recipe_scores")
def recipe_scores(spark, sf_dir):
    """All eight recipes on a table with numbers, categories and dates."""
    p = search.prepare(_orders(spark, sf_dir), "o_orderstatus", True, ["o_orderkey"], parallelism=8)
    p.release()
    return scores_table(spark, p.recipe_scores)


@query("leaderboard")
def leaderboard(spark, sf_dir):
    p = search.prepare(_orders(spark, sf_dir), "o_orderstatus", True, ["o_orderkey"], grid=ONE)
    entries = search.train_all(p.train, p.val, p.task, trials=0, params=LIGHT, ensembles=False,
                               models=["logistic_regression", "random_forest", "gradient_boosting", "adaboost", "naive_bayes", "knn"])
    p.release()
    out = search.leaderboard_table(spark, entries, True)
    return out.select("model_name", "model_type", "metric", "score")


@query("leaderboard_regression")
def leaderboard_regression(spark, sf_dir):
    p = search.prepare(table(spark, sf_dir, "part"), "p_retailprice", False, ["p_partkey"], grid=ONE)
    entries = search.train_all(p.train, p.val, p.task, trials=0, params=LIGHT, models=["ridge", "random_forest", "gradient_boosting"])
    p.release()
    return search.leaderboard_table(spark, entries, False).select("model_name", "model_type", "metric", "score")


@query("linear_svm_and_mlp")
def linear_svm_and_mlp(spark, sf_dir):
    p = search.prepare(table(spark, sf_dir, "labels"), "quality", True, ["doc_id"], grid=ONE)
    entries = search.train_all(p.train, p.val, p.task, trials=0, params=LIGHT, models=["naive_bayes"], ensembles=False)
    fams = registry(True)
    for name in ("linear_svm", "mlp"):
        entries.append(search.train_one(fams[name], p.train, p.val, p.task, 0, None, 3, 60.0, LIGHT.get(name)))
    p.release()
    return search.leaderboard_table(spark, entries, True).select("model_name", "score")


def _members(spark, sf_dir):
    p = search.prepare(_orders(spark, sf_dir), "o_orderstatus", True, ["o_orderkey"], grid=ONE)
    entries = search.train_all(p.train, p.val, p.task, trials=0, params=LIGHT, ensembles=False,
                               models=["logistic_regression", "random_forest", "naive_bayes"])
    return p, entries


@query("voting")
def voting(spark, sf_dir):
    p, entries = _members(spark, sf_dir)
    model = search.add_voting(entries, p.val, p.task).model
    out = cut_lineage(score(model, p.val).select(search.ORDER, "label", "prediction"))
    p.release()
    return out


@query("stacking")
def stacking(spark, sf_dir):
    p, entries = _members(spark, sf_dir)
    model = search.add_stacking(entries, p.train, p.val, p.task).model
    out = cut_lineage(score(model, p.val).select(search.ORDER, "label", "prediction"))
    p.release()
    return out


@query("cv_report")
def cv_report(spark, sf_dir):
    out = search.cross_validate(_orders(spark, sf_dir), "o_orderstatus", "random_forest", 3, key=["o_orderkey"],
                                params=LIGHT["random_forest"])
    return search.cv_table(spark, out)


@query("tuned_model")
def tuned_model(spark, sf_dir):
    """Random search of one family with cross-validation."""
    b = search.deep_tune(_orders(spark, sf_dir), "o_orderstatus", "linear", 3, key=["o_orderkey"], grid=ONE)
    return b.leaderboard(spark).select("model_name", "metric", "score", "cv_score")


@query("quick_benchmark")
def quick_benchmark(spark, sf_dir):
    b = search.quick_benchmark(table(spark, sf_dir, "labels"), "toxic", ["linear", "random_forest"], 0, "balanced",
                               key=["doc_id"], grid=ONE, params=LIGHT)
    return b.leaderboard(spark).select("model_name", "metric", "score")


@query("adaptive_search")
def adaptive_search(spark, sf_dir):
    _, history = search.adaptive_search(_orders(spark, sf_dir).drop("o_orderdate"), "o_orderstatus", key=["o_orderkey"], trials=0,
                                        deep_trials=0, grid=ONE, params=LIGHT)
    return report(spark, history, search.HISTORY)


@query("error_analysis", f"""with a as (select avg((y = p::int)::int) as a, avg((y = (s > 0.5)::int)::int) as b, avg((y = 1)::int) as c from {SCORED}),
  best as (select greatest(a, b, c) as best, round(greatest(a, b, c) - least(a, b, c), 4) as spread from a),
  r as (select min(n) / max(n) as ratio from (select count(*) as n from labels group by quality))
  select 'class_imbalance' as finding, 'use balanced class weights' as suggestion, round(ratio, 6) as value from r where ratio < 0.3
  union all select 'low_accuracy', 'more trials or stronger families', round(best, 6) from best where best < 0.75
  union all select 'suspiciously_high_accuracy', 'remove columns derived from the target', round(best, 6) from best where best > 0.98
  union all select 'large_model_spread', 'tune only the leading families', spread from best where spread > 0.1""")
def error_analysis(spark, sf_dir):
    """Findings about three predictors of the quality label, from their accuracies on the whole table."""
    scored = _scored(spark, sf_dir).withColumns({"half": (F.col("s") > 0.5).cast("int"), "always": F.lit(1)})
    scores = [metrics.classification_metrics(scored, "y", c).first()["accuracy"] for c in ("p", "half", "always")]
    profile = TableProfile(table(spark, sf_dir, "labels"), "quality", "classification")
    return round_doubles(search.analyze_errors(profile, scores, True), 6)


@query("default_plan", """select case when n < 500 then 12 when n < 5000 then 25 else 40 end as trials, case when n < 500 then 'svm' else 'gradient_boosting' end as has_family
  from (select count(*) as n from part)""")
def default_plan(spark, sf_dir):
    plan = search.default_plan(TableProfile(table(spark, sf_dir, "part"), "p_retailprice").facts())
    return report(spark, [(plan["trials"], "gradient_boosting" if "gradient_boosting" in plan["models"] else "svm")], "trials int, has_family string")


def trained(spark, sf_dir):
    return AutoTable(table(spark, sf_dir, "customer"), "c_mktsegment", "classification", key=["c_custkey"], trials=0, grid=ONE,
                     models=["logistic_regression"], params=LIGHT, ensembles=False).run()


@query("batch_predict")
def batch_predict(spark, sf_dir):
    auto = trained(spark, sf_dir)
    return auto.scorer.predict(table(spark, sf_dir, "customer").drop("c_mktsegment")).select("c_custkey", "prediction", "confidence")


@query("naive_bayes_scores", """with f as (select row_number() over () as id, case l_returnflag when 'A' then 0.0 when 'N' then 1.0 else 2.0 end::double as label,
    l_quantity as a, l_discount as b, l_tax as c from lineitem),
  e as (select 1e-9 * greatest(var_pop(a), var_pop(b), var_pop(c)) as e from f),
  m as (select label as k, count(*)::double as n, avg(a) as ma, var_pop(a) + any_value(e) as va, avg(b) as mb, var_pop(b) + any_value(e) as vb,
    avg(c) as mc, var_pop(c) + any_value(e) as vc from f, e group by label),
  s as (select id, label, k, ln(n) - 0.5 * (ln(va) + pow(a - ma, 2) / va + ln(vb) + pow(b - mb, 2) / vb + ln(vc) + pow(c - mc, 2) / vc) as s from f, m),
  p as (select id, any_value(label) as label, arg_max(k, s) as prediction, 1 / sum(exp(s - top)) as confidence from (select *, max(s) over (partition by id) as top from s) group by id)
  select label, prediction, count(*) as n, round(avg(confidence), 6) as confidence from p group by label, prediction""")
def naive_bayes_scores(spark, sf_dir):
    vec = flag_vectors(spark, sf_dir)
    scored = score(NaiveBayes(modelType="gaussian").fit(vec), vec)
    return round_doubles(scored.groupBy("label", "prediction").agg(F.count("*").alias("n"),
                                                                  F.avg(F.array_max(vector_to_array("probability"))).alias("confidence")), 6)
