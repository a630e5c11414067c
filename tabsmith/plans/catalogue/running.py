"""Analysis of many runs.  The run tables are derived from orders (one run each) and their
line items (one model each), so they grow with the data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabsmith.operators import run_analytics as ra
from tabsmith.operators.stats import round_doubles
from tabsmith.plans.catalogue import query, table

RUNS_SQL = """runs as (select o_orderkey as run_id, case o_orderstatus when 'F' then 'completed' when 'O' then 'training' else 'failed' end as status,
    case when o_orderpriority < '4' then 'classification' else 'regression' end as problem_type, cast(floor(o_totalprice / 100) as bigint) as n_rows from orders),
  leaderboard as (select l_orderkey as run_id, 'model_' || l_linenumber as model_name, max(round(1 - l_discount * l_quantity / 10, 4)) as score from lineitem group by 1, 2),
  importance as (select l_orderkey as run_id, 'feature_' || (l_partkey % 10) as feature, round(sum(l_extendedprice), 2) as importance from lineitem group by 1, 2),
  classes as (select l_orderkey as run_id, l_returnflag as class, count(*) as n from lineitem group by 1, 2),
  missing as (select l_orderkey as run_id, 'column_' || l_linenumber as "column", max(l_tax * 500) as pct from lineitem group by 1, 2)"""


def _tables(spark, sf_dir):
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    runs = orders.selectExpr(
        "o_orderkey as run_id", "case o_orderstatus when 'F' then 'completed' when 'O' then 'training' else 'failed' end as status",
        "case when o_orderpriority < '4' then 'classification' else 'regression' end as problem_type",
        "cast(floor(o_totalprice / 100) as bigint) as n_rows")
    lines = lines.withColumnRenamed("l_orderkey", "run_id")
    leaderboard = lines.groupBy("run_id", F.expr("'model_' || l_linenumber").alias("model_name")).agg(
        F.max(F.expr("round(1 - l_discount * l_quantity / 10, 4)")).alias("score"))
    importance = lines.groupBy("run_id", F.expr("'feature_' || (l_partkey % 10)").alias("feature")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("importance"))
    classes = lines.groupBy("run_id", F.col("l_returnflag").alias("class")).agg(F.count("*").alias("n"))
    missing = lines.groupBy("run_id", F.expr("'column_' || l_linenumber").alias("column")).agg(
        F.max(F.expr("l_tax * 500")).alias("pct"))
    return runs, leaderboard, importance, classes, missing


@query("run_stats", f"""with {RUNS_SQL}, best as (select run_id, max(score) as best, count(*) as k from leaderboard group by 1)
  select count(*) as total_runs, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed,
    count(*) filter (status = 'training') as training, cast(sum(case when status = 'completed' then coalesce(k, 0) else 0 end) as bigint) as total_models,
    round(avg(best) filter (status = 'completed' and problem_type = 'classification'), 4) as avg_best_accuracy,
    round(avg(best) filter (status = 'completed' and problem_type = 'regression'), 4) as avg_best_r2 from runs left join best using (run_id)""")
def run_stats(spark, sf_dir):
    runs, lb, *_ = _tables(spark, sf_dir)
    return ra.run_statistics(runs, lb)


@query("list_runs", f"with {RUNS_SQL} select * from runs where status = 'completed'")
def list_runs(spark, sf_dir):
    return ra.list_runs(_tables(spark, sf_dir)[0], "completed")


BEST_SQL = """best as (select run_id, max(score) as best_score, count(*) as n_models, max(case when r = 1 then model_name end) as best_model,
    max(case when r = 2 then score end) as second_score from (select *, row_number() over (partition by run_id order by score desc, model_name) as r from leaderboard) group by 1)"""


@query("compare_runs", f"""with {RUNS_SQL}, {BEST_SQL} select runs.*, best_score, n_models, best_model, second_score from runs left join best using (run_id)
  where status = 'completed' and run_id in (select distinct run_id from classes where class = 'R')""")
def compare_runs(spark, sf_dir):
    runs, lb, _, classes, _ = _tables(spark, sf_dir)
    return ra.compare_runs(runs, lb, classes.where("class = 'R'").select("run_id").distinct())


@query("leaderboard_order", f"""with {RUNS_SQL} select run_id, model_name, score, cast(row_number() over (partition by run_id order by score desc, model_name) as int) as rank
  from leaderboard qualify rank <= 3""")
def leaderboard_order(spark, sf_dir):
    _, lb, *_ = _tables(spark, sf_dir)
    return ra.top_features(lb.withColumnsRenamed({"model_name": "feature", "score": "importance"}), 3).withColumnsRenamed(
        {"feature": "model_name", "importance": "score"})


@query("run_insights", f"""with {RUNS_SQL}, b as (select run_id, max(score) as s from leaderboard group by 1),
  t as (select run_id, string_agg(feature, ',' order by r) as top_predictors from (select *, row_number() over (partition by run_id order by importance desc, feature) as r from importance)
    where r <= 3 group by 1)
  select run_id, case when coalesce(s, 0) >= 0.95 then 'exceptional' when coalesce(s, 0) >= 0.85 then 'strong' when coalesce(s, 0) >= 0.7 then 'decent' else 'low' end as band,
    s as best_score, top_predictors from runs left join b using (run_id) left join t using (run_id) where status = 'completed'""")
def run_insights(spark, sf_dir):
    runs, lb, imp, *_ = _tables(spark, sf_dir)
    return ra.insights(runs, lb, imp)


DOCTOR_SQL = f"""with {RUNS_SQL}, {BEST_SQL}, i as (select run_id, max(importance) as top, sum(importance) as total from importance group by 1),
  c as (select run_id, min(n) / max(n) as ratio, count(*) as k from classes group by 1), m as (select run_id, count(*) filter (pct > 30) as heavy from missing group by 1),
  f as (select *, coalesce(best_score, 0) as s from runs left join best using (run_id) left join i using (run_id) left join c using (run_id) left join m using (run_id) where status = 'completed'),
  d as (select run_id, case when s >= 0.95 then 'warning' when s >= 0.85 then 'healthy' when s >= 0.7 then 'warning' else 'critical' end as severity,
      case when s >= 0.95 then 'leakage_risk' else 'performance' end as category, s as value from f
    union all select run_id, 'info', 'ensemble_opportunity', abs(best_score - second_score) from f where abs(best_score - second_score) < 0.003
    union all select run_id, 'warning', 'feature_dominance', top from f where top > 0.5 * total
    union all select run_id, 'warning', 'class_imbalance', ratio from f where problem_type = 'classification' and k >= 2 and ratio < 0.2
    union all select run_id, 'warning', 'missing_data', heavy from f where heavy > 0
    union all select run_id, 'warning', 'dataset_size', n_rows from f where n_rows > 0 and n_rows < 500)"""


@query("doctor", f"{DOCTOR_SQL} select run_id, severity, category, round(value, 4) as value from d")
def doctor(spark, sf_dir):
    return round_doubles(ra.diagnose(*_tables(spark, sf_dir)))


@query("doctor_health", f"""{DOCTOR_SQL} select run_id, case when bool_or(severity = 'critical') then 'critical' when bool_or(severity = 'warning') then 'warning' else 'healthy' end as health,
  cast(greatest(0, 100 - sum(case severity when 'critical' then 30 when 'warning' then 15 when 'info' then 5 else 0 end)) as bigint) as score, count(*) as n_findings from d group by 1""")
def doctor_health(spark, sf_dir):
    return ra.health(ra.diagnose(*_tables(spark, sf_dir)))
