"""Tables written in every format and read back, stored models and runs, batch and stream scoring.

The given tables are first laid down as files of the format in question, in the folder that executors share."""

from __future__ import annotations

import datetime as dt

from pyspark.ml import PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tabsmith.functions.session import shared_folder
from tabsmith.operators import features
from tabsmith.operators.drift import drift_report
from tabsmith.operators.models import Task, registry
from tabsmith.operators.stats import round_doubles
from tabsmith.plans.autotable import TableScorer
from tabsmith.plans.catalogue import SQL, query, table
from tabsmith.plans.catalogue import drifting, preparing
from tabsmith.sources import runs as run_store
from tabsmith.sources import sinks
from tabsmith.sources.tables import load_table, resolve_target
from tabsmith.streaming.scoring import score_stream


@query("csv_scan", """select o_orderkey, case when o_orderkey % 5 = 0 then null else o_orderpriority end as o_orderpriority,
  case when o_custkey % 7 = 0 then null else o_totalprice end as o_totalprice, o_custkey % 2 = 0 as even, case when o_custkey % 3 <> 0 then o_custkey end as sparse,
  strftime(o_orderdate, '%Y-%m-%d') as o_orderdate, 'o_orderstatus' as target, o_orderstatus from orders""")
def csv_scan(spark, sf_dir):
    """csv files with padded names and the texts that stand for a missing value; types are found out, the target by its name in capitals."""
    folder = shared_folder(spark, "scan") + ".csv"
    raw = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias(" o_orderkey "), F.when(F.col("o_orderkey") % 5 == 0, F.lit("N/A")).otherwise(F.col("o_orderpriority")).alias("o_orderpriority"),
        F.when(F.col("o_custkey") % 7 == 0, F.lit("-nan")).otherwise(F.col("o_totalprice").cast("string")).alias("o_totalprice "),
        F.when(F.col("o_custkey") % 2 == 0, F.lit("True")).otherwise(F.lit("false")).alias("even"),
        F.when(F.col("o_custkey") % 3 == 0, F.lit("NULL")).otherwise(F.col("o_custkey").cast("string")).alias(" sparse"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"), "o_orderstatus")
    raw.write.option("header", True).csv(folder)
    df = load_table(spark, folder)
    return df.withColumn("target", F.lit(resolve_target(df, "O_ORDERSTATUS")))


@query("json_scan", "select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal, case when c_custkey % 4 <> 0 then c_mktsegment end as c_mktsegment from customer")
def json_scan(spark, sf_dir):
    folder = shared_folder(spark, "scan") + ".json"
    table(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 4 != 0, F.col("c_mktsegment"))).write.json(folder)
    return load_table(spark, folder).select("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")


@query("parquet_scan", "select p_partkey, p_name, p_size, case when p_size % 5 = 0 then null else p_retailprice end as p_retailprice from part")
def parquet_scan(spark, sf_dir):
    """NaN in a number column is a missing value."""
    folder = shared_folder(spark, "scan") + ".parquet"
    table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias(" p_name"), "p_size", F.when(
        F.col("p_size") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("p_retailprice")).alias("p_retailprice")).write.parquet(folder)
    return load_table(spark, folder)


# A line with a penalty, fitted to two columns; what is stored and served below is this model.
LINE_SQL = """line as (select sxy / (sxx + 10.0) as slope, my - mx * sxy / (sxx + 10.0) as start from (
    select sum((l_quantity - mx) * (l_extendedprice - my)) as sxy, sum(pow(l_quantity - mx, 2)) as sxx, any_value(mx) as mx, any_value(my) as my
    from lineitem, (select avg(l_quantity) as mx, avg(l_extendedprice) as my from lineitem)))"""
SERVED_SQL = f"with {LINE_SQL} select l_orderkey, cast(l_linenumber as bigint) as l_linenumber, round(start + slope * l_quantity, 3) as prediction from lineitem, line"


def _line_scorer(spark, sf_dir) -> TableScorer:
    df = table(spark, sf_dir, "lineitem")
    prep = PipelineModel([VectorAssembler(inputCols=["l_quantity"], outputCol="features")])
    info = df.agg(F.count("*").alias("n"), F.stddev_pop("l_extendedprice").alias("s"), F.avg("l_quantity").alias("m")).first()
    model = registry(False)["ridge"].fit(prep.transform(df).select("features", F.col("l_extendedprice").alias("label")),
                                         Task(False, rows=info["n"], width=1, label_std=info["s"]), {"alpha": 10.0})
    return TableScorer(prep, model, {"features": ["l_quantity"], "defaults": {"l_quantity": info["m"]}, "classes": []})


def _served(df):
    return round_doubles(df.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "prediction"), 3)


@query("model_bundle", SERVED_SQL)
def model_bundle(spark, sf_dir):
    """A scorer stored with its preprocessing and facts, loaded again, scores every line."""
    folder = shared_folder(spark, "bundle")
    _line_scorer(spark, sf_dir).save(spark, folder)
    return _served(TableScorer.load(spark, folder).predict(table(spark, sf_dir, "lineitem")))


@query("scores_without_column", f"with {LINE_SQL} select s_suppkey, round(start + slope * (select avg(l_quantity) from lineitem), 3) as prediction from supplier, line")
def scores_without_column(spark, sf_dir):
    """Rows that lack the feature column get its training default."""
    out = _line_scorer(spark, sf_dir).predict(table(spark, sf_dir, "supplier"))
    return round_doubles(out.select("s_suppkey", "prediction"), 3)


@query("score_file", SERVED_SQL)
def score_file(spark, sf_dir):
    """Batch scores as csv, read back."""
    folder = shared_folder(spark, "scores") + ".csv"
    sinks.write_scores(_line_scorer(spark, sf_dir).predict(table(spark, sf_dir, "lineitem")), folder, ["l_orderkey", "l_linenumber"])
    return _served(load_table(spark, folder))


@query("stream_scores", SERVED_SQL)
def stream_scores(spark, sf_dir):
    """The lines as a stream of files, scored micro-batch by micro-batch."""
    work, scorer = shared_folder(spark, "stream"), _line_scorer(spark, sf_dir)
    schema = table(spark, sf_dir, "lineitem").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "lineitem*.parquet").parquet(sf_dir)
    score_stream(stream, scorer.predict, f"{work}/out", f"{work}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return _served(spark.read.parquet(f"{work}/out"))


@query("stored_drift", f"with r as ({SQL['drift_report']}) select r.*, d as check_date from r, (select unnest(['2024-02-01', '2024-02-02']) as d)")
def stored_drift(spark, sf_dir):
    """Reports of two checks, appended to one table by date."""
    folder = shared_folder(spark, "drift")
    ref, cur = (part.select("user_id", "event_type", "value") for part in drifting._events(spark, sf_dir))
    for day in (1, 2):
        sinks.append_drift_report(drift_report(ref, cur, check_ts=dt.datetime(2024, 2, day)), folder)
    out = spark.read.parquet(folder)
    return round_doubles(out.select("column", "type", "n_ref", "n_cur", "ks", "psi", "chi2", "drifted", F.col("check_date").cast("string").alias("check_date")), 6)


@query("enriched_table", SQL["interactions"])
def enriched_table(spark, sf_dir):
    """A table with engineered features, materialised and read from its files."""
    df, names = features.engineer_features(preparing._line(spark, sf_dir), "l_orderkey", "interactions")
    return preparing._digest(sinks.write_table(df, shared_folder(spark, "table")), names)


@query("stored_runs", """with r as (select o_orderpriority, count(*) as n, round(avg((o_orderstatus = 'F')::int), 6) as best from orders group by 1)
  select o_orderpriority as run_id, 'ridge' as best_model, best as best_score, n as n_rows, 2 as models,
    (select count(distinct o_orderstatus) from orders o where o.o_orderpriority = r.o_orderpriority) as classes, best as top_importance from r where o_orderpriority < '4'""")
def stored_runs(spark, sf_dir):
    """A run for each priority of ``orders`` appended to the run tables; completed ones are restored with their board and classes."""
    root, orders = shared_folder(spark, "runs"), table(spark, sf_dir, "orders")
    shares = orders.groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("int")), 6).alias("best"))
    sizes: dict[str, list] = {}
    for r in orders.groupBy("o_orderpriority", "o_orderstatus").count().collect():
        sizes.setdefault(r[0], []).append((r[1], r[2]))
    for r in shares.collect():
        board = spark.createDataFrame([("ridge", r["best"]), ("knn", 0.0)], "model_name string, score double")
        weights = spark.createDataFrame([("o_totalprice", r["best"])], "feature string, importance double")
        run_store.append_run(spark, root, {"run_id": r["o_orderpriority"], "status": "completed" if r["o_orderpriority"] < "4" else "failed", "n_rows": r["n"],
                                           "best_model": "ridge", "best_score": r["best"]}, board, weights, sizes[r["o_orderpriority"]], [])
    board = spark.read.parquet(f"{root}/leaderboard").groupBy("run_id").agg(F.count("*").cast("int").alias("models"))
    classes = spark.read.parquet(f"{root}/classes").groupBy("run_id").agg(F.count("*").alias("classes"))
    weights = spark.read.parquet(f"{root}/importance").groupBy("run_id").agg(F.max("importance").alias("top_importance"))
    found = run_store.completed_runs(spark, root).join(board, "run_id").join(classes, "run_id").join(weights, "run_id")
    return found.select("run_id", "best_model", "best_score", "n_rows", "models", "classes", "top_importance")
