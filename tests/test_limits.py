"""What changes form with size gives the same result in either form."""

import pytest
from pyspark.sql import functions as F

from tabsmith.functions import session
from tabsmith.operators import encode, order_stats, split
from tabsmith.streaming import drift_monitor


@pytest.fixture(scope="module")
def rows(spark):
    return spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("c"), (F.col("id") % 71).cast("string"))).alias("c"),
        F.concat(F.lit("d"), (F.col("id") % 7).cast("string")).alias("d"), (F.col("id") % 13).cast("double").alias("v"),
        F.timestamp_seconds(F.col("id") * 60).alias("ts")).repartition(4)


@pytest.mark.parametrize("how", ["split", "folds"])
def test_split_by_very_many_classes(rows, monkeypatch, how):
    def run():
        order = split.hash_order(["id"])
        out = split.assign_split(rows, order, "c") if how == "split" else split.assign_folds(rows, order, 4, "c")
        return {r["id"]: r[-1] for r in out.select("id", out.columns[-1]).collect()}
    small = run()
    monkeypatch.setattr(split, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(split, "BUCKET_ROWS", 500)  # "hot" has more
    calls = []
    real = split._with_part_of_many
    monkeypatch.setattr(split, "_with_part_of_many", lambda *a: calls.append(1) or real(*a))
    assert run() == small and calls


def test_group_order_statistics_in_parts(rows, monkeypatch):
    long = rows.select(F.col("c").alias("g"), "v")
    found = {r["g"]: (r["lo"], r["hi"], r["n"]) for r in long.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n")).collect()}
    ranks, bounds = {g: [0, n // 2] for g, (_, _, n) in found.items()}, {g: x[:2] for g, x in found.items()}
    whole = order_stats.group_order_statistics(long, ranks, bounds)
    monkeypatch.setattr(order_stats, "BROADCAST_ROWS", 20)
    assert order_stats.group_order_statistics(long, ranks, bounds) == whole


@pytest.mark.parametrize("encoder", [encode.OrdinalEncode, encode.BinaryEncode])
def test_ranks_of_very_many_categories(rows, monkeypatch, encoder):
    def run():
        out = encoder.of(["c", "d"]).fit(rows).transform(rows)
        return sorted(map(tuple, out.select(sorted(out.columns)).collect()))
    small = run()
    monkeypatch.setattr(encode, "BUCKET_ROWS", 5)
    assert run() == small


def test_drift_monitor_with_very_many_categories(rows, monkeypatch):
    def run():
        bins = drift_monitor.reference_bins(rows.where("id < 1500"), ["v", "c"])
        out = drift_monitor.windowed_drift(rows.where("id >= 1500"), bins, "ts", "6 hours")
        return bins.small, sorted(map(str, out.select(sorted(out.columns)).select(*[F.round(c, 9).alias(c) if t == "double" else c for c, t in sorted(out.dtypes)]).collect()))
    small, want = run()
    monkeypatch.setattr(drift_monitor, "BROADCAST_ROWS", 10)
    large, got = run()
    assert small and not large and got == want


def test_running_totals_of_very_many_groups(rows, monkeypatch):
    counts = rows.groupBy("c", "v").agg(F.count("*").alias("w"))
    def run():
        return sorted(map(tuple, order_stats.running_totals(counts, ["c"], "v", ["w"], 1000, bucket_rows=100).select("c", "v", "cum_w").collect()))
    small = run()
    monkeypatch.setattr(order_stats, "BROADCAST_ROWS", 1)
    assert run() == small


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        def getCheckpointDir(self):
            return None
    class Session:
        sparkContext = Context()
        class conf:
            get = staticmethod(lambda key, default=None: default)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session())
