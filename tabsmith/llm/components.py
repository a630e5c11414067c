"""Connected components by alternating stars, as joins and aggregates over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.session import cut_lineage


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of ``edges`` (long columns a, b), root being the smallest node reachable.

    Null ends and loops are ignored.  Each round points nodes at smaller neighbours; a few rounds are
    enough for most graphs, and the loop ends when nothing moves.
    """
    now = cut_lineage(
        edges.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = _mark(now)
    for _ in range(rounds):
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = cut_lineage(small.select("e.u", "e.v").where("u != v").distinct())
        was, mark = mark, _mark(now)
        if was == mark:
            break
    else:
        raise RuntimeError("the components did not settle")
    pointed = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return pointed.union(pointed.select(F.col("root").alias("node"), "root").distinct())


def _mark(edges: DataFrame):
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
