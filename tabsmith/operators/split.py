"""Exact train/validation splits and folds without sorting or shuffling the rows.

Rows are ordered by a repeatable hash of their key.  A split of exact size is then the
filter ``hash <= threshold``, and the threshold is an order statistic of the hash inside
each class, found by histogram narrowing (``order_stats``).  Only the narrowing bins are
shuffled; a class that holds most of the rows costs nothing extra.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import ref, search_sorted_array
from tabsmith.functions.session import BROADCAST_ROWS, BUCKET_ROWS, cut_lineage
from tabsmith.operators.order_stats import group_order_statistics

HASH_RANGE = 1 << 52  # integers of this size are exact as doubles


def hash_order(key: Sequence[str], seed: int = 42) -> Column:
    """Uniform integer in [0, 2^52) from the key columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *[ref(k) for k in key]), F.lit(HASH_RANGE)).cast("double")


def _cut_points(df: DataFrame, label: str | None, order: Column, wanted) -> DataFrame | None:
    """``(g, cuts array<double>)``: for each class the hash values at ``wanted(n)`` sizes; None for very many classes."""
    g = (F.coalesce(ref(label).cast("string"), F.lit("")) if label else F.lit("")).alias("g")
    long = df.select(g, order.cast("double").alias("v"))
    groups = long.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    rows = groups.limit(BROADCAST_ROWS + 1).collect()
    if len(rows) > BROADCAST_ROWS:
        return None
    ranks, bounds = {}, {}
    for r in rows:
        bounds[r["g"]] = (r["lo"], r["hi"])
        ranks[r["g"]] = [m - 1 for m in wanted(r["n"])]
    stats = group_order_statistics(long, {g: [r for r in rs if r >= 0] for g, rs in ranks.items()}, bounds)
    cuts = [(g, [stats[g][r] if r >= 0 else -1.0 for r in rs]) for g, rs in ranks.items()]
    return df.sparkSession.createDataFrame(cuts, "g string, cuts array<double>")


def _with_part(df: DataFrame, label: str | None, order: Column, wanted, name: str) -> DataFrame:
    cuts = _cut_points(df, label, order, wanted)
    if cuts is None:
        return _with_part_of_many(df, label, order, wanted, name)
    longest = max(1, len(wanted(10 ** 6)))
    g = F.coalesce(ref(label).cast("string"), F.lit("")) if label else F.lit("")
    keyed = df.withColumn("_g", g).withColumn("_h", order.cast("double"))
    joined = keyed.join(F.broadcast(cuts), F.col("_g") == F.col("g"))  # one row per class, counted above
    part = search_sorted_array(F.col("_h"), F.col("cuts"), longest, inclusive=False)
    return joined.withColumn(name, part).drop("_g", "_h", "g", "cuts")


def _with_part_of_many(df: DataFrame, label: str, order: Column, wanted, name: str) -> DataFrame:
    """The same parts where classes are too many for a broadcast.

    At most one class in ``BUCKET_ROWS`` rows has more rows than that; these few are cut as above.  The others are
    ranked by hash inside the class, and equal hashes fall to one side together, as they do there.
    """
    g = F.coalesce(ref(label).cast("string"), F.lit(""))
    keyed = df.withColumn("_g", g)
    sizes = cut_lineage(keyed.groupBy(F.col("_g").alias("g")).agg(F.count("*").alias("_n")))
    large = sizes.where(F.col("_n") > BUCKET_ROWS).select("g")
    whole = keyed.join(F.broadcast(large), F.col("_g") == F.col("g"), "left_semi").drop("_g")
    rest = keyed.join(sizes.where(F.col("_n") <= BUCKET_ROWS), F.col("_g") == F.col("g")).withColumn("_h", order.cast("double"))
    # The sizes wanted are worked out once for each number of rows that a class has.
    distinct = [r["_n"] for r in sizes.where(F.col("_n") <= BUCKET_ROWS).select("_n").distinct().collect()]
    table = df.sparkSession.createDataFrame([(n, [float(m) for m in wanted(n)]) for n in distinct], "_n long, _ends array<double>")
    by_hash = Window.partitionBy("_g").orderBy("_h")
    upto = F.count("*").over(by_hash.rangeBetween(Window.unboundedPreceding, -1)).cast("double")
    part = F.size(F.filter("_ends", lambda e: e <= F.col("_before"))).cast("int")
    rest = rest.join(F.broadcast(table), "_n").withColumn("_before", upto).withColumn(name, part).select(*df.columns, name)
    if large.isEmpty():
        return rest
    return rest.unionByName(_with_part(whole, label, order, wanted, name).select(*df.columns, name))


def assign_split(df: DataFrame, order: Column, label: str | None = None, test_size: float = 0.2,
                 name: str = "is_val") -> DataFrame:
    """Add a boolean: the ceil(test_size * n) rows of each class with the smallest hash."""
    out = _with_part(df, label, order, lambda n: [math.ceil(n * test_size)], "_part")
    return out.withColumn(name, F.col("_part") == 0).drop("_part")


def train_val_split(df: DataFrame, key: Sequence[str], label: str | None = None, test_size: float = 0.2,
                    seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and validation rows, stratified by ``label`` if given."""
    marked = assign_split(df, hash_order(key, seed), label, test_size)
    return marked.where(~F.col("is_val")).drop("is_val"), marked.where("is_val").drop("is_val")


def fold_sizes(n: int, k: int) -> list[int]:
    """Sizes of k folds; the first n % k are one larger."""
    return [n // k + (1 if i < n % k else 0) for i in range(k)]


def assign_folds(df: DataFrame, order: Column, k: int, label: str | None = None, name: str = "fold") -> DataFrame:
    """Add a fold id 0..k-1; sizes differ by at most one inside each class."""

    def ends(n: int) -> list[int]:
        sizes = fold_sizes(n, k)
        return [sum(sizes[:i + 1]) for i in range(k - 1)]

    return _with_part(df, label, order, ends, name)
