"""Boosting on tables with categories: ordered target statistics, then trees with one split a level.

A category becomes the mean target of the rows with that category that come earlier in a fixed random order, so no row
sees its own target.  Rows are ordered by a hash; equal parts of the hash range are buckets, and a row's sum is that of
its category in the buckets before, plus that of the rows before it inside its bucket.  So a category that most rows
have is spread over all buckets, and no task gets more than a bucket of rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import as_double, ref
from tabsmith.functions.session import BROADCAST_ROWS, BUCKET_ROWS, cut_lineage
from tabsmith.operators.boosting import BoostedModel, Boosting, fit_boosting

GAP = "nan"  # the category of a NULL


def _category(name: str) -> Column:
    return F.coalesce(ref(name).cast("string"), F.lit(GAP))


def ordered_statistics(df: DataFrame, categories: Sequence[str], targets: dict[str, Column], order: Column, span: int, prior: float = 1.0,
                       bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``df`` with ``<category>~<target>`` for each pair: (sum of the target over earlier rows of the category + prior * mean) / (their number + prior).

    ``order`` is a whole number from 0 to ``span`` - 1 spread evenly over the rows, as a hash is; rows with the same
    number do not see each other.  ``mean`` is the target's mean over all rows.  Targets must not be null; a null
    category is a category.
    """
    names = [f"_t{i}" for i in range(len(targets))]
    rows = cut_lineage(df.withColumns({"_order": order.cast("long"), **{n: t.cast("double") for n, t in zip(names, targets.values())}}))
    total, *means = rows.agg(F.count("*"), *(F.avg(n) for n in names)).first()
    buckets = max(1, -(-total // bucket_rows))
    width = -(-span // buckets)
    rows = rows.withColumn("_bucket", F.floor(F.col("_order") / width))
    sums = ["_n", *(f"_s{i}" for i in range(len(names)))]
    for c in categories:
        at = rows.withColumn("_category", _category(c))
        # Rows of one order number count together, after all of them.
        here = at.groupBy("_bucket", "_category", "_order").agg(F.count("*").alias("_n"), *(F.sum(n).alias(f"_s{i}") for i, n in enumerate(names)))
        parts = here.groupBy("_bucket", "_category").agg(*(F.sum(s).alias(s) for s in sums))
        before = Window.partitionBy("_category").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
        offsets = parts.select("_bucket", "_category", *(F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"_o{s}") for s in sums))
        inside = Window.partitionBy("_bucket", "_category").orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)
        earlier = here.select("_bucket", "_category", "_order", *(F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(s) for s in sums))
        earlier = earlier.join(offsets, ["_bucket", "_category"]).select(
            "_bucket", "_category", "_order", *((F.col(s) + F.col(f"_o{s}")).alias(f"_e{s}") for s in sums))
        found = at.join(earlier, ["_bucket", "_category", "_order"])
        rows = found.withColumns({
            f"{c}~{t}": (F.col(f"_e_s{i}") + F.lit(prior * (m or 0.0))) / (F.col("_e_n") + F.lit(prior)) for i, (t, m) in enumerate(zip(targets, means))
        }).drop("_category", *(f"_e{s}" for s in sums))
    return rows.drop("_order", "_bucket", *names)


def category_statistics(df: DataFrame, categories: Sequence[str], targets: dict[str, Column], prior: float = 1.0) -> tuple[dict[str, DataFrame], list[float]]:
    """For each column a table (category, statistics) over all rows, as new rows are coded; and the statistics of an unknown category."""
    names = [f"_t{i}" for i in range(len(targets))]
    rows = df.select(*(_category(c).alias(f"_c{i}") for i, c in enumerate(categories)), *(t.cast("double").alias(n) for n, t in zip(names, targets.values())))
    means = [m or 0.0 for m in rows.agg(*(F.avg(n) for n in names)).first()]
    out = {}
    for i, c in enumerate(categories):
        stats = [(F.sum(n) + F.lit(prior * m)) / (F.count("*") + F.lit(prior)) for n, m in zip(names, means)]
        out[c] = cut_lineage(rows.groupBy(F.col(f"_c{i}").alias("category")).agg(F.array(*stats).alias("statistics")))
    return out, means


class OrderedBoostedModel:
    """Statistics of all training rows for the categories, and a booster over these and the numbers."""

    def __init__(self, numbers: list[str], tables: dict[str, DataFrame], means: list[float], booster: BoostedModel):
        self.numbers, self.tables, self.means, self.booster = numbers, tables, means, booster
        self.small = {c: t.count() <= BROADCAST_ROWS for c, t in tables.items()}

    @property
    def names(self) -> list[str]:
        return [*self.numbers, *(f"{c}~{i}" for c in self.tables for i in range(len(self.means)))]

    @property
    def featureImportances(self):  # noqa: N802
        return self.booster.featureImportances

    def encode(self, df: DataFrame) -> DataFrame:
        """``df`` with ``features``; an unknown category has the means of all rows."""
        unknown, codes = F.array(*map(F.lit, self.means)), []
        for i, (c, table) in enumerate(self.tables.items()):
            named = table.select(F.col("category").alias(f"_c{i}"), F.col("statistics").alias(f"_k{i}"))
            df = df.withColumn(f"_c{i}", _category(c)).join(F.broadcast(named) if self.small[c] else named, f"_c{i}", "left").drop(f"_c{i}")
            codes.append(F.coalesce(f"_k{i}", unknown))
        vector = F.concat(F.array(*(as_double(c) for c in self.numbers)).cast("array<double>"), *codes)
        return df.withColumn("features", array_to_vector(F.transform(vector, lambda v: F.coalesce(v, F.lit(float("nan")))))).drop(*(f"_k{i}" for i in range(len(codes))))

    def transform(self, df: DataFrame) -> DataFrame:
        return self.booster.transform(self.encode(df)).drop("features")


def fit_ordered_boosting(df: DataFrame, numbers: Sequence[str], categories: Sequence[str], label: str, classes: int = 0, p: Boosting | None = None,
                         key: Sequence[str] | None = None, prior: float = 1.0, seed: int = 42) -> OrderedBoostedModel:
    """Fit on raw columns; ``label`` holds classes 0..n-1, or any number when ``classes`` is 0.  Rows without a label are left out.

    Training rows are coded by what comes earlier in the order of a hash of ``key`` (or of the whole row), so that the
    booster does not learn to trust a category's own rows.  For more than two classes a category has a share for each
    class, else one number.  A missing number counts as larger than all.
    """
    from tabsmith.functions.expr import row_key
    df = df.where(ref(label).isNotNull())
    y = ref(label).cast("double")
    if classes > 2:
        targets = {str(k): (y == k).cast("double") for k in range(classes)}
    else:
        targets = {"0": y}
    span = 1 << 52
    order = F.pmod(row_key(list(key or df.columns), seed), F.lit(span))
    coded = ordered_statistics(df, categories, targets, order, span, prior)
    tables, means = category_statistics(df, categories, targets, prior)
    vector = F.array(*(F.coalesce(as_double(c), F.lit(float("nan"))) for c in numbers), *(ref(f"{c}~{t}") for c in categories for t in targets))
    rows = coded.select(array_to_vector(vector.cast("array<double>")).alias("features"), y.alias("label"))
    booster = fit_boosting(rows, classes, p or Boosting(rounds=100, depth=6, rate=0.1, l2=3.0, oblivious=True))
    return OrderedBoostedModel(list(numbers), tables, means, booster)
