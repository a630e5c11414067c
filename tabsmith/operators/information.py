"""Mutual information between features and a target, by quantile binning or by nearest neighbours."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import ref, with_positions
from tabsmith.functions.session import cut_lineage
from tabsmith.operators.knn import knn_join
from tabsmith.operators.order_stats import running_totals
from tabsmith.operators.stats import clean_values, summarize

# Values of a class that one task puts beside each other.
NEIGHBOUR_ROWS = 100_000


def _levels(bins: int) -> list[float]:
    return [i / bins for i in range(1, bins)]


def mutual_information(df: DataFrame, features: Sequence[str], target: str, classification: bool,
                       bins: int = 10) -> DataFrame:
    """``(feature, mi)`` in nats; gaps in a feature count as its median.

    Every feature is cut at its exact quantiles; so is a numeric target.  The shuffle
    carries (feature, bin, target bin) counts.
    """
    df = df.where(ref(target).isNotNull())
    probs = sorted({*_levels(bins), 0.5})
    cols = list(features) + ([] if classification else [target])
    stats = summarize(df, cols, probs, moments=0)
    values = clean_values(df, cols)

    # Values first, then positions among the edges, so that nothing is computed twice.
    def edges(c: str) -> list[float]:
        q = stats[c].quantiles
        return [q[p] for p in _levels(bins)] if q else []

    filled = [F.coalesce(values[c], F.lit(stats[c].quantiles.get(0.5, 0.0))).alias(f"_v{i}") for i, c in enumerate(cols)]
    y = ref(target).cast("string") if classification else F.lit(None).cast("string")
    wide = df.select(y.alias("by"), *filled)
    wide = with_positions(wide, {f"_b{i}": (f"_v{i}", edges(c), False) for i, c in enumerate(cols)})
    if not classification:
        wide = wide.withColumn("by", F.col(f"_b{len(cols) - 1}").cast("string"))
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"_b{i}").alias("bx")) for i, c in enumerate(features)]
    cells = (
        wide.select("by", F.inline(F.array(*structs)))
        .groupBy("feature", "bx", "by")
        .agg(F.count("*").alias("n"))
    )

    # n * MI = sum nxy ln nxy - sum nx ln nx - sum ny ln ny + n ln n, all three sums from one count of the cells
    none = F.lit(None)
    sides = F.array(
        F.struct(F.lit("xy").alias("side"), F.col("bx"), F.col("by")),
        F.struct(F.lit("x").alias("side"), F.col("bx"), none.cast("string").alias("by")),
        F.struct(F.lit("y").alias("side"), none.cast("int").alias("bx"), F.col("by")))
    counts = cells.select("feature", "n", F.inline(sides)).groupBy("feature", "side", "bx", "by").agg(F.sum("n").alias("n"))

    def over(side: str, value: Column) -> Column:
        return F.sum(F.when(F.col("side") == side, value))

    term = F.col("n") * F.ln("n")
    sums = counts.groupBy("feature").agg(
        over("xy", term).alias("sxy"), over("x", term).alias("sx"), over("y", term).alias("sy"), over("xy", F.col("n")).alias("total"))
    n = F.col("total")
    mi = (F.col("sxy") - F.col("sx") - F.col("sy") + n * F.ln(n)) / n
    return sums.select("feature", F.greatest(mi, F.lit(0.0)).alias("mi"))


# nearest neighbours ----------------------------------------------------------------
def digamma(n: Column) -> Column:
    """The digamma function of a number from 1 on: six steps up, then the asymptotic series (error below 1e-11)."""
    up = n + F.lit(6.0)
    square = 1.0 / (up * up)
    series = F.ln(up) - 0.5 / up - square * (1 / 12 - square * (1 / 120 - square * (1 / 252 - square * (1 / 240 - square / 132))))
    for i in range(6):
        series = series - 1.0 / (n + F.lit(float(i)))
    return series


def _points(df: DataFrame, features: Sequence[str], target: str, classification: bool) -> DataFrame:
    """(feature, y, x, n): distinct pairs of values, gaps being the feature's median.

    With a numeric target both are divided by their standard deviations, to nine digits, so that one distance serves both.
    """
    df = df.where(ref(target).isNotNull())
    cols = [*features, *([] if classification else [target])]
    stats, values = summarize(df, cols, [0.5], moments=0 if classification else 2), clean_values(df, cols)

    def scaled(c: str) -> Column:
        x = F.coalesce(values[c], F.lit(stats[c].quantiles.get(0.5, 0.0))).cast("double")
        if classification or not stats[c].n:
            return x
        spread = float(f"{(stats[c].m2 / stats[c].n) ** 0.5:.9g}")
        return x / F.lit(spread or 1.0)
    if not classification:
        df = df.where(values[target].isNotNull())
    y = ref(target).cast("string") if classification else scaled(target)
    wide = df.select(y.alias("y"), *[scaled(c).alias(f"_v{i}") for i, c in enumerate(features)])
    structs = [F.struct(F.lit(c).alias("feature"), F.col(f"_v{i}").alias("x")) for i, c in enumerate(features)]
    return wide.select("y", F.inline(F.array(*structs))).groupBy("feature", "y", "x").agg(F.count("*").alias("n"))


def _within(points: DataFrame, axis: str, rows: int) -> DataFrame:
    """``points`` (feature, r, n and the column ``axis``) with ``m_<axis>``: the points of the feature in the open interval of radius r.

    Where r is 0 these are the points with an equal value.  Interval ends join the values, sorted prefix sums count them.
    """
    low, high = F.col(axis) - F.col("r"), F.col(axis) + F.col("r")
    marks = points.select("feature", F.inline(F.array(
        F.struct(F.col(axis).alias("v"), F.col("n").alias("n")), F.struct(low.alias("v"), F.lit(0).cast("long").alias("n")),
        F.struct(high.alias("v"), F.lit(0).cast("long").alias("n")))))
    marks = marks.groupBy("feature", "v").agg(F.sum("n").alias("n"))
    upto = cut_lineage(running_totals(marks, ["feature"], "v", ["n"], 3 * rows))
    below = upto.select("feature", F.col("v").alias("_low"), F.col("n").alias("_same"), F.col("cum_n").alias("_upto"))
    above = upto.select("feature", F.col("v").alias("_high"), (F.col("cum_n") - F.col("n")).alias("_before"))
    found = points.withColumns({"_low": low, "_high": high}).join(below, ["feature", "_low"]).join(above, ["feature", "_high"])
    count = F.when(F.col("r") == 0, F.col("_same")).otherwise(F.col("_before") - F.col("_upto"))
    return found.withColumn(f"m_{axis}", count).drop("_low", "_high", "_same", "_upto", "_before")


def _class_radius(points: DataFrame, k: int, rows: int) -> DataFrame:
    """``points`` with ``size`` (of the class), ``k`` (neighbours used) and ``r``, the distance to the k-th other point of the class.

    Values of a class are numbered in order and dealt into stretches; the k values at both ends go to the stretches beside.
    """
    sizes = points.groupBy("feature", "y").agg(F.sum("n").alias("size"))
    points = points.join(sizes, ["feature", "y"]).where("size > 1").withColumn("one", F.lit(1).cast("long"))
    each = max(NEIGHBOUR_ROWS, 4 * k)
    at = running_totals(points, ["feature", "y"], "x", ["one"], rows).withColumn("_p", F.col("cum_one") - 1)
    part, inside = F.floor(F.col("_p") / each), F.col("_p") % each
    to = F.array_compact(F.array(
        F.struct(part.alias("part"), F.lit(True).alias("own")),
        F.when((inside < k) & (part > 0), F.struct((part - 1).alias("part"), F.lit(False).alias("own"))),
        F.when(inside >= each - k, F.struct((part + 1).alias("part"), F.lit(False).alias("own")))))
    placed = at.select("feature", "y", "x", "n", "size", F.inline(to))
    w = Window.partitionBy("feature", "y", "part").orderBy("x")
    near = [F.array_repeat(F.lit(0.0), F.least(F.col("n") - 1, F.lit(k)).cast("int"))]
    for i in range(1, k + 1):
        for step in (F.lag, F.lead):
            gap, many = F.abs(step("x", i).over(w) - F.col("x")), F.coalesce(step("n", i).over(w), F.lit(0))
            near.append(F.array_repeat(gap, F.least(many, F.lit(k)).cast("int")))
    used = F.least(F.lit(k), F.col("size") - 1).cast("int")
    placed = placed.withColumn("_near", F.sort_array(F.flatten(F.array(*near)))).where("own")
    return placed.withColumn("k", used).withColumn("r", F.get("_near", F.col("k") - 1)).select("feature", "y", "x", "n", "size", "k", "r")


def _joint_radius(points: DataFrame, features: Sequence[str], k: int) -> DataFrame:
    """``points`` with ``k`` and ``r``, the distance to the k-th other point by the larger of both coordinate differences."""
    out = None
    for f in features:
        own = points.where(F.col("feature") == f)
        total = own.agg(F.sum("n")).first()[0] or 0
        used = min(k, total - 1)
        if used < 1:
            continue
        # A point stands for its copies: the first neighbour found is the point itself.
        name = F.concat_ws(":", F.xxhash64(F.lit(1), "x", "y"), F.xxhash64(F.lit(2), "x", "y"))
        own = own.withColumn("q_id", name)
        copies = own.withColumn("copy", F.explode(F.sequence(F.lit(1), F.least(F.col("n"), F.lit(used + 1)).cast("int"))))
        near = knn_join(own.select(F.col("q_id").alias("id"), F.array("x", "y").alias("vec")),
                        copies.select(F.xxhash64("x", "y", "copy").alias("id"), F.array("x", "y").alias("vec")), used + 1, metric="chebyshev")
        far = near.groupBy("q_id").agg(F.max("distance").alias("r"))
        part = own.join(far, "q_id").select("feature", "y", "x", "n", F.lit(used).alias("k"), "r")
        out = part if out is None else out.unionByName(part)
    return out


def neighbour_information(df: DataFrame, features: Sequence[str], target: str, classification: bool, k: int = 3) -> DataFrame:
    """``(feature, mi)`` in nats from distances to the k-th nearest neighbour, at least 0.

    A class target: the distance is to the k-th other row of the class (all of a class with fewer), the count that of all
    rows strictly nearer, rows of classes with a single row being left out.  A numeric target: the distance is the larger
    of the differences in both (scaled) values, the counts are those of rows strictly nearer in either.  The row itself
    counts; at distance 0 the rows with an equal value do.  Nothing is drawn at random to break ties.  Gaps in a feature
    count as its median.  All rows count, copies as often as they stand there; a table with fewer than two usable rows
    gives 0.
    """
    points = cut_lineage(_points(df, features, target, classification))
    rows = points.count()
    if classification:
        found = _class_radius(points, k, rows)
        found = _within(cut_lineage(found), "x", rows)
        n = F.sum("n")
        mean = lambda c: F.sum(F.col("n") * digamma(c.cast("double"))) / n
        mi = digamma(n.cast("double")) + mean(F.col("k")) - mean(F.col("size")) - mean(F.col("m_x"))
    else:
        near = _joint_radius(points, features, k)
        if near is None:
            return df.sparkSession.createDataFrame([(f, 0.0) for f in features], "feature string, mi double")
        found = _within(_within(cut_lineage(near), "x", rows), "y", rows)
        n = F.sum("n")
        mean = lambda c: F.sum(F.col("n") * digamma(c.cast("double"))) / n
        mi = digamma(n.cast("double")) + mean(F.col("k")) - mean(F.col("m_x")) - mean(F.col("m_y"))
    known = found.groupBy("feature").agg(mi.alias("mi"))
    named = df.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return named.join(known, "feature", "left").select("feature", F.greatest(F.coalesce("mi", F.lit(0.0)), F.lit(0.0)).alias("mi"))
