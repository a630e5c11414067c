"""Exact order statistics and running totals that no single task has to hold.

``percentile`` keeps every distinct value of a column in one aggregation buffer,
and an un-bucketed window sorts a whole column in one task.  Both stop working on
big tables, so this module narrows value brackets by histograms instead:

1. every wanted rank starts with the bracket [min, max] of its column;
2. one aggregate splits the live brackets into bins, with count, min and max;
3. the bin that holds the rank becomes its new bracket; when min equals max the
   order statistic is known exactly.

A pass shuffles only bins (at most ``MAX_BINS`` rows), brackets shrink by the bin
count each time, and a column drops out of the scan as soon as it is resolved.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.expr import double_arrays, search_sorted_array, with_positions
from tabsmith.functions.session import BROADCAST_ROWS, BUCKET_ROWS, cut_lineage

MAX_BINS = 65_536
COLUMNS_PER_JOB = 24


class _Bracket:
    """Values in [lo, hi] whose first value has rank ``base``; ``ranks`` still to find."""

    __slots__ = ("lo", "hi", "base", "ranks")

    def __init__(self, lo: float, hi: float, base: int, ranks: Sequence[int]):
        self.lo, self.hi, self.base, self.ranks = lo, hi, base, sorted(ranks)


def _bins_for(brackets: int) -> int:
    return int(max(8, min(2048, MAX_BINS // max(1, brackets))))


def _narrow(live, found, counts):
    """Replace each live bracket by the bins that hold its ranks."""
    nxt = defaultdict(list)
    for g, brackets in live.items():
        for i, br in enumerate(brackets):
            base, pending = br.base, list(br.ranks)
            for _bin, n, lo, hi in sorted(counts.get((g, i), [])):
                inside = [r for r in pending if r < base + n]
                if inside:
                    pending = pending[len(inside):]
                    if lo == hi:
                        found[g].update({r: lo for r in inside})
                    else:
                        nxt[g].append(_Bracket(lo, hi, base, inside))
                base += n
                if not pending:
                    break
    return nxt


def _binned(df: DataFrame, bins: int) -> DataFrame:
    """``df`` has g, i, lo, hi, v; count, min and max per bin of each bracket."""
    width = F.greatest(F.col("hi") - F.col("lo"), F.lit(5e-324))
    pos = F.floor((F.col("v") - F.col("lo")) / width * bins)
    return (
        df.withColumn("b", F.least(pos, F.lit(bins - 1)).cast("int"))
        .groupBy("g", "i", "b")
        .agg(F.count("*").alias("n"), F.min("v").alias("mn"), F.max("v").alias("mx"))
    )


def _collect_bins(binned: DataFrame) -> dict:
    counts = defaultdict(list)
    for r in binned.collect():  # at most MAX_BINS rows by construction
        counts[(r["g"], r["i"])].append((r["b"], r["n"], r["mn"], r["mx"]))
    return counts


def _bracketed(df: DataFrame, values: Mapping[str, Column], live: Mapping[str, Sequence[_Bracket]]) -> DataFrame:
    """``(g, i, lo, hi, v)``: each value with its bracket, ``g`` the position of its column."""
    wide = df.select(*[v.alias(f"_v{g}") for g, v in enumerate(values.values())])
    wide = with_positions(wide, {f"_i{g}": (f"_v{g}", [b.lo for b in live[c]], True) for g, c in enumerate(values)})
    structs = [
        F.struct(F.lit(g).alias("g"), (F.col(f"_i{g}") - F.lit(1)).alias("i"), F.col(f"_v{g}").alias("v"))
        for g in range(len(values))
    ]
    found = wide.select(F.inline(F.array(*structs))).where(F.col("i") >= 0)
    lows = double_arrays([[float(b.lo) for b in live[c]] for c in values])
    highs = double_arrays([[float(b.hi) for b in live[c]] for c in values])
    return found.select(
        "g", "i", F.get(F.get(lows, "g"), F.col("i")).alias("lo"), F.get(F.get(highs, "g"), F.col("i")).alias("hi"), "v"
    ).where(F.col("v") <= F.col("hi"))


def column_order_statistics(
    df: DataFrame,
    values: Mapping[str, Column],
    ranks: Mapping[str, Sequence[int]],
    bounds: Mapping[str, tuple[float, float]],
) -> dict[str, dict[int, float]]:
    """Exact order statistics of several column expressions.

    ``ranks`` are zero-based among non-null values, ``bounds`` the min and max.
    """
    found: dict[str, dict[int, float]] = defaultdict(dict)
    names = [g for g in values if ranks.get(g)]
    for start in range(0, len(names), COLUMNS_PER_JOB):
        chunk = names[start:start + COLUMNS_PER_JOB]
        live = defaultdict(list)
        for g in chunk:
            lo, hi = bounds[g]
            wanted = sorted(set(ranks[g]))
            if lo == hi:
                found[g].update({r: lo for r in wanted})
            else:
                live[g].append(_Bracket(lo, hi, 0, wanted))
        while live:
            bins = _bins_for(sum(len(b) for b in live.values()))
            probe = _bracketed(df, {g: values[g] for g in live}, live)
            counts = _collect_bins(_binned(probe, bins))
            at = list(live)
            live = _narrow(live, found, {(at[g], i): rows for (g, i), rows in counts.items()})
    return found


def group_order_statistics(
    long: DataFrame, ranks: Mapping[str, Sequence[int]], bounds: Mapping[str, tuple[float, float]]
) -> dict[str, dict[int, float]]:
    """Exact order statistics per group of a long table ``(g string, v double)``.

    Groups go together as long as their brackets, one a rank at most, stay a table that may be broadcast.
    """
    found: dict[str, dict[int, float]] = defaultdict(dict)
    part: dict[str, Sequence[int]] = {}
    size = 0
    for g, wanted in ranks.items():
        if size and size + len(wanted) > BROADCAST_ROWS:
            found.update(_group_order_statistics(long, part, bounds))
            part, size = {}, 0
        part[g] = wanted
        size += len(wanted)
    found.update(_group_order_statistics(long, part, bounds))
    return found


def _group_order_statistics(
    long: DataFrame, ranks: Mapping[str, Sequence[int]], bounds: Mapping[str, tuple[float, float]]
) -> dict[str, dict[int, float]]:
    found: dict[str, dict[int, float]] = defaultdict(dict)
    live = defaultdict(list)
    for g, wanted in ranks.items():
        lo, hi = bounds[g]
        wanted = sorted(set(wanted))
        if not wanted:
            continue
        if lo == hi:
            found[g].update({r: lo for r in wanted})
        else:
            live[g].append(_Bracket(lo, hi, 0, wanted))
    spark = long.sparkSession
    while live:
        total = sum(len(b) for b in live.values())
        bins = _bins_for(total)
        table = spark.createDataFrame(
            [(g, [float(b.lo) for b in bs], [float(b.hi) for b in bs]) for g, bs in live.items()],
            "g string, lows array<double>, highs array<double>",
        )
        longest = max(len(b) for b in live.values())
        joined = long.join(F.broadcast(table), "g")  # the caller bounds the brackets
        if longest == 1:
            i = F.when(F.col("v") >= F.get("lows", F.lit(0)), F.lit(0)).otherwise(F.lit(-1))
        else:
            i = search_sorted_array(F.col("v"), F.col("lows"), longest) - F.lit(1)
        probe = (
            joined.withColumn("i", i)
            .where(F.col("i") >= 0)
            .select("g", "i", F.get("lows", "i").alias("lo"), F.get("highs", "i").alias("hi"), "v")
            .where(F.col("v") <= F.col("hi"))
        )
        live = _narrow(live, found, _collect_bins(_binned(probe, bins)))
    return found


def quantile_ranks(n: int, prob: float) -> tuple[int, int, float]:
    """Lower rank, upper rank and weight of the linear-interpolation quantile."""
    h = (n - 1) * prob
    lo = min(int(math.floor(h)), n - 1)
    return lo, min(lo + 1, n - 1), h - lo


def column_quantiles(
    df: DataFrame,
    values: Mapping[str, Column],
    counts: Mapping[str, int],
    bounds: Mapping[str, tuple[float, float]],
    probs: Sequence[float],
) -> dict[str, dict[float, float]]:
    """Exact interpolated quantiles of several columns, as ``{column: {prob: value}}``."""
    ranks = {}
    for g in values:
        n = counts.get(g, 0)
        if n:
            ranks[g] = sorted({r for p in probs for r in quantile_ranks(n, p)[:2]})
    stats = column_order_statistics(df, {g: values[g] for g in ranks}, ranks, bounds)
    out: dict[str, dict[float, float]] = {}
    for g in ranks:
        out[g] = {}
        for p in probs:
            lo, hi, w = quantile_ranks(counts[g], p)
            a, b = stats[g][lo], stats[g][hi]
            out[g][p] = a + (b - a) * w
    return out


def running_totals(
    df: DataFrame,
    group: Sequence[str],
    value: str,
    weights: Sequence[str],
    rows: int,
    bucket_rows: int = BUCKET_ROWS,
) -> DataFrame:
    """Add ``cum_<w>``: the sum of ``w`` over rows of the group with value <= this value.

    ``df`` must have one row per (group, value), so a hot value is a single row.
    ``rows`` is an upper bound of its size.  Above ``bucket_rows`` the values are cut
    into ordered buckets (edges from a mergeable sketch, so any edges give the same
    result), and a bucket's offset is added to the running sum inside it.
    """
    keys = list(group)
    buckets = int(min(4096, math.ceil(rows / max(1, bucket_rows))))
    if buckets <= 1:
        w = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(w).alias(f"cum_{c}") for c in weights])

    levels = [i / buckets for i in range(1, buckets)]
    edges = df.groupBy(*keys).agg(F.percentile_approx(value, levels, 10_000).alias("_edges"))
    # One row per group; a group is a column name or a class label.  Very many groups are joined instead.
    edges = cut_lineage(edges)
    small = edges.count() * buckets <= BROADCAST_ROWS * 10
    spread = F.broadcast if small else (lambda t: t)
    placed = (
        df.join(spread(edges), keys)
        .withColumn("_bucket", search_sorted_array(F.col(value), F.col("_edges"), buckets, inclusive=False))
        .drop("_edges")
    )
    totals = placed.groupBy(*keys, "_bucket").agg(*[F.sum(c).alias(f"_t_{c}") for c in weights])
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_bucket", *[F.coalesce(F.sum(f"_t_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in weights]
    )
    inside = Window.partitionBy(*keys, "_bucket").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(spread(offsets), [*keys, "_bucket"])
    return joined.select(
        *df.columns, *[(F.sum(c).over(inside) + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in weights]
    )
