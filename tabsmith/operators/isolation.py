"""Isolation forest: trees from small samples, every row scored by the broadcast forest."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.functions.expr import row_key
from tabsmith.operators.order_stats import column_order_statistics
from tabsmith.operators.stats import clean_values

HASH_SPAN = 1 << 31
TREE = "tree int, node int, dim int, cut double, size long"


def _expected_depth(n: float) -> float:
    """Mean depth of an unsuccessful search in a tree of n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1.0) + 0.5772156649015329) - 2.0 * (n - 1.0) / n


def _grow_tree(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple[int, int, float, int]]:
    """Nodes (heap index, dimension or -1, cut, rows) of one random tree."""
    nodes, todo = [], [(0, x, 0)]
    while todo:
        node, rows, depth = todo.pop()
        lo, hi = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
        live = np.flatnonzero(hi > lo)
        if depth >= limit or len(rows) <= 1 or not len(live):
            nodes.append((node, -1, 0.0, len(rows)))
            continue
        d = int(rng.choice(live))
        cut = float(rng.uniform(lo[d], hi[d]))
        nodes.append((node, d, cut, len(rows)))
        right = rows[:, d] > cut
        todo.append((2 * node + 1, rows[~right], depth + 1))
        todo.append((2 * node + 2, rows[right], depth + 1))
    return nodes


class IsolationForest:
    """``fit`` samples ``sample`` rows per tree by hash; a tree is grown in one small group."""

    def __init__(self, cols: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42):
        self.cols, self.trees, self.sample, self.seed = list(cols), trees, sample, seed
        self.forest: list[tuple[np.ndarray, ...]] = []
        self.size = sample

    def _numbers(self, df: DataFrame):
        values = clean_values(df, self.cols)
        return F.array(*[F.coalesce(values[c], F.lit(0.0)) for c in self.cols])

    def fit(self, df: DataFrame) -> "IsolationForest":
        rows = df.count()
        self.size = min(self.sample, rows)
        base = df.select(self._numbers(df).alias("x"), row_key(self.cols, self.seed).alias("k"))
        total = self.trees * self.sample
        if rows > 8 * total:
            # Thin by hash first, so that only about 8 rows per wanted row meet the trees.
            keep = int(HASH_SPAN * min(1.0, 8.0 * total / rows))
            base = base.where(F.pmod("k", F.lit(HASH_SPAN)) < keep)
            rows = max(1, base.count())
        share = int(HASH_SPAN * min(1.0, 3.0 * self.sample / rows))
        draw = F.pmod(F.xxhash64("k", F.col("tree")), F.lit(HASH_SPAN))
        drawn = (
            base.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(self.trees - 1))))
            .withColumn("draw", draw).where(F.col("draw") <= share)
        )
        # Rows equal in every column share their hash, so rows are picked by rank.
        w = Window.partitionBy("tree").orderBy("draw", "k")
        picked = drawn.withColumn("r", F.row_number().over(w)).where(F.col("r") <= self.sample)
        limit = int(math.ceil(math.log2(max(self.size, 2))))
        seed = self.seed

        def grow(key, pdf: pd.DataFrame) -> pd.DataFrame:
            x = np.array([np.array(v, float) for v in pdf.sort_values(["draw", "k"])["x"]])
            nodes = _grow_tree(x, np.random.default_rng([seed, int(key[0])]), limit)
            out = pd.DataFrame(nodes, columns=["node", "dim", "cut", "size"])
            out.insert(0, "tree", int(key[0]))
            return out

        grown = picked.groupBy("tree").applyInPandas(grow, TREE).toPandas()  # trees x 2 x sample nodes at most
        self.forest = []
        for _, t in grown.groupby("tree"):
            t = t.sort_values("node")
            self.forest.append((t["node"].to_numpy(), t["dim"].to_numpy(), t["cut"].to_numpy(),
                                np.array([_expected_depth(s) for s in t["size"]])))
        return self

    def score(self, df: DataFrame, name: str = "anomaly") -> DataFrame:
        """Add the anomaly score in (0, 1]; higher is more isolated."""
        forest, norm = self.forest, _expected_depth(self.size) or 1.0

        @F.pandas_udf(T.DoubleType())
        def anomaly(vectors: pd.Series) -> pd.Series:
            x = np.array([np.array(v, float) for v in vectors])
            depth = np.zeros(len(x))
            rows = np.arange(len(x))
            for node, dim, cut, extra in forest:
                at = np.zeros(len(x), dtype=int)
                level = np.zeros(len(x))
                active = rows
                while len(active):
                    pos = np.searchsorted(node, at[active])
                    leaf = dim[pos] < 0
                    done = active[leaf]
                    level[done] += extra[pos[leaf]]
                    active, pos = active[~leaf], pos[~leaf]
                    right = x[active, dim[pos]] > cut[pos]
                    at[active] = 2 * at[active] + 1 + right
                    level[active] += 1
                depth += level
            return pd.Series(2.0 ** (-(depth / len(forest)) / norm))

        return df.withColumn(name, anomaly(self._numbers(df)))


def mark_outliers(df: DataFrame, cols: Sequence[str], contamination: float = 0.05, trees: int = 100, seed: int = 42,
                  name: str = "is_outlier") -> DataFrame:
    """Add a boolean: the ``contamination`` share of rows with the highest anomaly score.

    The cut is an exact order statistic of all scores.
    """
    forest = IsolationForest(cols, trees, seed=seed).fit(df)
    scored = forest.score(df, "_anomaly")
    r = scored.agg(F.count("*").alias("n"), F.min("_anomaly").alias("lo"), F.max("_anomaly").alias("hi")).first()
    if not r["n"]:
        return scored.withColumn(name, F.lit(False)).drop("_anomaly")
    at = max(0, r["n"] - int(round(contamination * r["n"])) - 1)
    cut = column_order_statistics(scored, {"s": F.col("_anomaly")}, {"s": [at]}, {"s": (r["lo"], r["hi"])})["s"][at]
    return scored.withColumn(name, F.col("_anomaly") > F.lit(cut)).drop("_anomaly")
