"""Blocks of the exact neighbour join: few copies of a row however many cells there are, and results as by brute force."""

import numpy as np
import pytest
from pyspark.sql import SparkSession

from tabsmith.operators import knn


def test_copies_do_not_grow_with_the_cells(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(1500, 24))  # boxes exclude nothing here
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").persist()
    made, plain = [], SparkSession.createDataFrame

    def spied(self, data, schema=None, *args, **kwargs):
        made.append((data, schema))
        return plain(self, data, schema, *args, **kwargs)
    monkeypatch.setattr(SparkSession, "createDataFrame", spied)
    got = {}
    for r in knn.knn_join(df, df, 5, exclude_self=True, cell_rows=8, query_rows=20).collect():
        got.setdefault(r["q_id"], {})[r["rank"]] = (r["d_id"], r["distance"])
    blocks = next(data for data, schema in made if "qb int" in schema)
    assert sum(row[1] for row in blocks) <= 24  # copies of a query; one for each of 128 cells before
    assert max(row[2] for row in blocks) <= 12  # copies of a donor; 75 before
    dist = knn.block_distances(x, x)
    np.fill_diagonal(dist, np.inf)
    for q in range(len(x)):
        best = np.argsort(dist[q], kind="stable")[:5]
        assert [got[q][i + 1] for i in range(5)] == list(zip(best.tolist(), dist[q][best].tolist()))


@pytest.mark.parametrize("kind", ["plain", "far from zero", "grid", "gaps", "infinite", "chebyshev"])
def test_block_equals_brute_force(kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(5000, 4)) + (1e7 if kind == "far from zero" else 0)
    if kind == "grid":
        x = np.round(2 * x)
    if kind in ("gaps", "infinite"):
        x[rng.random(x.shape) < 0.05] = np.nan if kind == "gaps" else np.inf
    metric = "chebyshev" if kind == "chebyshev" else "euclidean"
    block = knn._Block(x, np.arange(5000), np.sort(rng.integers(0, 9, 5000)), np.where(np.isfinite(x), x, 0).mean(axis=0), metric)
    with np.errstate(invalid="ignore"):
        row, at, gap = block.nearest(x[:300], np.arange(300), np.full(300, np.inf), 5)
        dist = knn.block_distances(x[:300], x, metric)
    dist[np.arange(300), np.arange(300)] = np.nan
    for q in range(300):
        ok = np.flatnonzero(~np.isnan(dist[q]))
        best = ok[np.lexsort((ok, dist[q][ok]))][:5]
        assert at[row == q].tolist() == best.tolist() and gap[row == q].tolist() == dist[q][best].tolist()
