"""Approximate neighbours: exact with all cells, recall with some, odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabsmith.operators import near
from tabsmith.operators.knn import knn_join


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(9)
    x = np.vstack([rng.normal(c, 1.0, size=(60, 6)) for c in rng.normal(0, 4, size=(20, 6))])
    x[5] = x[4]  # equal rows, ties by id
    return spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id long, vec array<double>").repartition(4).persist()


def rows(df):
    return sorted((r["q_id"], r["rank"], r["d_id"], round(r["distance"], 9)) for r in df.collect())


def test_all_cells_are_exact(vectors, monkeypatch):
    monkeypatch.setattr(near, "DONOR_ROWS", 37)
    monkeypatch.setattr(near, "QUERY_ROWS", 50)
    index = near.cell_index(vectors, 12)
    queries = vectors.where("id % 50 = 0 or id in (4, 5)")
    for own in (False, True):
        got = index.search(queries, 7, probes=12, exclude_self=own)
        assert rows(got) == rows(knn_join(queries, vectors, 7, exclude_self=own))


def test_some_cells_find_most(spark, vectors, sf_dir):
    index = near.cell_index(vectors)
    queries = vectors.where("id % 50 = 0")
    exact = knn_join(queries, vectors, 10)
    assert len(index.centres) == 35 and sum(index.sizes.values()) == 1200
    shares = [near.recall(index.search(queries, 10, probes=p), exact) for p in (1, 4, 35)]
    assert shares[0] < shares[1] + 1e-9 and shares[1] >= 0.9 and shares[2] == 1.0


def test_embeddings_recall(spark, sf_dir):
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("vec"))
    queries = table.where("id % 50 = 0")
    index = near.cell_index(table)
    probes = index.probes_for(queries, 10, 0.9)
    exact = knn_join(queries, table, 10)
    assert near.recall(index.search(queries, 10, probes), exact) >= 0.9 and 1 < probes < len(index.centres)
    assert near.recall(index.search(queries, 10, probes - 1), exact) < 0.9


def test_few_and_no_donors(vectors):
    few = near.cell_index(vectors.where("id < 3"), 10)
    assert len(few.centres) == 3 and few.search(vectors.where("id < 5"), 9, probes=3).count() == 15
    none = near.cell_index(vectors.where("id < 0"))
    assert none.search(vectors, 3).count() == 0
    assert few.search(vectors.where("id < 0"), 3).count() == 0
