"""Approximate nearest neighbours: coarse cells, several of them searched for each query, exact distances inside.

Centres of the cells are found on a bounded sample, every donor goes to the cell of its nearest centre.  A query visits
the cells whose centres are nearest (its probes).  Cells and their visitors meet in bounded blocks, distances are exact,
and the best of all blocks are merged, so the only error is a neighbour in a cell that was not visited.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.session import cut_lineage
from tabsmith.operators.trees import matrix

SAMPLE_ROWS = 20_000
DONOR_ROWS, QUERY_ROWS = 4096, 4096


def _centres(sample: np.ndarray, cells: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from spread-out starts; an empty cell takes the row that is worst off."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        gap = _gaps(sample, centres)
        nearest = gap.argmin(axis=1)
        counts = np.bincount(nearest, minlength=cells)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        worst = np.argsort(-gap[np.arange(len(sample)), nearest], kind="stable")
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
        empty = np.flatnonzero(counts == 0)
        centres[empty] = sample[worst[:len(empty)]]
    return centres


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((x * x).sum(axis=1)[:, None] + (y * y).sum(axis=1) - 2.0 * (x @ y.T), 0.0)


class CellIndex:
    """Donors by cell: the table (cell, id, vec), checkpointed, and the centres."""

    def __init__(self, donors: DataFrame, centres: np.ndarray):
        self.donors, self.centres = donors, centres
        self.sizes = {r["cell"]: r["n"] for r in donors.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row for each centre

    def nearest(self, probes: int):
        """Column function: the ``probes`` cells whose centres are nearest to a vector."""
        centres = self.centres

        @F.arrow_udf("array<int>")
        def cells(vectors: pa.Array) -> pa.Array:
            x = matrix(vectors, centres.shape[1])
            out = np.argsort(_gaps(x, centres), axis=1, kind="stable")[:, :probes].astype(np.int32)
            return pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, out.shape[1], dtype=np.int32)), pa.array(out.ravel()))
        return cells

    def search(self, queries: DataFrame, k: int, probes: int = 8, exclude_self: bool = False) -> DataFrame:
        """``(q_id, d_id, distance, rank)`` of the k nearest donors found for each query (id long, vec array<double>), ties by id.

        ``probes`` of all cells makes the search exact.  A query whose cells hold fewer than k donors gets fewer.
        """
        spark, probes = self.donors.sparkSession, min(probes, len(self.centres))
        schema = "q_id long, d_id long, distance double"
        if not len(self.centres):
            return spark.createDataFrame([], f"{schema}, rank int")
        asked = queries.select(F.col("id").cast("long").alias("q_id"), F.col("vec").cast("array<double>").alias("q_vec"))
        asked = cut_lineage(asked.withColumn("cell", F.explode(self.nearest(probes)("q_vec"))))
        load = {r["cell"]: r["n"] for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
        blocks = spark.createDataFrame(
            [(int(c), math.ceil(n / DONOR_ROWS), math.ceil(load[c] / QUERY_ROWS)) for c, n in self.sizes.items() if load.get(c)], "cell int, db int, qb int")
        # A row for each centre; a crowded cell is cut on both sides, and its parts meet pairwise.
        left = asked.join(F.broadcast(blocks), "cell").withColumn("qs", F.pmod(F.xxhash64("q_id"), F.col("qb")).cast("int")).withColumn(
            "ds", F.explode(F.sequence(F.lit(0), F.col("db") - 1))).select("cell", "ds", "qs", "q_id", "q_vec")
        right = self.donors.join(F.broadcast(blocks), "cell").withColumn("ds", F.pmod(F.xxhash64("id"), F.col("db")).cast("int")).withColumn(
            "qs", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).select(
            F.col("cell").alias("d_cell"), F.col("ds").alias("d_ds"), F.col("qs").alias("d_qs"), F.col("id").alias("d_id"), F.col("vec").alias("d_vec"))
        width = self.centres.shape[1]

        def best(q: pa.Table, d: pa.Table) -> pa.Table:
            out = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
            if len(q) and len(d):
                qi, di = q.column("q_id").to_numpy(), d.column("d_id").to_numpy()
                x, y = matrix(q.column("q_vec"), width), matrix(d.column("d_vec"), width)
                order = np.argsort(di, kind="stable")
                di, y = di[order], y[order]
                found = []
                for s in range(0, len(x), max(1, 2_000_000 // (len(y) * width))):
                    part = x[s:s + max(1, 2_000_000 // (len(y) * width))]
                    gap = np.sqrt(((part[:, None, :] - y[None]) ** 2).sum(axis=2))
                    if exclude_self:
                        gap[qi[s:s + len(part), None] == di] = np.inf
                    near = np.argsort(gap, axis=1, kind="stable")[:, :k]
                    row = np.repeat(np.arange(len(part)), near.shape[1])
                    found.append((qi[s + row], di[near.ravel()], gap[row, near.ravel()]))
                out = [np.concatenate(c) for c in zip(*found)]
                out = [c[np.isfinite(out[2])] for c in out]
            return pa.table([pa.array(c) for c in out], ["q_id", "d_id", "distance"])
        near = left.groupBy("cell", "ds", "qs").cogroup(right.groupBy("d_cell", "d_ds", "d_qs")).applyInArrow(best, schema)
        w = Window.partitionBy("q_id").orderBy("distance", "d_id")
        return near.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def probes_for(self, queries: DataFrame, k: int, share: float = 0.9) -> int:
        """The fewest probes with which ``share`` of the exact neighbours of ``queries`` are found.

        The queries are searched exactly, so a sample of those to come is what to give here.
        """
        exact = self.search(queries, k, len(self.centres)).select("q_id", F.col("d_id").alias("id"))
        order = queries.select(F.col("id").cast("long").alias("q_id"), self.nearest(len(self.centres))(F.col("vec").cast("array<double>")).alias("order"))
        placed = exact.join(self.donors.select("id", "cell"), "id").join(order, "q_id").select(F.array_position("order", F.col("cell")).alias("at"))
        counts = sorted((r["at"], r["n"]) for r in placed.groupBy("at").agg(F.count("*").alias("n")).collect())  # a row for each centre at most
        wanted, found = share * sum(n for _, n in counts), 0
        for at, n in counts:
            found += n
            if found >= wanted:
                return int(at)
        return 1


def cell_index(donors: DataFrame, cells: int | None = None, rounds: int = 8, seed: int = 42) -> CellIndex:
    """Index of all ``donors`` (id long, vec array<double> of one length, without gaps); the square root of their number is the usual ``cells``.

    The sample (``SAMPLE_ROWS`` rows with the smallest hashes) only shapes the cells.
    """
    rows = donors.select(F.col("id").cast("long").alias("id"), F.col("vec").cast("array<double>").alias("vec"))
    sample = np.array([r["vec"] for r in rows.orderBy(F.xxhash64("id")).limit(SAMPLE_ROWS).select("vec").collect()], float)
    if not len(sample):
        return CellIndex(rows.withColumn("cell", F.lit(0)), np.zeros((0, 0)))
    wanted = cells or math.ceil(math.sqrt(rows.count()))
    index = CellIndex.__new__(CellIndex)
    index.centres = _centres(sample, min(wanted, len(sample)), rounds, seed)
    return CellIndex(cut_lineage(rows.withColumn("cell", F.get(index.nearest(1)("vec"), F.lit(0)))), index.centres)


def recall(found: DataFrame, exact: DataFrame) -> float:
    """Share of the exact neighbours (q_id, d_id) that were found."""
    both = exact.select("q_id", "d_id").join(found.select("q_id", "d_id"), ["q_id", "d_id"], "left_semi").count()
    return both / max(1, exact.count())
