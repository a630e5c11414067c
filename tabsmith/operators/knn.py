"""Exact nearest neighbours without comparing all pairs.

Donors are cut into cells of about ``CELL_ROWS`` rows by a k-d tree that is grown on a
small sample; the sample only shapes the cells and never decides a result.  Each cell has
a bounding box.  For a query, the boxes give an upper bound of its k-th distance; cells
whose nearest possible point is farther are skipped.  Neighbouring cells are put together
into groups, and a query goes once to each group in which it has cells left, not once to
each cell.  The rest is an equi-join on (group, donor block, query block): a task sees at
most one block of each side, however crowded a cell is, and a row is copied at most
``PARTS`` times until a block has ``PART_NUMBERS`` numbers.  Inside a block, distances that
may matter are found by matrix products with a bound of their rounding errors and then
computed exactly.  The k best per block are merged per query.

Distances are euclidean over coordinates present on both sides, scaled up by
total / shared coordinates, so vectors may have gaps; or, by ``metric="chebyshev"``, the
largest difference of a coordinate present on both sides.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.session import cut_lineage
from tabsmith.operators.trees import matrix

CELL_ROWS = 2048
QUERY_ROWS = 4096
MAX_CELLS = 4096
# Numbers in the corners of all boxes.
BOX_NUMBERS = 65_536
SAMPLE_ROWS = 20_000
PARTS = 12
PART_NUMBERS = 1 << 22
# Rows of either side that a task compares at once.
STEP_ROWS, CHUNK_ROWS = 512, 2048


def _grow(sample: np.ndarray, depth: int):
    """Split dimension and threshold per inner node of a complete tree, in heap order."""
    dims = np.zeros((1 << depth) - 1, dtype=int)
    cuts = np.zeros((1 << depth) - 1)
    groups = {0: sample}
    for node in range((1 << depth) - 1):
        rows = groups.pop(node)
        if len(rows) > 1:
            spread = np.nan_to_num(np.nanvar(rows, axis=0)) if np.isfinite(rows).any() else np.zeros(rows.shape[1])
            d = int(np.argmax(spread))
            column = rows[:, d]
            cut = float(np.nanmedian(column)) if np.isfinite(column).any() else 0.0
        else:
            d, cut = 0, 0.0
        dims[node], cuts[node] = d, cut
        right = rows[:, d] > cut  # gaps go left
        groups[2 * node + 1], groups[2 * node + 2] = rows[~right], rows[right]
    return dims, cuts


def _cells_of(x: np.ndarray, dims: np.ndarray, cuts: np.ndarray, depth: int) -> np.ndarray:
    node = np.zeros(len(x), dtype=int)
    rows = np.arange(len(x))
    for _ in range(depth):
        right = x[rows, dims[node]] > cuts[node]
        node = 2 * node + 1 + right
    return node - ((1 << depth) - 1)


def block_distances(q: np.ndarray, d: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of every query to every donor of one block; NaN where nothing is shared."""
    out = np.empty((len(q), len(d)))
    dims = q.shape[1]
    gaps = np.isnan(q).any() or np.isnan(d).any()
    step = max(1, 4_000_000 // max(1, len(d) * dims))
    for s in range(0, len(q), step):
        diff = q[s:s + step, None, :] - d[None, :, :]
        if metric == "chebyshev":
            ok = ~np.isnan(diff)
            out[s:s + step] = np.where(ok.any(axis=2), np.where(ok, np.abs(diff), -np.inf).max(axis=2), np.nan)
        elif gaps:
            ok = ~np.isnan(diff)
            n = ok.sum(axis=2)
            total = np.where(ok, diff * diff, 0.0).sum(axis=2)
            with np.errstate(divide="ignore", invalid="ignore"):
                out[s:s + step] = np.sqrt(np.where(n > 0, total * dims / n, np.nan))
        else:
            out[s:s + step] = np.sqrt((diff * diff).sum(axis=2))
    return out


def _near(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, holes: np.ndarray, metric: str) -> np.ndarray:
    """Least possible distance (squared if euclidean) of every query to the donors of every box."""
    seen = ~np.isnan(q)
    v = np.where(seen, q, 0.0)[:, None, :]
    near = np.fmax(np.fmax(lo[None] - v, v - hi[None]), 0.0)  # the difference of two infinities says nothing
    near[~seen[:, None, :] | holes[None]] = 0.0
    if metric == "chebyshev":
        return near.max(axis=2, initial=0.0)
    return (near * near).sum(axis=2) * q.shape[1] / np.maximum(seen.sum(axis=1), 1)[:, None]


def _far(q: np.ndarray, lo: np.ndarray, hi: np.ndarray, metric: str) -> np.ndarray:
    """Greatest possible distance (squared if euclidean) of every query to the complete donors of every box."""
    seen = ~np.isnan(q)
    v = np.where(seen, q, 0.0)[:, None, :]
    far = np.maximum(np.abs(v - lo[None]), np.abs(hi[None] - v))
    far[np.isnan(far)] = np.inf
    far[~np.broadcast_to(seen[:, None, :], far.shape)] = 0.0
    if metric == "chebyshev":
        return far.max(axis=2, initial=0.0)
    return (far * far).sum(axis=2) * q.shape[1] / np.maximum(seen.sum(axis=1), 1)[:, None]


def _slack(bound: np.ndarray) -> np.ndarray:
    return bound * (1 + 1e-9) + 1e-12


def _visits(x: np.ndarray, boxes: dict, k: int, metric: str = "euclidean") -> tuple[list[np.ndarray], np.ndarray]:
    """Groups whose cells can hold one of the k nearest donors of each query, and the bound of its k-th distance."""
    lo, hi, holes, full = boxes["lo"], boxes["hi"], boxes["holes"], boxes["full"]
    first = np.flatnonzero(np.concatenate(([True], boxes["group"][1:] != boxes["group"][:-1])))
    out, bounds = [], []
    step = max(1, 500_000 // max(1, lo.size))
    for s in range(0, len(x), step):
        q = x[s:s + step]
        # Only complete donors count towards the upper bound.
        far = _far(q, lo, hi, metric)
        order = np.argsort(far, axis=1, kind="stable")
        enough = np.cumsum(full[order], axis=1) >= k
        at = order[np.arange(len(q)), enough.argmax(axis=1)]
        bound = _slack(np.where(enough[:, -1], far[np.arange(len(q)), at], np.inf))
        near = np.minimum.reduceat(_near(q, lo, hi, holes, metric), first, axis=1)
        out += [boxes["group"][first[row]].astype(np.int32) for row in near <= bound[:, None]]
        bounds.append(bound)
    return out, np.concatenate(bounds or [np.zeros(0)])


def _pack(x: np.ndarray) -> pa.Array:
    """Rows as bytes, of single precision if that loses nothing."""
    with np.errstate(over="ignore"):
        single = x.astype(np.float32)
    x = np.ascontiguousarray(single if np.array_equal(single, x, equal_nan=True) else x)
    ends = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(ends), pa.py_buffer(x)])


def _unpack(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    out, at = np.empty((len(rows), width)), 0
    for row in rows.to_pylist():
        out[at] = np.frombuffer(row, np.float32 if len(row) == 4 * width else np.float64)
        at += 1
    return out


def _chunks(cell: np.ndarray) -> list[tuple[int, int]]:
    """Runs of about ``CHUNK_ROWS`` rows in order of cell, which end where a cell does if they can."""
    edges = np.append(np.flatnonzero(np.diff(cell)) + 1, len(cell)).tolist()
    out, at = [], 0
    for end in edges:
        while end - at > 2 * CHUNK_ROWS:
            out.append((at, at + CHUNK_ROWS))
            at += CHUNK_ROWS
        if end - at >= CHUNK_ROWS or end == len(cell):
            out.append((at, end))
            at = end
    return out


class _Block:
    """Donors of one block in order of cell, with the boxes of its chunks."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, cell: np.ndarray, centre: np.ndarray, metric: str):
        self.x, self.ids, self.metric, self.centre = x, ids, metric, centre
        self.chunks = _chunks(cell)
        gap = np.isnan(x)
        at = [a for a, _ in self.chunks]
        self.holes = np.logical_or.reduceat(gap, at, axis=0)
        self.lo = np.minimum.reduceat(np.where(gap, np.inf, x), at, axis=0)
        self.hi = np.maximum.reduceat(np.where(gap, -np.inf, x), at, axis=0)
        self.plain = metric == "euclidean" and bool(np.isfinite(x).all())
        if self.plain:
            y = x - centre
            norms = (y * y).sum(axis=1)
            self.reach, self.size = math.sqrt(norms.max()), float(np.abs(x).max(initial=0.0))
            # Products give q * d - d * d / 2, which falls as the distance grows.
            self.long = np.hstack([y, -norms[:, None] / 2])
            self.single = self.long.astype(np.float32) if self.reach < 1e15 else None

    def nearest(self, q: np.ndarray, own: np.ndarray | None, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, donor, distance) of the k nearest donors within the bounds, by query, distance and id."""
        near = _near(q, self.lo, self.hi, self.holes, self.metric)
        plain = self.plain and bool(np.isfinite(q).all())
        if plain:
            y = q - self.centre
            norms = (y * y).sum(axis=1)
            reach, size = np.maximum(np.sqrt(norms), self.reach), max(self.size, float(np.abs(q).max(initial=0.0)))
            single = self.single is not None and reach.max() < 1e15
            side = self.single if single else self.long
            y = np.hstack([y, np.ones((len(y), 1))]).astype(side.dtype)
            width = q.shape[1]
            # Rounding of a product of this width, of the norms and of the centring.
            error = (width + 16) * 2.0 ** (-22 if single else -51) * reach * reach + width * 2.0 ** -49 * size * math.sqrt(width) * reach + 1e-30
        bound = bound.copy()
        row, at, gap = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        wanted = k + (own is not None)
        for c in np.argsort(near.mean(axis=0), kind="stable").tolist():
            start, end = self.chunks[c]
            rows = np.flatnonzero(near[:, c] <= bound)
            if not len(rows):
                continue
            all_rows = len(rows) == len(q)
            if plain:
                score = (y if all_rows else y[rows]) @ side[start:end].T
                least = np.where(np.isfinite(bound[rows]), (norms[rows] - bound[rows]) / 2 - error[rows], -np.inf)
                hit = score >= _down(least, score.dtype)[:, None]
                if wanted < end - start and np.count_nonzero(hit) > 16 * wanted * len(rows):
                    top = np.partition(score, end - start - wanted, axis=1)[:, end - start - wanted]
                    hit = score >= _down(np.maximum(least, top.astype(float) - 2 * error[rows]), score.dtype)[:, None]
                i, j = np.nonzero(hit)
                found = np.empty(len(i))
                step = max(1, 2_000_000 // q.shape[1])
                for s in range(0, len(i), step):
                    diff = q[rows[i[s:s + step]]] - self.x[start + j[s:s + step]]
                    found[s:s + step] = np.sqrt((diff * diff).sum(axis=1))
            else:
                dist = block_distances(q[rows], self.x[start:end], self.metric)
                limit = _slack(np.sqrt(bound[rows]) if self.metric == "euclidean" else bound[rows])
                hit = dist <= limit[:, None]
                if wanted < end - start and np.count_nonzero(hit) > 16 * wanted * len(rows):
                    hit &= dist <= np.partition(np.where(np.isnan(dist), np.inf, dist), wanted - 1, axis=1)[:, wanted - 1:wanted]
                i, j = np.nonzero(hit)
                found = dist[i, j]
            i, j = rows[i], j + start
            if own is not None:
                other = own[i] != self.ids[j]
                i, j, found = i[other], j[other], found[other]
            if not len(i):
                continue
            row, at, gap = np.concatenate([row, i]), np.concatenate([at, j]), np.concatenate([gap, found])
            order = np.lexsort((self.ids[at], gap, row))
            row, at, gap = row[order], at[order], gap[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            last = rank == k - 1
            reached = gap[last] ** 2 if self.metric == "euclidean" else gap[last]
            bound[row[last]] = np.minimum(bound[row[last]], _slack(reached))
            row, at, gap = row[rank < k], at[rank < k], gap[rank < k]
        return row, at, gap


def _down(x: np.ndarray, kind) -> np.ndarray:
    """``x`` in another precision, never above it."""
    return np.nextafter(x.astype(kind), kind.type(-np.inf))


def knn_join(queries: DataFrame, donors: DataFrame, k: int, exclude_self: bool = False,
             cell_rows: int = CELL_ROWS, query_rows: int = QUERY_ROWS, metric: str = "euclidean") -> DataFrame:
    """``(q_id, d_id, distance, rank)`` of the k nearest donors of each query, ties by id.

    Inputs have ``id`` (a long on the donor side) and ``vec array<double>``; rows without a vector are left out.
    ``exclude_self`` skips the donor with the query's own id.  A ``value double`` column of
    the donors is passed through to the result.  ``cell_rows`` and ``query_rows`` are the rows
    of a cell and of a query block; in large tables blocks grow until they have ``PART_NUMBERS`` numbers.
    """
    spark = donors.sparkSession
    wanted = k + (1 if exclude_self else 0)
    extra = ["value"] if "value" in donors.columns else []
    donors = donors.where("vec is not null").select(F.col("id").alias("d_id"), F.col("vec").cast("array<double>").alias("d_vec"), *extra)
    queries = queries.where("vec is not null").select(F.col("id").alias("q_id"), F.col("vec").cast("array<double>").alias("q_vec"))
    # Of identical donors only the first ``wanted`` ids can ever be used; Spark applies the
    # limit per task before the shuffle, so a vector repeated very often stays cheap.
    copies = Window.partitionBy(F.xxhash64("d_vec"), "d_vec").orderBy("d_id")
    donors = cut_lineage(donors.withColumn("_c", F.row_number().over(copies)).where(F.col("_c") <= wanted).drop("_c"))

    n = donors.count()
    q_type = queries.schema["q_id"].dataType.simpleString()
    schema = f"q_id {q_type}, d_id long, distance double" + (", value double" if extra else "")
    if n == 0:
        return spark.createDataFrame([], schema + ", rank int")
    sample = donors.orderBy(F.xxhash64("d_id")).limit(SAMPLE_ROWS).select("d_vec").toArrow().column("d_vec")  # bounded
    width = len(sample[0])
    points = matrix(sample, width)
    most = max(1, min(MAX_CELLS, BOX_NUMBERS // max(1, width)))
    depth = int(min(math.ceil(math.log2(max(1, n / cell_rows))), math.floor(math.log2(most)))) if n > cell_rows else 0
    dims, cuts = _grow(points, depth)
    usable = np.isfinite(points)
    centre = np.where(usable, points, 0.0).sum(axis=0) / np.maximum(usable.sum(axis=0), 1)
    centre = np.where(np.isfinite(centre), centre, 0.0)

    @F.arrow_udf("int")
    def cell(vectors: pa.Array) -> pa.Array:
        return pa.array(_cells_of(matrix(vectors, width), dims, cuts, depth).astype("int32"))

    @F.arrow_udf("binary")
    def pack(vectors: pa.Array) -> pa.Array:
        return _pack(matrix(vectors, width))

    placed = donors.withColumn("cell", cell("d_vec"))
    sizes = {r["cell"]: (r["n"], r["full"]) for r in placed.groupBy("cell").agg(
        F.count("*").alias("n"),
        F.count_if(F.size(F.filter("d_vec", lambda v: v.isNull() | F.isnan(v))) == 0).alias("full")).collect()}
    ids = np.array(sorted(sizes))
    lo, hi = np.full((len(ids), width), 0.0), np.full((len(ids), width), 0.0)
    holes = np.ones((len(ids), width), dtype=bool)
    at = {c: i for i, c in enumerate(ids)}
    spans = (
        placed.select("cell", F.posexplode("d_vec").alias("dim", "v"))
        .where(F.col("v").isNotNull() & ~F.isnan("v"))
        .groupBy("cell", "dim").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    )
    for r in spans.collect():  # cells x dimensions, at most about ``BOX_NUMBERS``
        i = at[r["cell"]]
        lo[i, r["dim"]], hi[i, r["dim"]] = r["lo"], r["hi"]
        holes[i, r["dim"]] = r["n"] < sizes[r["cell"]][0]

    # Neighbouring cells go together; a cell of more rows than a block is cut into several.
    room = max(1, PART_NUMBERS // max(1, width))
    block_rows = min(max(cell_rows, math.ceil(n / PARTS)), room)
    group, group_rows = [], []
    for c in ids:
        if not group_rows or group_rows[-1] + sizes[c][0] > block_rows:
            group_rows.append(0)
        group_rows[-1] += sizes[c][0]
        group.append(len(group_rows) - 1)
    boxes = {"lo": lo, "hi": hi, "holes": holes, "group": np.array(group), "full": np.array([sizes[c][1] for c in ids])}

    @F.arrow_udf("struct<groups: array<int>, bound: double>")
    def visits(vectors: pa.Array) -> pa.Array:
        groups, bounds = _visits(matrix(vectors, width), boxes, wanted, metric)
        return pa.StructArray.from_arrays([pa.array(groups, pa.list_(pa.int32())), pa.array(bounds)], ["groups", "bound"])

    asked = cut_lineage(queries.select("q_id", pack("q_vec").alias("q_vec"), visits("q_vec").alias("ask")))
    asked = asked.select("q_id", "q_vec", F.col("ask.bound").alias("bound"), F.explode("ask.groups").alias("grp"))
    load = {r["grp"]: r["n"] for r in asked.groupBy("grp").agg(F.count("*").alias("n")).collect()}  # a row for each group
    part_rows = min(max(query_rows, math.ceil(max(load.values(), default=0) / PARTS)), room)
    shape = {g: (math.ceil(group_rows[g] / block_rows), math.ceil(load[g] / part_rows)) for g in load}
    blocks = spark.createDataFrame([(g, *shape[g]) for g in sorted(shape)], "grp int, db int, qb int")
    cells = spark.createDataFrame([(int(c), g, *shape[g]) for c, g in zip(ids, group) if g in shape], "cell int, grp int, db int, qb int")
    # Both have at most MAX_CELLS rows.
    left = asked.join(F.broadcast(blocks), "grp").withColumn(
        "qs", F.pmod(F.xxhash64("q_id"), F.col("qb")).cast("int")).withColumn(
        "ds", F.explode(F.sequence(F.lit(0), F.col("db") - 1))).select("grp", "ds", "qs", "q_id", "q_vec", "bound")
    right = placed.select("d_id", "cell", pack("d_vec").alias("d_vec"), *extra).join(F.broadcast(cells), "cell").withColumn(
        "ds", F.pmod(F.xxhash64("d_id"), F.col("db")).cast("int")).withColumn(
        "qs", F.explode(F.sequence(F.lit(0), F.col("qb") - 1))).select("grp", "ds", "qs", "d_id", "cell", "d_vec", *extra)

    def nearest(q: pa.Table, d: pa.Table) -> pa.Table:
        row, at, gap = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if len(q) and len(d):
            d = d.sort_by([("cell", "ascending"), ("d_id", "ascending")])
            block = _Block(_unpack(d.column("d_vec"), width), d.column("d_id").to_numpy(), d.column("cell").to_numpy(), centre, metric)
            x, bound = _unpack(q.column("q_vec"), width), q.column("bound").to_numpy()
            own = q.column("q_id").to_numpy() if exclude_self else None
            for s in range(0, len(x), STEP_ROWS):
                part = slice(s, s + STEP_ROWS)
                found = block.nearest(x[part], own[part] if exclude_self else None, bound[part], k)
                for kept, new in zip((row, at, gap), (found[0] + s, *found[1:])):
                    kept.append(new)
        row, at, gap = (np.concatenate(c) for c in (row, at, gap))
        columns = [q.column("q_id").take(pa.array(row)), d.column("d_id").take(pa.array(at)), pa.array(gap)]
        return pa.table([*columns, *(d.column(c).take(pa.array(at)) for c in extra)], ["q_id", "d_id", "distance", *extra])

    keys = ["grp", "ds", "qs"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(nearest, schema)
    best = Window.partitionBy("q_id").orderBy("distance", "d_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def knn_classify(queries: DataFrame, train: DataFrame, k: int = 5, weights: str = "uniform",
                 exclude_self: bool = False, **sizes) -> DataFrame:
    """``(id, prediction, votes)``: the class with the largest vote, ties to the smaller class.

    ``train`` has ``id, vec, label``.  ``weights='distance'`` votes by 1 / distance.
    """
    pairs = _labelled(queries, train, k, weights, exclude_self, sizes)
    votes = pairs.groupBy("id", "label").agg(F.sum("w").alias("votes"))
    best = Window.partitionBy("id").orderBy(F.desc("votes"), "label")
    return votes.withColumn("_r", F.row_number().over(best)).where("_r = 1").select(
        "id", F.col("label").alias("prediction"), "votes")


def knn_regress(queries: DataFrame, train: DataFrame, k: int = 5, weights: str = "uniform",
                exclude_self: bool = False, **sizes) -> DataFrame:
    """``(id, prediction)``: mean (or distance-weighted mean) of the neighbours' labels."""
    pairs = _labelled(queries, train, k, weights, exclude_self, sizes)
    return pairs.groupBy("id").agg((F.sum(F.col("w") * F.col("label")) / F.sum("w")).alias("prediction"))


def _labelled(queries, train, k, weights, exclude_self, sizes) -> DataFrame:
    near = knn_join(queries, train.select("id", "vec"), k, exclude_self, **sizes)
    labels = train.select(F.col("id").alias("d_id"), "label")
    pairs = near.join(labels, "d_id")
    if weights == "distance":
        # As usual for inverse-distance votes, exact matches outvote everything else.
        exact = F.max((F.col("distance") == 0).cast("int")).over(Window.partitionBy("q_id"))
        w = F.when(exact == 1, (F.col("distance") == 0).cast("double")).otherwise(1.0 / F.nullif("distance", F.lit(0.0)))
    else:
        w = F.lit(1.0)
    return pairs.withColumn("w", w).withColumnRenamed("q_id", "id")
