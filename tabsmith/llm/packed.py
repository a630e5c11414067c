"""Shuffles of very many 64-bit hashes as packed runs, keyed by a bucket of the hash.

A block of texts sends each bucket one row: for every bag of hashes (a set of shingles, a bag of words) that has some
there, the bag's identity and weight, and their hashes side by side.  That is 6 to 7 bytes a hash instead of a row.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession

# Hashes that a bucket holds in memory at once, about; buckets grow in number with the input.
BUCKET_HASHES = 1_500_000
SCHEMA = "bucket int, bags binary, weights binary, counts binary, low binary, high binary, times binary"
_FIELDS = {"bags": np.int64, "weights": np.uint32, "counts": np.uint32, "low": np.uint32, "high": np.uint16, "times": np.uint32}
# Bits of a hash that tell it apart inside its bucket.
BITS = 48


def bucket_count(spark: SparkSession, hashes: int) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-hashes // BUCKET_HASHES))


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)).astype(np.int32)


def pack(bags: Iterable[int], weights: Iterable[int], hashes: list[np.ndarray], times: list[np.ndarray] | None, buckets: int) -> pa.RecordBatch:
    """One row per bucket for bags with their weight, their distinct hashes, and how often each stands in the bag."""
    sizes = np.array([len(h) for h in hashes], np.int64)
    flat = np.concatenate(hashes)
    bucket = bucket_of(flat, buckets)
    order = np.argsort(bucket.astype(np.uint16) if buckets <= 1 << 16 else bucket, kind="stable")
    owner, bucket, flat = np.repeat(np.arange(len(sizes)), sizes)[order], bucket[order], flat[order]
    run = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (bucket[1:] != bucket[:-1]))))
    there, run_at = np.unique(bucket[run], return_index=True)
    run_at, at = np.append(run_at, len(run)), np.append(np.searchsorted(bucket, there), len(bucket))
    by_run = {"bags": np.fromiter(bags, np.int64)[owner[run]], "weights": np.fromiter(weights, np.uint32)[owner[run]],
              "counts": np.diff(np.append(run, len(owner)))}
    by_hash = {"low": flat & np.uint64(0xFFFFFFFF), "high": flat >> np.uint64(32) & np.uint64(0xFFFF)}
    if times is not None:
        by_hash["times"] = np.concatenate(times)[order]
    columns = [pa.array(there.astype(np.int32))]
    for name, kind in _FIELDS.items():
        a, cut = (by_run[name], run_at) if name in by_run else (by_hash.get(name, flat[:0]), at)
        a = a.astype(kind)
        columns.append(pa.array([a[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:])] if len(a) else [None] * len(there), pa.binary()))
    return pa.record_batch(columns, ["bucket", *_FIELDS])


class Bucket:
    """What all blocks sent to one bucket; a bag that came from several blocks counts once, its weights added if ``add``.

    bags, weights: by run.  value (48 bits), times: by hash.  owner: the run of each hash.
    """

    def __init__(self, table: pa.Table, add: bool = True):
        got = {n: np.frombuffer(b"".join(x for x in table.column(n).to_pylist() if x), kind) for n, kind in _FIELDS.items()}
        self.number = table.column("bucket")[0].as_py()
        owner = np.repeat(np.arange(len(got["bags"]), dtype=np.int32), got["counts"])
        value = got["low"].astype(np.int64) | got["high"].astype(np.int64) << 32
        times = got["times"]
        bags, first, back = np.unique(got["bags"], return_index=True, return_inverse=True)
        weights = np.bincount(back, got["weights"], len(bags)).astype(np.int64) if add else got["weights"][first].astype(np.int64)
        if len(bags) < len(got["bags"]):
            keep = np.zeros(len(got["bags"]), bool)
            keep[first] = True
            keep = keep[owner]
            owner, value = owner[keep], value[keep]
            times = times[keep] if len(times) else times
        self.bags, self.weights, self.owner, self.value, self.times = bags, weights, back[owner].astype(np.int32), value, times

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """Order by value, and where each value begins in that order (one more entry at the end)."""
        order = np.argsort(self.value, kind="stable")
        ordered = self.value[order]
        return order, np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1], [True])) if len(ordered) else np.ones(1, bool))
