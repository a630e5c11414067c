"""Document fingerprints by context-triggered piecewise hashing.

A hash of the last seven bytes decides where a piece ends: at block size 2**k, where its low k bits are all set.  Each
piece gives one signature character.  The block size is the smallest at which a text has at most 64 pieces; the
fingerprint is ``size:signature:signature at twice the size``.  Fingerprints are compared by edit distance wherever
their block sizes meet.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm import ordered
from tabsmith.llm import text as tx

CONTEXT = 7
LEAST = 2
LONGEST = 64
ALPHABET = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)


def fingerprint_of(raw: bytes) -> str:
    """The fingerprint of a text's bytes; equal texts have equal ones, an empty text has empty signatures."""
    data = np.frombuffer(raw, np.uint8)
    n = len(data)
    if not n:
        return f"{1 << LEAST}::"
    ends = np.arange(1, n + 1)
    rolling = tx.span_hashes(data, np.maximum(ends - CONTEXT, 0), ends)
    # Trailing set bits: a context that ends pieces at one size does so at all smaller ones.
    flipped = ~rolling
    ones = np.bitwise_count((flipped & (~flipped + np.uint64(1))) - np.uint64(1))
    at = np.flatnonzero(ones >= LEAST)
    ones = ones[at]
    k = LEAST
    while np.count_nonzero(ones >= k) >= LONGEST:
        k += 1
    return f"{1 << k}:{_signature(data, at[ones >= k])}:{_signature(data, at[ones > k])}"


def _signature(data: np.ndarray, last: np.ndarray) -> str:
    cuts = np.unique(np.concatenate(([0], last + 1, [len(data)])))
    pieces = tx.span_hashes(data, cuts[:-1], cuts[1:])
    return ALPHABET[(pieces >> np.uint64(58)).astype(np.int64)].tobytes().decode()


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) per row of ``docs`` (doc_id, text); a null text is empty."""
    def run(batches):
        for batch in batches:
            out = [fingerprint_of((t or "").encode()) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(out, pa.string())], ["doc_id", "fingerprint"])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        tx.tidy_batches(run), docs.select("doc_id", F.lit("").alias("fingerprint")).schema)


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: 1 less the edit distance by the longer signature, at the block sizes that both have; 0 if none meets."""
    x, y = F.split(a, ":"), F.split(b, ":")

    def near(s: Column, t: Column) -> Column:
        longer = F.greatest(F.length(s), F.length(t))
        return F.when(longer == 0, 1.0).otherwise(1 - F.levenshtein(s, t) / longer)
    p, q = x[0].cast("long"), y[0].cast("long")
    return (F.when(a == b, 1.0).when(p == q, F.greatest(near(x[1], y[1]), near(x[2], y[2])))
            .when(p == 2 * q, near(x[1], y[2])).when(q == 2 * p, near(x[2], y[1])).otherwise(0.0))


def with_next(docs: DataFrame, rows_each: int = 8192) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) per row of ``docs`` (doc_id, text).

    The next row is that of the next lower doc_id, after the last the first; rows with the same doc_id follow by
    text, null doc_ids come last.  The edited text has the last third of the text's code points replaced by as many
    of the next text's first ones, or all.  Null texts are empty.  Rows go to buckets of neighbouring ids, and the
    first row of a bucket goes to the one before as well.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"
    buckets = ordered.cut(rows.select("key"), rows_each)
    if not len(buckets):
        return docs.sparkSession.createDataFrame([], schema)
    bucket = buckets.number(F.col("key"))
    rows = rows.withColumn("bucket", bucket)
    # The bucket of the next higher ids takes a copy of the rows with the highest key as its tail.
    above = F.pmod(F.col("bucket") + 1, F.lit(len(buckets)))
    places = F.array(F.struct("bucket", F.lit(False).alias("tail")), F.struct(above.alias("bucket"), F.lit(True).alias("tail")))
    rows = rows.withColumn("to", F.explode(F.when(F.col("key") == buckets.highest(F.col("bucket")), places).otherwise(F.slice(places, 1, 1))))
    return rows.select("to.bucket", "to.tail", "doc_id", "key", "text").groupBy("bucket").applyInArrow(tx.tidy_table(_neighbours), schema)


def _neighbours(table: pa.Table) -> pa.Table:
    tail, key, text = (table.column(n).to_pylist() for n in ("tail", "key", "text"))
    order = sorted(range(len(key)), key=lambda i: (tail[i], -key[i], text[i]))
    ids = table.column("doc_id").to_pylist()
    out = []
    mine = _plain(text[order[0]])
    for i, j in zip(order, order[1:]):
        if tail[i]:
            break
        here, there = text[i], text[j]
        third = len(here) // 3
        edited = here[:len(here) - third] + there[:third] if third else here
        raw = edited.encode()
        follows = mine if here == there else _plain(there)
        out.append((ids[i], len(here), hashlib.sha256(raw).hexdigest(), mine, mine if edited == here else fingerprint_of(raw), follows))
        mine = follows
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"]
    kinds = [pa.int64(), pa.int64(), *[pa.string()] * 4]
    return pa.table([pa.array(x, k) for x, k in zip(zip(*out) if out else [[]] * 6, kinds)], names)


def _plain(text: str) -> str:
    return fingerprint_of(text.encode())
