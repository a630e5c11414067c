"""Quality classifier: regularised quadratic discriminant over transformed statistics of the text.

Each class has its own mean and covariance, shrunk to the pooled covariance and to a multiple of the identity.  The
score is the logistic of the difference of the log densities, each a Mahalanobis distance through the class's Cholesky
factor, which is worked out once.  The fit uses sums of products only, so all labelled rows take part.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.llm import text as tx

FEATURES = ("words", "word_bytes", "upper", "digits", "stops", "symbols", "bare_words", "distinct_words", "top_word",
            "repeated_lines", "line_words", "other_bytes", "shouted_words", "echoed_words")

_KIND = np.zeros(256, np.uint8)  # 1 a-z, 2 A-Z, 3 digit, 4 stop or mark of prose, 5 symbol, 6 white space, 7 above ASCII
_KIND[33:127] = 5
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 7
_KIND[[ord(c) for c in ".,;:'\"?()-"]] = 4
_KIND[[9, 10, 11, 12, 13, 32]] = 6
_NOT_LINE_END = np.ones(256, bool)
_NOT_LINE_END[10] = False


def _logit(x):
    return np.log((x + 1e-3) / (1 - x + 1e-3))


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics per text, transformed so that shares and sizes are closer to normal."""
    texts = len(offsets) - 1
    kind = _KIND[data]

    def count(mask, at=offsets):
        total = np.concatenate(([0], np.cumsum(mask, dtype=np.int64)))
        return (total[at[1:]] - total[at[:-1]]).astype(float)
    starts, ends, first = tx.spans(data, offsets, tx.SPACED)
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    letters = np.concatenate(([0], np.cumsum((kind == 1) | (kind == 2) | (kind == 7), dtype=np.int64)))
    capitals = np.concatenate(([0], np.cumsum(kind == 2, dtype=np.int64)))
    in_word, upper_in_word = letters[ends] - letters[starts], capitals[ends] - capitals[starts]
    inked = np.maximum(np.diff(offsets) - count(kind == 6), 1)
    hashes = tx.span_hashes(data, starts, ends)
    distinct, top = np.zeros(texts), np.zeros(texts)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b > a:
            h = np.sort(hashes[a:b])
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
            distinct[i], top[i] = len(edge) - 1, np.diff(edge).max()
    echo = np.zeros(len(hashes), bool)
    echo[1:] = hashes[1:] == hashes[:-1]
    echo[first[:-1][first[:-1] < len(hashes)]] = False
    line_starts, line_ends, first_line = tx.spans(data, offsets, _NOT_LINE_END)
    lines = tx.span_hashes(data, line_starts, line_ends)
    repeated = np.zeros(texts)
    for i, (a, b) in enumerate(zip(first_line[:-1].tolist(), first_line[1:].tolist())):
        if b > a + 1:
            repeated[i] = 1 - len(np.unique(lines[a:b])) / (b - a)
    long = np.maximum(count(np.ones(len(data), bool)) - count(kind == 6), 0)
    return np.column_stack([
        np.log1p(words), np.log1p(long / some), _logit(count(kind == 2) / inked), _logit(count(kind == 3) / inked),
        _logit(count(kind == 4) / inked), _logit(count(kind == 5) / inked), _logit(count(in_word == 0, first) / some),
        _logit(distinct / some), _logit(top / some), _logit(repeated), np.log1p(words / np.maximum(np.diff(first_line), 1)),
        _logit(count(kind == 7) / inked), _logit(count((upper_in_word == in_word) & (in_word > 1), first) / some),
        _logit(count(echo, first) / some)])


def _batch_features(column: pa.Array) -> np.ndarray:
    got = [features(data, offsets) for _, _, data, offsets in tx.blocks(column)]
    return np.concatenate(got) if got else np.zeros((0, len(FEATURES)))


@dataclass
class Discriminant:
    """center and scale of the statistics; mean, inverse Cholesky factor and constant of each class."""

    center: np.ndarray
    scale: np.ndarray
    means: list[np.ndarray]
    inverses: list[np.ndarray]
    constants: list[float]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.center) / self.scale
        density = [c - 0.5 * (((z - m) @ inv.T) ** 2).sum(1) for m, inv, c in zip(self.means, self.inverses, self.constants)]
        return 1 / (1 + np.exp(np.clip(density[0] - density[1], -700, 700)))


def fit(docs: DataFrame, labels: DataFrame, training: Column, shrink_to_pooled: float = 0.7, shrink_to_identity: float = 0.1) -> Discriminant:
    """The discriminant from ``docs`` (doc_id, text) and ``labels`` (doc_id, quality 0 or 1).

    Rows count where ``training`` holds, a condition over the columns of ``docs``; null counts as false.  A doc_id
    with several labels has the lowest; null labels and ids are none.  Each row of a repeated doc_id counts.  A
    class without rows gets the pooled moments (with no rows at all everything scores 0.5).
    """
    rows = docs.where(training).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = len(FEATURES) + 1

    def stats(batches):
        for batch in batches:
            x = _batch_features(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), tx.ragged(x.ravel(), [x.shape[1]] * len(x))], ["doc_id", "x"])

    def moments(batches):
        total = np.zeros((2, size, size))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.column_stack([np.ones(len(x)), x])
            y = batch.column("quality").to_numpy(zero_copy_only=False)
            for c in (0, 1):
                total[c] += x[y == c].T @ x[y == c]
        place = np.arange(total.size)
        yield pa.record_batch([pa.array(place), pa.array(total.ravel())], ["place", "value"])
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.min("quality").cast("int").alias("quality"))
    got = (rows.mapInArrow(tx.tidy_batches(stats), "doc_id long, x array<double>").join(known, "doc_id").select("x", "quality")
           .mapInArrow(tx.tidy_batches(moments), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).collect())
    total = np.zeros(2 * size * size)
    for r in got:
        total[r["place"]] = r["value"]
    return discriminant(total.reshape(2, size, size), shrink_to_pooled, shrink_to_identity)


def discriminant(moments: np.ndarray, shrink_to_pooled: float, shrink_to_identity: float) -> Discriminant:
    """From sums of products of (1, statistics) per class."""
    p = moments.shape[1] - 1
    whole = moments.sum(0)
    n = max(whole[0, 0], 1.0)
    center = whole[0, 1:] / n
    scale = np.sqrt(np.maximum(np.diag(whole)[1:] / n - center ** 2, 1e-8)) if whole[0, 0] else np.ones(p)
    to_z = np.eye(p + 1)  # (1, x) to (1, z)
    to_z[1:, 1:] = np.diag(1 / scale)
    to_z[1:, 0] = -center / scale
    z = np.array([to_z @ m @ to_z.T for m in moments])
    mean = [m[0, 1:] / m[0, 0] if m[0, 0] else np.zeros(p) for m in z]
    spread = [m[1:, 1:] - m[0, 0] * np.outer(v, v) for m, v in zip(z, mean)]
    pooled = sum(spread) / n if whole[0, 0] else np.eye(p)
    inverses, constants = [], []
    for m, s in zip(z, spread):
        own = s / m[0, 0] if m[0, 0] else pooled
        own = (1 - shrink_to_pooled) * own + shrink_to_pooled * pooled
        own = (1 - shrink_to_identity) * own + shrink_to_identity * max(np.trace(own) / p, 1e-3) * np.eye(p)
        factor = np.linalg.cholesky(own)
        inverses.append(np.linalg.inv(factor))
        constants.append(-np.log(np.diag(factor)).sum() + np.log((m[0, 0] + 0.5) / (whole[0, 0] + 1)))
    return Discriminant(center, scale, mean, inverses, constants)


def score(docs: DataFrame, model: Discriminant, keep: str = "*", least: float | None = None) -> DataFrame:
    """``docs`` with score (0 to 1, high is good) and predicted (1 from 0.5 on); a null text scores as an empty one.

    Columns of ``docs`` with these names are replaced.  ``keep`` names the columns to keep, separated by commas; with ``least`` rows that score below it are left out.
    """
    names = [n for n in docs.columns if n not in ("score", "predicted")] if keep == "*" else keep.split(",")
    text = "text" if "text" in names and dict(docs.dtypes)["text"] == "string" else "_text"
    rows = docs.select(*(F.col(f"`{n}`") for n in names), *([F.col("text").cast("string").alias(text)] if text == "_text" else []))
    schema = docs.select(*(F.col(f"`{n}`") for n in names)).withColumns({"score": F.lit(0.0), "predicted": F.lit(0)}).schema

    def run(batches):
        for batch in batches:
            got = model.score(_batch_features(batch.column(text)))
            out = pa.record_batch([*(batch.column(i) for i in range(len(names))), pa.array(got), pa.array((got >= 0.5).astype(np.int32))],
                                  [*names, "score", "predicted"])
            yield out if least is None else out.filter(pa.array(got >= least))
    return rows.mapInArrow(tx.tidy_batches(run), schema)
