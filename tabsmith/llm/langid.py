"""Language identification by n-gram filters: one Bloom filter per language, bit-sliced into one table.

Each slot of the table holds a bitmask of languages, so the AND of an n-gram's slots gives all languages that contain
it.  Per language these bits are counted over a text and corrected for the filter's false positives; the language
that knows most of the text's n-grams wins.

An n-gram is four bytes of lower-cased text: a window over a word with one blank at either side, the two inner bytes
being letters (or parts of one).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.session import cut_lineage
from tabsmith.llm import text as tx

PROBES = 4
# Share of its n-grams by which another language must know a text better than the given one.
LEAD = 0.1
# N-grams in each part of the training that goes into the table at once.
PART = 1_000_000

_LETTER = np.zeros(256, np.uint32)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[65:91] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of all texts, and the index of each text's first one."""
    sizes = np.diff(offsets)
    s = np.zeros(len(data) + len(sizes) + 3, np.uint32)
    s[np.repeat(np.arange(len(sizes)) + 1, sizes) + np.arange(len(data))] = _LETTER[data]
    inner = np.flatnonzero((s[1:-2] != 0) & (s[2:-1] != 0))
    gram = s[inner] << 24 | s[inner + 1] << 16 | s[inner + 2] << 8 | s[inner + 3]
    return gram, np.searchsorted(inner, offsets + np.arange(len(offsets)))


def _slots(gram: np.ndarray, slots: int) -> list[np.ndarray]:
    h = tx.mix(gram.astype(np.uint64) + np.uint64(1))
    a, b = (h >> np.uint64(32)).astype(np.uint32), h.astype(np.uint32) | np.uint32(1)
    return [(a + b * np.uint32(j)) & np.uint32(slots - 1) for j in range(PROBES)]


@dataclass
class Filters:
    """languages: by how often they were seen; table: a bitmask of languages per slot, up to 64 languages to a plane.

    The table has 16 to 32 slots for each distinct n-gram, however many there are.
    """

    languages: list[str]
    table: np.ndarray

    def false_rate(self) -> np.ndarray:
        kind, width = self.table.dtype.type, self.table.itemsize * 8
        return np.array([((self.table[j // width] >> kind(j % width)) & kind(1)).mean() ** PROBES for j in range(len(self.languages))])


def train(docs: DataFrame, training: Column, least: int = 2) -> Filters:
    """Filters from the rows of ``docs`` (text, lang) where ``training`` holds; rows without text or lang teach nothing.

    N-grams seen fewer than ``least`` times in a language are no part of its filter; with 1 it holds every one.
    """
    known = docs.where(training).where("text is not null and lang is not null").select(
        F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    seen = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    languages = [r["lang"] for r in seen]
    place = {lang: j for j, lang in enumerate(languages)}

    def run(batches):
        kept, counts, size = [], [], 0

        def merged():
            key, back = np.unique(np.concatenate(kept), return_inverse=True)
            return key, np.bincount(back, np.concatenate(counts)).astype(np.int64)

        def batch_of(key, n):
            return pa.record_batch([pa.array((key >> 32).astype(np.int32)), pa.array(key & 0xFFFFFFFF), pa.array(n)], ["lang", "gram", "count"])
        for batch in batches:
            lang = np.array([place[x] for x in batch.column("lang").to_pylist()], np.int64)
            for at, end, data, offsets in tx.blocks(batch.column("text")):
                gram, first = _grams(data, offsets)
                key, n = np.unique(gram.astype(np.int64) | np.repeat(lang[at:end] << 32, np.diff(first)), return_counts=True)
                kept.append(key)
                counts.append(n)
                size += len(key)
                if size > 1_500_000:
                    key, n = merged()
                    if len(key) > 1_000_000:
                        yield batch_of(key, n)
                        key, n = key[:0], n[:0]
                    kept, counts, size = [key], [n], len(key)
        if size:
            yield batch_of(*merged())
    counted = known.mapInArrow(tx.tidy_batches(run), "lang int, gram long, count long").groupBy("lang", "gram").agg(F.sum("count").alias("count"))
    counted = cut_lineage(counted.where(F.col("count") >= least).select("lang", "gram"))
    distinct = counted.select("gram").distinct().count()
    slots = 1 << max(12, (16 * distinct).bit_length())
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= k(0).itemsize * 8 or k is np.uint64)
    width = kind(0).itemsize * 8
    table = np.zeros((-(-len(languages) // width) or 1, slots), kind)
    # One part of the n-grams after the other comes to the driver.
    parts = -(-counted.count() // PART)
    for part in range(parts):
        kept = counted.where(F.pmod(F.xxhash64("gram"), F.lit(parts)) == part).toArrow()
        lang, gram = kept.column("lang").to_numpy(), kept.column("gram").to_numpy()
        for j in np.unique(lang).tolist():
            for slot in _slots(gram[lang == j], slots):
                table[j // width, slot] |= kind(1 << j % width)
    return Filters(languages, table)


def predict(docs: DataFrame, model: Filters, keep: str = "*", share: float | None = None, given: str | None = None) -> DataFrame:
    """``docs`` with lang_pred and score: the language that knows most of the text, and the share of its n-grams known.

    ``und`` and 0 for a null text or one without letters; a text with letters but no n-gram ("a b") gets the most
    seen language and 0.  Ties go to the language seen more often in training.  With no language learned all is
    ``und``.  Columns of ``docs`` with
    these names are replaced.  ``keep`` names the columns to keep, separated by commas; with ``share`` rows of score below it and
    rows of ``und`` are left out.  ``given`` names a column with a language that
    wins unless another knows more by ``LEAD`` of the n-grams, since large filters hold stray n-grams of all languages.
    """
    names = [n for n in docs.columns if n not in ("lang_pred", "score")] if keep == "*" else keep.split(",")
    text = "text" if "text" in names and dict(docs.dtypes)["text"] == "string" else "_text"
    rows = docs.select(*(F.col(f"`{n}`") for n in names), *([F.col("text").cast("string").alias(text)] if text == "_text" else []),
                       F.coalesce(F.col("text").cast("string").rlike(r"\p{L}"), F.lit(False)).alias("_letters"),
                       *([F.col(given).cast("string").alias("_given")] if given else []))
    broadcast, false = docs.sparkSession.sparkContext.broadcast(model), model.false_rate()
    plain = docs.select(*(F.col(f"`{n}`") for n in names)).withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema

    def run(batches):
        model = broadcast.value
        languages, width = model.languages, model.table.itemsize * 8
        place = {lang: j for j, lang in enumerate(languages)}
        for batch in batches:
            if not batch.num_rows:
                continue
            own = np.array([place.get(x, -1) for x in batch.column("_given").to_pylist()]) if given else np.full(batch.num_rows, -1)
            winner, score = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows)
            for at, end, data, offsets in tx.blocks(batch.column(text)):
                gram, first = _grams(data, offsets)
                n = np.diff(first)
                slots = _slots(gram, model.table.shape[1])
                best = np.full(end - at, -1.0)
                for j in range(len(languages)):
                    if j % width == 0:
                        plane = model.table[j // width]
                        mask = plane[slots[0]]
                        for slot in slots[1:]:
                            mask &= plane[slot]
                    bit = np.concatenate(([0], np.cumsum(mask >> mask.dtype.type(j % width) & mask.dtype.type(1), dtype=np.int64)))
                    hits = bit[first[1:]] - bit[first[:-1]]
                    real = np.clip((hits - n * false[j]) / (1 - false[j]) if false[j] < 1 else 0.0 * n, 0, n)
                    real = real + np.where(own[at:end] == j, LEAD * n, 0.0)
                    better = real > best
                    winner[at:end][better] = j
                    best[better] = real[better]
                best = best - np.where((own[at:end] >= 0) & (own[at:end] == winner[at:end]), LEAD * n, 0.0)
                score[at:end] = np.where(n > 0, np.clip(best, 0, None) / np.maximum(n, 1), 0)
            letters = batch.column("_letters").to_numpy(zero_copy_only=False) & (len(languages) > 0)
            score[~letters] = 0
            said = pa.array([languages[j] if ok else "und" for j, ok in zip(winner.tolist(), letters.tolist())], pa.string())
            out = pa.record_batch([*(batch.column(i) for i in range(len(names))), said, pa.array(score)], [*names, "lang_pred", "score"])
            yield out if share is None else out.filter(pa.array(letters & (score >= share)))
    return rows.mapInArrow(tx.tidy_batches(run), plain)
