"""Phrase collocations from FM-indexes of shards.

A task turns its texts into shards of word ids and builds an FM-index of each.  Intervals of the index are extended by
one symbol at a time: the symbol before an interval comes from the BWT (left extension), and every new interval lies in
that of its first symbols (its right extension), so each n-gram is met with its count and both parents, and nothing
grows from a parent that cannot be frequent.  Counts are summed across shards; scores and the rule of contained phrases
are joins over the table of frequent phrases.

A phrase is no more frequent than its parts.  So words are counted first, then pairs, then phrases of three words and
so on; what is known to be frequent goes back to the shards as a Bloom filter of bounded size, one for each length.  On
the way up only hashes are counted, packed by bucket, some three bytes for each phrase of a shard.  The last pass counts
the phrases themselves that all filters let through.  A filter never loses a frequent phrase; what it lets through beyond
these costs work and is dropped by the last pass, which is exact.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.session import cut_lineage
from tabsmith.llm import text as tx

# Words in one FM-index, about, and bytes of text whose distinct words are counted together.
SHARD_WORDS = 1 << 20
WORD_BYTES = 8 << 20
# Hashes that a bucket counts in memory at once, about, and their bits inside a bucket.
BUCKET_KEYS, LOW_BITS = 4_000_000, 32
# Bits of a filter: sixteen for each key, up to 16 MB.
MOST_BITS = 1 << 27
# Parts in which the best phrases of a language are ranked first.
RANK_PARTS = 64

_BREAK = np.zeros(256, bool)
_BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
_WORD = ~_BREAK
_WORD[[9, 32]] = False
_ODD = np.uint64(0x9E3779B97F4A7C15)


class FMIndex:
    """FM-index of a sequence of symbols, sorted by the first ``depth`` symbols; symbol 0 stands in no pattern."""

    def __init__(self, text: np.ndarray, depth: int):
        self.text, rank, reach = text, text.astype(np.int64), 1
        while reach < depth:
            step = min(reach, depth - reach)
            rank = rank * (int(rank.max(initial=0)) + 1) + np.roll(rank, -step)
            reach += step
            if reach < depth:
                rank = np.unique(rank, return_inverse=True)[1]
        self.suffixes = np.argsort(rank, kind="stable")
        self.first = text[self.suffixes]
        # Where the symbol that begins a suffix stands in the BWT: the inverse of the LF mapping.
        self.behind = np.argsort(text[self.suffixes - 1], kind="stable")

    def intervals(self, depth: int, keep: Callable | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(symbols, counts) of all patterns of 2, 3, ... ``depth`` symbols; symbols has a row for each pattern.

        ``keep`` says of the symbols which patterns may be extended or be part of longer ones; the others are left out.
        """
        n = len(self.text)
        new = np.ones(n, bool)
        new[1:] = self.first[1:] != self.first[:-1]
        number, good = np.cumsum(new) - 1, self.first[new] != 0
        for size in range(2, depth + 1):
            tail = number[self.behind]
            edge = new.copy()
            edge[1:] |= tail[1:] != tail[:-1]
            start = np.flatnonzero(edge)
            # Left extension of the pattern behind, right extension of the pattern that it begins with.
            fine = good[tail[start]] & good[number[start]]
            count = np.diff(np.append(start, n))
            symbols = self.text[(self.suffixes[start[fine]][:, None] + np.arange(size)) % n]
            if keep is not None and len(symbols):
                kept = keep(symbols)
                fine[fine] = kept
                symbols = symbols[kept]
            yield symbols, count[fine]
            number, good = np.cumsum(edge) - 1, fine


class Filter:
    """A Bloom filter with two bits a key."""

    def __init__(self, slots: np.ndarray):
        self.slots = slots

    @staticmethod
    def places(keys: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Slot and bit of each key's two places in ``size`` slots of 64 bits (a power of two), one below the other."""
        both = np.concatenate((keys, tx.mix(keys ^ _ODD)))
        return (both >> np.uint64(6) & np.uint64(size - 1)).astype(np.int64), np.uint64(1) << (both & np.uint64(63))

    def has(self, keys: np.ndarray) -> np.ndarray:
        slot, bit = self.places(tx.mix(keys), len(self.slots))
        return (self.slots[slot] & bit != 0).reshape(2, -1).all(axis=0)


def phrase_keys(words: np.ndarray) -> np.ndarray:
    """One key for each row of word keys."""
    key = words[:, 0]
    for j in range(1, words.shape[1]):
        key = tx.mix(key * _ODD + words[:, j])
    return key


def _filter(keys: DataFrame) -> Filter:
    """Filter of the keys (column ``key``); its slots come to the driver, whatever the rows at most ``MOST_BITS``."""
    size, wanted = 1, min(16 * keys.count(), MOST_BITS) // 64
    while size < wanted:
        size *= 2

    def run(batches):
        for batch in batches:
            slot, bit = Filter.places(tx.mix(batch.column(0).to_numpy().view(np.uint64)), size)
            yield pa.record_batch([pa.array(slot), pa.array(bit.view(np.int64))], ["slot", "bits"])
    found = keys.select("key").mapInArrow(run, "slot long, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    slots = np.zeros(size, np.uint64)
    slots[found.column("slot").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return Filter(slots)


def _hashes(column: pa.Array) -> np.ndarray:
    names = column.dictionary_encode()
    raw = [x.encode() for x in names.dictionary.to_pylist()]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64)
    return tx.span_hashes(np.frombuffer(b"".join(raw), np.uint8), ends - [len(x) for x in raw], ends)[names.indices.to_numpy()]


def _keys(words: np.ndarray, langs: np.ndarray) -> np.ndarray:
    """Key of each word in its language."""
    return tx.mix(words + langs * _ODD)


def _words(batch: pa.RecordBatch):
    """For each block of texts: its bytes in lower case, the words' starts, ends and keys, which begin a piece, and the first word of each text."""
    of_row = _hashes(batch.column("lang"))
    for at, end, data, offsets in tx.blocks(batch.column("text")):
        data = tx.LOWER[data]
        starts, ends, first = tx.spans(data, offsets, _WORD)
        keys = _keys(tx.span_hashes(data, starts, ends), np.repeat(of_row[at:end], np.diff(first)))
        breaks = np.concatenate(([0], np.cumsum(_BREAK[data])))
        begins = np.ones(len(starts), bool)
        begins[1:] = breaks[starts[1:]] > breaks[ends[:-1]]
        begins[first[:-1][first[:-1] < len(starts)]] = True
        yield at, data, starts, ends, keys, begins, first


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """(lang, word, f): how often each word stands in the texts of a language."""
    def run(batches):
        got: Counter = Counter()
        size = 0

        def rows():
            return pa.record_batch([pa.array([x for x, _ in got]), pa.array([w.decode() for _, w in got], pa.string()), pa.array(list(got.values()), pa.int64())],
                                   ["lang", "word", "f"])
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for at, data, starts, ends, keys, _, first in _words(batch):
                _, one, counts = np.unique(keys, return_index=True, return_counts=True)
                owner = (np.searchsorted(first, one, side="right") - 1 + at).tolist()
                raw = data.tobytes()
                for text, i, j, n in zip(owner, starts[one].tolist(), ends[one].tolist(), counts.tolist()):
                    got[langs[text], raw[i:j]] += n
                size += len(data)
                if size >= WORD_BYTES and got:
                    yield rows()
                    got.clear()
                    size = 0
        if got:
            yield rows()
    found = _texts(docs).mapInArrow(tx.tidy_batches(run), "lang string, word string, f long")
    return found.groupBy("lang", "word").agg(F.sum("f").alias("f"))


def _keyed(words: DataFrame) -> DataFrame:
    """The words (lang, word, f) with their keys."""
    def run(batches):
        for batch in batches:
            keys = _keys(_hashes(batch.column("word")), _hashes(batch.column("lang")))
            yield pa.record_batch([*batch.columns, pa.array(keys.view(np.int64))], [*batch.schema.names, "key"])
    return words.mapInArrow(run, "lang string, word string, f long, key long")


def _index(keys: np.ndarray, begins: np.ndarray, depth: int) -> tuple[np.ndarray, FMIndex]:
    """Words by symbol (symbol 0 has none), and the index of the runs of words with a 0 before each."""
    known, symbols = np.unique(keys, return_inverse=True)
    text = np.zeros(len(keys) + int(begins.sum()) + 1, np.int32)
    text[np.arange(len(keys)) + np.cumsum(begins)] = symbols + 1
    return np.concatenate((np.zeros(1, np.uint64), known)), FMIndex(text, depth)


def _cut(keys: np.ndarray, begins: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray]:
    """The runs of at least ``shortest`` words."""
    edge = np.append(np.flatnonzero(begins), len(keys))
    long = np.repeat(np.diff(edge) >= shortest, np.diff(edge))
    return keys[long], begins[long]


class _Known:
    """Filters of what is known to be frequent, by number of words, and how hashes are cut to keys."""

    def __init__(self, buckets: int):
        self.bits, self.filters, self.shard_words = buckets.bit_length() - 1, {}, SHARD_WORDS

    def add(self, words: int, rows: DataFrame) -> None:
        self.filters[words] = rows.sparkSession.sparkContext.broadcast(_filter(rows))

    def key(self, words: np.ndarray) -> np.ndarray:
        """Bucket and low bits of the phrases in the rows of ``words``, as one number."""
        return phrase_keys(words) >> np.uint64(64 - LOW_BITS - self.bits)

    def may_be(self, words: np.ndarray) -> np.ndarray:
        n = words.shape[1]
        return self.filters[n].value.has(self.key(words)) if n in self.filters else np.ones(len(words), bool)

    def shards(self, batches, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Keys of words in runs that the filters of words and pairs let through, and which of them begin a run."""
        got, size = [], 0
        for batch in batches:
            for _, _, _, _, keys, begins, _ in _words(batch):
                at = np.flatnonzero(self.filters[1].value.has(keys))
                begin, keys = begins[at], keys[at]
                begin[1:] |= at[1:] != at[:-1] + 1
                begin[:1] = True
                if 2 in self.filters and len(keys) > 1:
                    begin[1:] |= ~self.may_be(np.column_stack((keys[:-1], keys[1:])))
                got.append(_cut(keys, begin, shortest))
                size += len(got[-1][0])
                if size >= self.shard_words:
                    yield tuple(map(np.concatenate, zip(*got)))
                    got, size = [], 0
        if size:
            yield tuple(map(np.concatenate, zip(*got)))

    def patterns(self, batches, longest: int, shortest: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Word keys and counts of the phrases of each shard that the filters let through, a length at a time."""
        for keys, begins in self.shards(batches, shortest):
            known, index = _index(keys, begins, longest)
            for symbols, counts in index.intervals(longest, lambda s: self.may_be(known[s])):  # noqa: B023
                yield known[symbols], counts


def _packed(values: np.ndarray) -> bytes:
    """Unsigned numbers by planes of their bytes."""
    planes = values.astype(np.uint32).view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(raw: bytes) -> np.ndarray:
    planes = pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(4, -1).T).view(np.uint32).ravel()


def _often(docs: DataFrame, words: int, known: _Known, least: int) -> DataFrame:
    """Keys of the phrases of ``words`` words that stand at least ``least`` times, and of some that share a key with others."""
    def send(batches):
        for found, counts in known.patterns(batches, words, words):
            if found.shape[1] < words or not len(found):
                continue
            key = known.key(found)
            order = np.argsort(key)
            key, counts = key[order], counts[order]
            bucket = key >> np.uint64(LOW_BITS)
            there, first = np.unique(bucket, return_index=True)
            cut = [*first.tolist(), len(key)]
            low = (key & np.uint64((1 << LOW_BITS) - 1)).astype(np.int64)
            yield pa.record_batch(
                [pa.array(there.astype(np.int64)), pa.array([_packed(np.diff(low[i:j], prepend=0)) for i, j in zip(cut[:-1], cut[1:])], pa.binary()),
                 pa.array([_packed(counts[i:j]) for i, j in zip(cut[:-1], cut[1:])], pa.binary())], ["bucket", "low", "counts"])

    def add(table: pa.Table) -> pa.Table:
        low = np.concatenate([np.cumsum(_unpacked(x), dtype=np.int64) for x in table.column("low").to_pylist()])
        counts = np.concatenate([_unpacked(x) for x in table.column("counts").to_pylist()]).astype(np.int64)
        order = np.argsort(low)
        low, counts = low[order], counts[order]
        first = np.flatnonzero(np.diff(low, prepend=-1))
        keys = low[first[np.add.reduceat(counts, first) >= least]] + (table.column("bucket")[0].as_py() << LOW_BITS)
        return pa.table({"key": pa.array(keys)})
    sent = _texts(docs).mapInArrow(tx.tidy_batches(send), "bucket long, low binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(tx.tidy_table(add), "key long")


def _counted(docs: DataFrame, longest: int, known: _Known, least: int) -> DataFrame:
    """(phrase, f) of the phrases that the filters let through and that stand at least ``least`` times, summed across shards."""
    buckets = 1 << known.bits

    def send(batches):
        for words, counts in known.patterns(batches, longest, 2):
            if not len(words):
                continue
            bucket = (phrase_keys(words) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            there, first = np.unique(bucket[order], return_index=True)
            parts = list(zip(np.split(words[order], first[1:]), np.split(counts[order], first[1:])))
            yield pa.record_batch(
                [pa.array(there), pa.array(np.full(len(there), words.shape[1], np.int32)), pa.array([w.tobytes() for w, _ in parts], pa.binary()),
                 pa.array([_packed(n) for _, n in parts], pa.binary())], ["bucket", "size", "words", "counts"])

    def add(table: pa.Table) -> pa.Table:
        phrases, sums, sizes = [], [], table.column("size").to_numpy()
        for size in np.unique(sizes):
            rows = table.filter(pa.array(sizes == size))
            words = np.frombuffer(b"".join(rows.column("words").to_pylist()), np.int64).reshape(-1, size)
            counts = np.concatenate([_unpacked(x) for x in rows.column("counts").to_pylist()]).astype(np.int64)
            order = np.lexsort(words.T)
            words = words[order]
            first = np.flatnonzero(np.append(True, (words[1:] != words[:-1]).any(axis=1)))
            total = np.add.reduceat(counts[order], first)
            phrases.append(tx.ragged(words[first[total >= least]].ravel(), np.full(int((total >= least).sum()), size), pa.int64()))
            sums.append(total[total >= least])
        return pa.table({"phrase": pa.concat_arrays(phrases), "f": pa.array(np.concatenate(sums))})
    sent = _texts(docs).mapInArrow(tx.tidy_batches(send), "bucket long, size int, words binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(tx.tidy_table(add), "phrase array<long>, f long")


def _buckets(spark, words: int) -> int:
    """How many buckets keep each to ``BUCKET_KEYS``, a power of two."""
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-words // BUCKET_KEYS))
    return 1 << (wanted - 1).bit_length()


def frequent_phrases(docs: DataFrame, least: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Tables of what stands at least ``least`` times: phrases (phrase: word keys, f), words (lang, word, f, key); and totals (lang, n) of all words."""
    every = cut_lineage(word_counts(docs))
    totals = every.groupBy("lang").agg(F.sum("f").alias("n"))
    words = cut_lineage(_keyed(every.where(F.col("f") >= least)))
    known = _Known(_buckets(docs.sparkSession, every.agg(F.sum("f")).first()[0] or 0))
    known.add(1, words)
    for size in range(2, longest + 1):
        known.add(size, cut_lineage(_often(docs, size, known, least)))
    phrases = cut_lineage(_counted(docs, longest, known, least))
    return words.select(F.array("key").alias("phrase"), "f").unionAll(phrases), words, totals


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the ``top`` phrases of each language of ``docs`` (lang, text).

    Texts in lower case (A-Z) are split at ``.,;:!?`` and line ends into pieces, these at blanks and tabs into words.
    Candidates are phrases of 2 to ``longest`` words within pieces that stand at least ``least`` times (a).  A cut into
    two parts with counts l and r scores floor(1000 * a * n / (l * r)), n being all words of the language; the lowest cut
    counts, the shortest first part on ties.  A candidate inside a longer one with the same count goes.  Order: score,
    a (highest first), phrase.

    Null and empty texts have no words, a null lang is ``und``; doc_id is not looked at, so repeated rows count each
    time.  Other columns are ignored, an empty table gives an empty one.  A very long text is one shard, and takes its
    task some forty times its size.  Words of a language are told apart by 64-bit keys.  Counts, products and quotients
    are whole numbers of up to 38 digits; more is an error.
    """
    phrases, words, totals = frequent_phrases(docs, least, longest)
    size = F.size("phrase")
    candidates = phrases.where(size > 1)
    # The count of a phrase's one-word extensions says all: what lies between a phrase and a longer one is as frequent.
    around = phrases.where(size > 2).select(F.explode(F.array(F.expr("slice(phrase, 1, size(phrase) - 1)"), F.expr("slice(phrase, 2, size(phrase) - 1)"))).alias("phrase"), "f")
    around = around.groupBy("phrase").agg(F.max("f").alias("outer"))
    left = candidates.join(around, "phrase", "left").where(F.coalesce(F.col("outer") < F.col("f"), F.lit(True))).select("phrase", F.col("f").alias("a"))
    spelled = left.select("phrase", F.posexplode("phrase").alias("place", "key")).join(words.select("key", "lang", "word"), "key")
    spelled = spelled.groupBy("phrase").agg(F.min("lang").alias("lang"), F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("place", "word"))), lambda x: x["word"]), " ").alias("text"))
    parts = left.select("phrase", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    parts = parts.withColumns({"first": F.expr("slice(phrase, 1, k)"), "rest": F.expr("slice(phrase, k + 1, size(phrase) - k)")})
    cuts = (parts.join(phrases.select(F.col("phrase").alias("first"), F.col("f").alias("l")), "first")
            .join(phrases.select(F.col("phrase").alias("rest"), F.col("f").alias("r")), "rest")
            .join(spelled, "phrase").join(totals, "lang"))
    whole = lambda name, digits: F.col(name).cast(f"decimal({digits},0)")
    cuts = cuts.withColumns({"up": whole("a", 15) * whole("n", 18) * F.lit(1000).cast("decimal(4,0)"), "down": whole("l", 18) * whole("r", 18)})
    scored = cuts.select("lang", "text", "a", "n", F.struct(F.expr("up div down").alias("score"), "k", "l", "r").alias("cut"))
    best = scored.groupBy("lang", "text", "a", "n").agg(F.min("cut").alias("cut"))
    order = [F.col("cut.score").desc(), F.col("a").desc(), "text"]
    place = F.row_number()
    parted = best.withColumn("part", F.pmod(F.xxhash64("text"), F.lit(RANK_PARTS)))
    some = parted.withColumn("rank", place.over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", place.over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), F.col("text").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")
