"""Scores of texts by prediction by partial matching (method D) over byte contexts, with symbol exclusion.

Every training byte is counted in its contexts of 0 to ``ORDER`` preceding bytes, and every counted context is kept, as
a Spark table.  The code length of a byte depends on its run of ORDER + 1 symbols alone (its gram), so it is worked out
once for each distinct gram, in buckets of the last two context symbols: these hold all longer contexts of their grams,
and the contexts of at most one symbol are bounded by the alphabet and go everywhere.  Each block of texts asks the
buckets of a hash for the code lengths of its distinct grams, packed, and sums the answers per text.  Words (for the
base score) are counted, asked and answered in the same rows, as keys above all grams.

``Automaton`` gives the same scores from a trie in memory, state by state.

Symbols: 0-255 bytes, END of text, BOS before it (context only).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabsmith.functions.session import cut_lineage
from tabsmith.llm import packed
from tabsmith.llm import text as tx

ORDER = 5
END, BOS = 256, 257
WIDTH = 258
BITS = 9
CHUNK = 512
# Keys from here on are words, by 62 bits of their hash.
WORD = 1 << 62
# Bytes of text whose distinct grams are sent together, and bytes of text for each bucket of grams.
BLOCK, BUCKET_BYTES = 8 << 20, 64 << 20


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text as ORDER BOS, its bytes and END, one after the other, and where each text's BOS begin."""
    sizes = np.diff(offsets)
    begin = offsets[:-1] + np.arange(len(sizes)) * (ORDER + 1)
    out = np.full(len(data) + len(sizes) * (ORDER + 1), BOS, np.int64)
    out[np.repeat(begin + ORDER - offsets[:-1], sizes) + np.arange(len(data))] = data
    out[begin + ORDER + sizes] = END
    return out, begin


def _low(symbols: int) -> int:
    """The bits of so many last symbols of a gram."""
    return (1 << BITS * symbols) - 1


def _blocks(docs: DataFrame) -> DataFrame:
    """Blocks of texts with a number each: doc_id and train of their rows, sizes and bytes of their texts."""
    def run(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, end, data, offsets in tx.blocks(batch.column("text"), BLOCK):
                one = [0, end - at]
                ids, train = (pa.ListArray.from_arrays(pa.array(one, pa.int32()), batch.column(n).slice(at, end - at)) for n in ("doc_id", "train"))
                yield pa.record_batch(
                    [pa.array([number]), ids, train, pa.array([np.diff(offsets).tobytes()], pa.binary()), pa.array([len(data)]),
                     pa.array([pa.compress(data.tobytes(), "zstd", asbytes=True)], pa.binary())], ["block", "ids", "train", "sizes", "size", "data"])
                number += 1
    return cut_lineage(docs.mapInArrow(tx.tidy_batches(run), "block long, ids array<long>, train array<boolean>, sizes binary, size long, data binary"))


def _opened(batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts of the one block in ``batch``, and the gram of each byte and end."""
    size = batch.column("size")[0].as_py()
    data = np.frombuffer(pa.decompress(batch.column("data")[0].as_py(), decompressed_size=size, codec="zstd", asbytes=True) if size else b"", np.uint8)
    offsets = np.concatenate(([0], np.cumsum(np.frombuffer(batch.column("sizes")[0].as_py(), np.int64))))
    s, _ = symbols(data, offsets)
    gram = np.zeros(len(s) - ORDER, np.int64)
    for j in range(ORDER + 1):
        gram |= s[ORDER - j:len(s) - j] << BITS * j
    return data, offsets, gram[s[ORDER:] != BOS]


def _each_block(run):
    """``run`` for mapInArrow over single blocks."""
    return tx.tidy_batches(lambda batches: run(batch.slice(i, 1) for batch in batches for i in range(batch.num_rows)))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The key of each word, and the index of each text's first word."""
    data = tx.LOWER[data]
    starts, ends, first = tx.spans(data, offsets, tx.SPACED)
    return (tx.span_hashes(data, starts, ends) >> np.uint64(2)).astype(np.int64) | WORD, first


def _counts(blocks: DataFrame) -> DataFrame:
    """(key, count): all distinct grams and words, and how often they stand in training texts (0 if only in others)."""
    def run(each):
        kept, counts, size = [], [], 0

        def merged():
            key, back = np.unique(np.concatenate(kept), return_inverse=True)
            return key, np.bincount(back, np.concatenate(counts)).astype(np.int64)

        def rows(key, n):
            for at in range(0, len(key), 200_000):
                yield pa.record_batch([pa.array(key[at:at + 200_000]), pa.array(n[at:at + 200_000])], ["key", "count"])
        for block in each:
            data, offsets, gram = _opened(block)
            train = block.column("train").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            word, first = _words(data, offsets)
            for key, each_text, mark in ((gram, np.diff(offsets) + 1, 0), (word, np.diff(first), WORD)):
                # The lowest bit says whether the text trains.
                key, n = np.unique((key ^ mark) << 1 | np.repeat(train, each_text), return_counts=True)
                kept.append(key >> 1 | mark)
                counts.append(n * (key & 1))
                size += len(key)
            if size > 1_500_000:
                key, n = merged()
                if len(key) > 1_000_000:
                    yield from rows(key, n)
                    key, n = key[:0], n[:0]
                kept, counts, size = [key], [n], len(key)
        if size:
            yield from rows(*merged())
    return blocks.select("train", "sizes", "size", "data").mapInArrow(_each_block(run), "key long, count long").groupBy("key").agg(F.sum("count").alias("count"))


class _Level:
    """The counted contexts of one order: entries (context and symbol) with their counts, and by context the total, the
    distinct symbols, and what both leave of the suffix (``below``)."""

    def __init__(self, order: int, entries: np.ndarray, counts: np.ndarray, below: _Level | None):
        self.order, self.entries, self.counts = order, entries, counts
        of = entries >> BITS
        at = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1]))) if len(of) else np.zeros(0, np.int64)
        self.contexts = of[at]
        self.total = np.add.reduceat(counts, at) if len(at) else at
        self.kinds = np.diff(np.append(at, len(of)))
        if below is not None and len(at):
            suffix, _ = below.context(self.contexts << BITS)
            self.left = below.total[suffix] - np.add.reduceat(below.count(entries), at)
            self.new = below.kinds[suffix] - self.kinds
        else:
            self.left = self.new = np.zeros(len(at), np.int64)

    @staticmethod
    def _find(sorted_: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(sorted_):
            return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
        at = np.minimum(np.searchsorted(sorted_, wanted), len(sorted_) - 1)
        return at, sorted_[at] == wanted

    def context(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the contexts of grams are, and whether they are there."""
        return self._find(self.contexts, gram >> BITS & _low(self.order))

    def count(self, gram: np.ndarray) -> np.ndarray:
        at, there = self._find(self.entries, gram & _low(self.order + 1))
        return np.where(there, self.counts[at], 0) if len(self.counts) else np.zeros(len(gram), np.int64)


def _summed(key: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys with the sums of their counts, those above zero."""
    key, back = np.unique(key[count > 0], return_inverse=True)
    return key, np.bincount(back, count[count > 0], len(key)).astype(np.int64)


def code_lengths(gram: np.ndarray, count: np.ndarray, short: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """log10 probability of the last symbol of each gram.

    ``gram`` holds all distinct grams that end with the same two context symbols as one of them, ``count`` their
    training counts; ``short`` all counted pairs of a symbol and the one before, with their counts.
    """
    levels = [_Level(0, *_summed(short[0] & _low(1), short[1]), None)]
    levels.append(_Level(1, *_summed(*short), levels[0]))
    for k in range(2, ORDER + 1):
        levels.append(_Level(k, *_summed(gram & _low(k + 1), count), levels[k - 1]))
    out, live, begun = np.zeros(len(gram)), np.arange(len(gram)), np.zeros(len(gram), bool)
    left, new = np.zeros(len(gram)), np.zeros(len(gram))
    for level in reversed(levels):
        wanted = gram[live]
        at, there = level.context(wanted)
        if len(level.contexts):
            first = there & ~begun[live]
            left[live[first]], new[live[first]] = level.total[at[first]], level.kinds[at[first]]
            begun[live[first]] = True
            n = level.count(wanted)
            total, kinds = np.maximum(left[live], 0.5), new[live]
            seen = there & (n > 0)
            escape = np.where(kinds > 0, kinds / 2, total) / total
            out[live] += np.where(there, np.log10(np.where(seen, np.maximum(n - 0.5, 0.5) / total, escape)), 0)
            left[live[there]], new[live[there]] = level.left[at[there]], level.new[at[there]]
            live = live[~seen]
    distinct = int(levels[0].kinds.sum())
    out[live] -= np.log10(max(1, END + 1 - distinct))
    return out


def _by_bucket(gram: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of ascending grams by their bucket, the buckets met, and where each begins in that order (and the end)."""
    bucket = packed.bucket_of(tx.mix(gram.astype(np.uint64)), buckets)
    order = np.argsort(bucket, kind="stable")
    there, at = np.unique(bucket[order], return_index=True)
    return order, there, np.append(at, len(gram))


def _planes(x: np.ndarray) -> bytes:
    """Numbers byte by byte of their width, compressed."""
    return pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes(), "zstd", asbytes=True)


def _numbers(planes: bytes, n: int, kind) -> np.ndarray:
    width = np.dtype(kind).itemsize
    raw = np.frombuffer(pa.decompress(planes, decompressed_size=n * width, codec="zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(raw.reshape(width, n).T).reshape(-1).view(kind)


def _scored(docs: DataFrame) -> tuple[DataFrame, int]:
    """(doc_id, train, n_tokens, known, logs, score) of each row of ``docs`` (doc_id, text, train), and the distinct
    training words.  Tokens are the words and one end; known are the words seen in training; logs is their sum of
    log10(count + 0.5)."""
    spark = docs.sparkSession
    blocks = _blocks(docs)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(min(parts, 256), -(-(blocks.agg(F.sum("size")).first()[0] or 0) // BUCKET_BYTES))
    counts = cut_lineage(_counts(blocks))
    is_gram = F.col("key") < WORD
    sizes = counts.agg(F.count("*").alias("keys"), F.count_if(~is_gram & (F.col("count") > 0)).alias("words")).first()
    # At most one row for each pair of symbols.
    pairs = counts.where(is_gram & (F.col("count") > 0)).groupBy(F.expr(f"key & {_low(2)}").alias("pair")).agg(F.sum("count").alias("count")).toArrow()
    short = spark.sparkContext.broadcast((pairs.column("pair").to_numpy(), pairs.column("count").to_numpy()))

    def values(table):
        key, count = table.column("key").to_numpy(), table.column("count").to_numpy()
        by = np.argsort(key)
        key, count = key[by], count[by]
        grams = np.searchsorted(key, WORD)
        # The bits of a gram's code length, the count of a word.
        found = count.copy()
        found[:grams] = code_lengths(key[:grams], count[:grams], short.value).astype(np.float32).view(np.uint32)
        order, there, at = _by_bucket(key, buckets)
        cut = lambda x: pa.array([_planes(x[order[i:j]]) for i, j in zip(at[:-1], at[1:])], pa.binary())
        return pa.table([pa.array(there), pa.array(np.diff(at)), cut(key), cut(found)], ["bucket", "n", "keys", "found"])
    parts = max(parts, -(-sizes["keys"] // packed.BUCKET_HASHES))
    part = F.pmod(F.xxhash64(F.when(is_gram, F.expr(f"shiftright(key, {BITS}) & {_low(2)}")).otherwise(F.col("key"))), F.lit(parts))
    known = counts.groupBy(part.alias("part")).applyInArrow(tx.tidy_table(values), "bucket int, n long, keys binary, found binary")

    def keys_of(data, offsets, gram):
        gram, gram_back = np.unique(gram, return_inverse=True)
        word, first = _words(data, offsets)
        word, word_back = np.unique(word, return_inverse=True)
        return np.concatenate((gram, word)), gram_back, len(gram) + word_back, first

    def ask(each):
        for block in each:
            data, offsets, gram = _opened(block)
            key = np.concatenate((np.unique(gram), np.unique(_words(data, offsets)[0])))
            order, there, at = _by_bucket(key, buckets)
            yield pa.record_batch(
                [pa.array(np.repeat(block.column("block").to_numpy(), len(there))), pa.array(there), pa.array(np.diff(at)),
                 pa.array([_planes(np.diff(key[order[i:j]], prepend=0)) for i, j in zip(at[:-1], at[1:])], pa.binary())], ["block", "bucket", "n", "keys"])
    asked = blocks.select("block", "sizes", "size", "data").mapInArrow(_each_block(ask), "block long, bucket int, n long, keys binary")

    def answer(wanted, got):
        if not wanted.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.binary())], ["block", "bucket", "n", "found"])
        sizes = got.column("n").to_pylist()
        key, found = (np.concatenate([_numbers(x.as_py(), n, np.int64) for x, n in zip(got.column(name), sizes)]) for name in ("keys", "found"))
        by = np.argsort(key)
        key, found = key[by], found[by]
        out = [_planes(found[np.searchsorted(key, np.cumsum(_numbers(x.as_py(), n.as_py(), np.int64)))]) for x, n in zip(wanted.column("keys"), wanted.column("n"))]
        return pa.table([wanted.column("block"), wanted.column("bucket"), wanted.column("n"), pa.array(out, pa.binary())], ["block", "bucket", "n", "found"])
    answers = asked.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(tx.tidy_tables(answer), "block long, bucket int, n long, found binary")

    def total(block, got):
        data, offsets, gram = _opened(block)
        key, gram, word, first = keys_of(data, offsets, gram)
        got = got.sort_by("bucket")
        found = np.empty(len(key), np.int64)
        found[_by_bucket(key, buckets)[0]] = np.concatenate([_numbers(x.as_py(), n.as_py(), np.int64) for x, n in zip(got.column("found"), got.column("n"))])
        words, texts = np.diff(first), len(offsets) - 1
        score = np.bincount(np.repeat(np.arange(texts), np.diff(offsets) + 1), found.astype(np.uint32).view(np.float32)[gram], texts)
        of, count = np.repeat(np.arange(texts), words), found[word]
        ids, train = (block.column(x).combine_chunks().flatten() for x in ("ids", "train"))
        return pa.table([ids, train, pa.array(words + 1), pa.array(np.bincount(of, count > 0, texts).astype(np.int64)),
                         pa.array(np.bincount(of, np.log10(count + 0.5), texts).astype(np.float64)), pa.array(score)],
                        ["doc_id", "train", "n_tokens", "known", "logs", "score"])
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(
        tx.tidy_tables(total), "doc_id long, train boolean, n_tokens long, known long, logs double, score double"), sizes["words"] or 0


class Automaton:
    """A trie (order, context, symbol and count of its entries) compiled to states, for texts in one process.

    States are the trie's contexts by order and value; ``follow`` and ``gain`` give the next state and log10
    probability.
    """

    def __init__(self, trie: dict[str, np.ndarray]):
        order = np.lexsort((trie["symbol"], trie["context"], trie["k"]))
        k, context, symbol, count = (trie[n][order] for n in ("k", "context", "symbol", "count"))
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]) | (context[1:] != context[:-1])
        state = np.cumsum(new).astype(np.int64) - 1
        states = max(1, int(new.sum()))
        # A column for each symbol seen, BOS, and one for all symbols never seen.
        seen = np.unique(np.append(symbol, BOS))
        self.width = width = len(seen) + 1
        self.column = np.full(WIDTH, width - 1)
        self.column[seen] = np.arange(len(seen))
        count_of = np.zeros((states, width), np.float32)
        count_of[state, self.column[symbol]] = count
        k, context = k[new], context[new]
        self.known = [context[k == m] for m in range(ORDER + 1)]
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in self.known]))) if len(k) else np.array([0, 1] + [1] * ORDER)
        self.follow, self.gain = np.zeros((states, width), np.int32), np.zeros((states, width), np.float32)
        total, distinct = count_of.sum(1, dtype=np.float64), (count_of > 0).sum(1)
        lower = np.zeros((states, width), np.float32)
        for m in range(ORDER + 1):
            rows = slice(self.at[m], self.at[m + 1])
            n, here = count_of[rows], self.known[m]
            if m == 0:
                lower[rows] = -np.log10(max(1, END + 1 - distinct[0]))
            elif len(here):
                suffix = self.at[m - 1] + np.searchsorted(self.known[m - 1], here & ((1 << BITS * (m - 1)) - 1))
                self.follow[rows] = self.follow[suffix]
                below = count_of[suffix]
                left = total[suffix] - np.where(n > 0, below, 0).sum(1, dtype=np.float64)
                new_symbols = distinct[suffix] - distinct[rows]
                lower[rows] = self._blend(below, left, new_symbols, lower[suffix])
            self.gain[rows] = self._blend(n, total[rows], distinct[rows], lower[rows])
            if m < ORDER and len(self.known[m + 1]):
                child = self.known[m + 1]
                parent = self.at[m] + np.searchsorted(here, child >> BITS)
                self.follow[parent, self.column[child & ((1 << BITS) - 1)]] = self.at[m + 1] + np.arange(len(child))
        self.follow, self.gain = self.follow.ravel(), self.gain.ravel()

    @staticmethod
    def _blend(count: np.ndarray, total: np.ndarray, kinds: np.ndarray, lower: np.ndarray) -> np.ndarray:
        """log10 of (count - 1/2) / total for a symbol seen, else of the escape, kinds / 2 / total, and of ``lower``.

        Excluded symbols are not in total and kinds; where nothing is left the escape is certain.
        """
        total = np.maximum(total, 0.5)[:, None]
        escape = np.where(kinds > 0, kinds / 2, total[:, 0])[:, None] / total
        return np.where(count > 0, np.log10(np.maximum(count - 0.5, 0.5) / total), np.log10(escape) + lower)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """log10 probability of each text, END included.

        Texts are cut into chunks; the symbols before a chunk tell its first state, so all chunks run side by side.
        """
        s, begin = symbols(data, offsets)
        s = self.column[s]
        sizes = np.diff(offsets) + 1
        chunks = -(-sizes // CHUNK)
        owner = np.repeat(np.arange(len(sizes)), chunks)
        place = (np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)) * CHUNK
        length = np.minimum(CHUNK, sizes[owner] - place) + ORDER
        by_length = np.argsort(-length, kind="stable")
        start, length = (begin[owner] + place)[by_length], length[by_length]
        state, out = np.zeros(len(owner), np.int64), np.zeros(len(owner))
        live = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
        for t, n in enumerate(live.tolist()):
            at = state[:n] * self.width + s[start[:n] + t]
            if t >= ORDER:
                out[:n] += self.gain[at]
            state[:n] = self.follow[at]
        back = np.empty(len(owner))
        back[by_length] = out
        return np.bincount(owner, back, len(sizes))


def score(docs: DataFrame, training: Column) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs`` (doc_id, text).

    ``training`` is a condition over the columns of ``docs``; null counts as true.  ``score`` is the log10
    probability of the bytes of the text and its end.  Tokens are the words and one end; ``base_score`` is their
    log10 probability by additive smoothing (0.5) over the training tokens.  A null text is empty: it has the end
    alone.  Repeated rows are scored each, and trained on each; with no training rows bytes are uniform.  Words are
    told apart by 62 bits of hash.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce(training, F.lit(True)).alias("train"))
    rows, distinct = _scored(docs)
    rows = cut_lineage(rows)
    sums = rows.where("train").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("ends")).first()
    total, ends = sums["tokens"] or 0, sums["ends"]
    base = float(np.log10(total + 0.5 * (distinct + (1 if ends else 0) + 1)))
    return rows.select(
        "doc_id", "train", "n_tokens", (F.col("known") + (1 if ends else 0)).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + float(np.log10(ends + 0.5)) - F.col("n_tokens") * base).alias("base_score"), "score")
