"""Alignment of two tokenizers' tokens, with white-space tokens as anchors.

The ids are those of the texts tokenised whole.  Where tokens of both end at the same byte and the next tokens of both
begin with a space, the text is cut; between two such anchors lies a window, a pair of short tuples of token ids.  Equal
windows have equal alignments, so each distinct pair of tuples is aligned once and remembered.  No token of either side
reaches over a single space between words, so a word's ids do not depend on what stands around it: each distinct word is
tokenised and cut to windows once for a block of texts, and the block's texts are put together from their words.

Words and windows are remembered in flat arrays, since two workers share an executor with its JVM and an object for each
id, tuple and text takes several times the room.  New windows are aligned many at a time.

How many documents link two ids is counted over the corpus: tasks write shards (the links of some megabytes of text as
places in the shard's table of distinct pairs), the shards' tables are summed, and each shard asks for the sums of the
pairs in its table.
"""

from __future__ import annotations

import functools
import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabsmith.functions.session import shared_folder
from tabsmith.llm import text as tx
from tabsmith.llm.bpe import word_starts

# Bytes of text whose links share one table of pairs.
SHARD_BYTES = 8 << 20
# Words, and ids in them, that a worker remembers before it begins anew.
MEMO_WORDS, MEMO_IDS = 400_000, 4_000_000
# Indices that are laid out at a time: they take many times the bytes that they point to.
INDICES = 1 << 18
# Words that are tokenised at a time: what the tokenizers give for a token is many times an id.
ENCODE_WORDS = 1 << 13

_PER_DOC = ("n_a", "n_b", "n_groups", "n_links")
SHARD = ("block long, doc_id array<long>, " + ", ".join(f"{n} array<int>" for n in _PER_DOC)
         + ", groups_sha256 array<string>, n_pairs array<int>, places binary, times binary, a array<int>, b array<int>, held array<int>")
SCORED = "doc_id long, " + ", ".join(f"{n} long" for n in _PER_DOC) + ", n_best long, count_sum long, groups_sha256 string"


def _byte_alphabet() -> dict[str, int]:
    """Byte of each character of a byte-level vocabulary: visible Latin-1 characters are themselves, the rest follow from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class ByteLevel:
    """A byte-level BPE of the tokenizers library."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores are Spark's
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        alphabet, vocabulary = _byte_alphabet(), self.tokenizer.get_vocab()
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else token.encode()

    def encode(self, words: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]


class Pieces:
    """A sentencepiece model, which puts a space before each text itself."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [(self.model.id_to_piece(i), self.model.is_byte(i)) for i in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if byte else p.replace("▁", " ").encode() for p, byte in pieces]
        # Pieces have spaces at their beginning alone, so none reaches from one word to the next.
        self.by_word = all("▁" not in p.lstrip("▁") for p, _ in pieces)

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of texts that begin with the space which the model adds."""
        return self.model.encode([w[1:] for w in words], num_threads=1)


def _runs(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The indices of runs, one run after the other."""
    end = np.cumsum(many)
    return np.repeat(begin - end + many, many) + np.arange(end[-1] if len(end) else 0)


def _pieces(many: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and end of stretches of runs with about ``INDICES`` numbers; a longer run is one by itself."""
    end, at = np.cumsum(many), 0
    while at < len(many):
        to = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + INDICES, side="right")))
        yield at, to
        at = to


def _take(values: np.ndarray, begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Runs of ``values``, one after the other."""
    out, at = np.empty(many.sum(), values.dtype), 0
    for i, j in _pieces(many):
        some = values[begin[i]:begin[i] + many[i]] if j == i + 1 else values[_runs(begin[i:j], many[i:j])]
        out[at:at + len(some)] = some
        at += len(some)
    return out


class _Rows:
    """Rows of numbers, one after the other in one array, and where each begins."""

    def __init__(self, kind: str):
        self.kind = kind
        self.forget()

    def forget(self) -> None:
        self._flat, self._first = array(self.kind), array("q", [0])

    def __len__(self) -> int:
        return len(self._first) - 1

    @property
    def flat(self) -> np.ndarray:
        """A view; none may be kept over ``add``."""
        return np.frombuffer(self._flat, self.kind)

    @property
    def first(self) -> np.ndarray:
        return np.frombuffer(self._first, np.int64)

    def many(self, rows: np.ndarray) -> np.ndarray:
        first = self.first
        return first[rows + 1] - first[rows]

    def add(self, values: np.ndarray, many: np.ndarray) -> None:
        self._flat.frombytes(values.astype(self.kind, copy=False).tobytes())
        self._first.frombytes((self._first[-1] + np.cumsum(many, dtype=np.int64)).tobytes())


class _Known(_Rows):
    """Distinct rows and their numbers.  Rows are found by a hash and compared, so hashes that meet do no harm."""

    def forget(self) -> None:
        super().forget()
        self._hashes, self._number = np.zeros(0, np.uint64), np.zeros(0, np.int32)

    def _same(self, values: np.ndarray, begin: np.ndarray, many: np.ndarray, other: np.ndarray, at: np.ndarray, as_many: np.ndarray) -> np.ndarray:
        """Whether runs of ``values`` are those of ``other``."""
        same = many == as_many
        for i, j in _pieces(many):
            rows = i + np.flatnonzero(same[i:j])
            n = many[rows]
            unlike = np.flatnonzero(_take(values, begin[rows], n) != _take(other, at[rows], n))
            same[rows[np.searchsorted(np.cumsum(n), unlike, side="right")]] = False
        return same

    def numbers(self, values: np.ndarray, begin: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of each run of ``values``, and which runs are new: one of each, which get the next numbers in this order."""
        width = values.itemsize
        hashes = tx.span_hashes(values.view(np.uint8), begin * width, (begin + many) * width)
        found, one, where = np.unique(hashes, return_index=True, return_inverse=True)
        # Runs that only share the hash of the first one with it stand for themselves.
        first = one[where]
        again = np.flatnonzero(first != np.arange(len(first)))
        first = first[again]
        unlike = again[~self._same(values, begin[again], many[again], values, begin[first], many[first])]
        one, found = np.append(one, unlike), np.append(found, hashes[unlike])
        where[unlike] = np.arange(len(one) - len(unlike), len(one))
        number = np.full(len(one), -1, np.int64)
        if len(self):
            at = np.minimum(np.searchsorted(self._hashes, found), len(self._hashes) - 1)
            seen = np.flatnonzero(self._hashes[at] == found)
            is_it = self._number[at[seen]].astype(np.int64)
            same = self._same(values, begin[one[seen]], many[one[seen]], self.flat, self.first[is_it], self.many(is_it))
            number[seen[same]] = is_it[same]
        new = np.flatnonzero(number < 0)
        number[new] = np.arange(len(self), len(self) + len(new))
        order = np.argsort(found[new], kind="stable")
        at = np.searchsorted(self._hashes, found[new][order])
        self._hashes = np.insert(self._hashes, at, found[new][order])
        self._number = np.insert(self._number, at, number[new][order].astype(np.int32))
        self.add(_take(values, begin[one[new]], many[one[new]]), many[one[new]])
        return number[where], one[new]


class Aligner:
    """Both tokenizers of a worker, and the words and windows that it has aligned."""

    def __init__(self, byte_level: str, pieces: str):
        self.a, self.b = ByteLevel(byte_level), Pieces(pieces)
        self.sizes = [np.array(list(map(len, x.bytes)), np.int64) for x in (self.a, self.b)]
        self.spaced = [np.array([w[:1] == b" " for w in x.bytes]) for x in (self.a, self.b)]
        # Bytes of each side's tokens, and the tokens' ids as digits with a comma.
        self.spelt = [_Rows("B"), _Rows("B")]
        for rows, x, size in zip(self.spelt, (self.a, self.b), self.sizes):
            rows.add(np.frombuffer(b"".join(x.bytes), np.uint8), size)
        said = [f"{i},".encode() for i in range(max(map(len, self.sizes)))]
        self.said = _Rows("B")
        self.said.add(np.frombuffer(b"".join(said), np.uint8), np.array(list(map(len, said))))
        self.width = len(self.sizes[1])  # linked ids are A * width + B
        self.words, self.windows = _Known("B"), _Known("i")  # a window is the number of its A ids, these, and its B ids
        self.held = _Rows("i")  # windows of each word
        self.links, self.texts = _Rows("q"), _Rows("B")  # of windows; groups are text with a semicolon after each
        self.forget()

    def forget(self) -> None:
        for rows in (self.words, self.windows, self.held, self.links, self.texts):
            rows.forget()
        self.n_groups, self.bad = array("i"), array("b")  # of windows; of words

    def _align(self, ids: list[np.ndarray], many: list[np.ndarray]) -> None:
        """Remember windows: the groups between shared ends as text, their number, and the links: all pairs of tokens that share bytes."""
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, ids)]
        edge = np.cumsum(many[0])
        edge = ends[0][edge - 1] if len(edge) else edge
        ending = np.zeros((2, edge[-1] if len(edge) else 0), bool)
        for side in (0, 1):
            ending[side, ends[side] - 1] = True
        shared = ending[0] & ending[1]
        per_window = lambda at: np.diff(np.searchsorted(at, edge), prepend=0)
        # What lies up to the nearer end is in exactly these two tokens.
        at = np.flatnonzero(ending[0] | ending[1])
        x, y = (side_ids[np.searchsorted(side_ends, at + 1)] for side_ids, side_ends in zip(ids, ends))
        self.links.add(x.astype(np.int64) * self.width + y, per_window(at))
        group_ends = np.flatnonzero(shared)
        self.n_groups.frombytes(per_window(group_ends).astype(np.int32).tobytes())
        # A group's A tokens come after the B tokens of the groups before, its B tokens after its own A tokens too.
        group = [np.searchsorted(group_ends, side_ends - 1) for side_ends in ends]
        of_group = [np.concatenate(([0], np.searchsorted(side_ends, group_ends + 1) + 1)) for side_ends in ends]
        place_a = np.arange(len(ids[0])) + of_group[1][group[0]]
        place_b = np.arange(len(ids[1])) + of_group[0][group[1] + 1]
        merged = np.empty(len(ids[0]) + len(ids[1]), np.int64)
        merged[place_a], merged[place_b] = ids
        size = self.said.many(merged)
        said, said_to = _take(self.said.flat, self.said.first[merged], size), np.cumsum(size)
        said[said_to[place_a[shared[ends[0] - 1]]] - 1] = ord("|")
        said[said_to[place_b[shared[ends[1] - 1]]] - 1] = ord(";")
        tokens = np.cumsum(many[0] + many[1])
        self.texts.add(said, np.diff(said_to[tokens - 1], prepend=0) if len(tokens) else tokens)

    def _cut(self, ids: list[np.ndarray], edge: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Where the windows of words end in both sides' ids, and the number of each word's windows.

        They end at shared ends where the next tokens of both begin with a space, and with the words, whose bytes end at ``edge``.
        """
        ends = [np.cumsum(size[x]) for size, x in zip(self.sizes, ids)]
        shared = np.intersect1d(*ends, assume_unique=True)
        after = [np.searchsorted(x, shared) + 1 for x in ends]
        spaced = [np.append(space[x], True)[at] for space, x, at in zip(self.spaced, ids, after)]
        last = np.zeros(len(shared), bool)
        last[np.searchsorted(shared, edge)] = True
        cut = np.flatnonzero(last | spaced[0] & spaced[1])
        return [x[cut] for x in after], np.diff(np.searchsorted(shared[cut], edge, side="right"), prepend=0)

    def _learn(self, words: np.ndarray, many: np.ndarray) -> None:
        """Tokenise new words, all their bytes side by side, and align those of their windows that are new."""
        end = np.cumsum(many)
        raw = words.tobytes()
        texts = [raw[i:j].decode() for i, j in zip((end - many).tolist(), end.tolist())]
        ids, counts, fine = [], [], np.ones(len(texts), bool)
        for encoder, size in zip((self.a, self.b), self.sizes):
            got = encoder.encode(texts)
            counts.append(np.fromiter(map(len, got), np.int64, len(got)))
            ids.append(np.fromiter(chain.from_iterable(got), np.int32, counts[-1].sum()))
            fine &= np.diff(np.concatenate(([0], np.cumsum(size[ids[-1]])))[np.cumsum(counts[-1])], prepend=0) == many
        # Of words of the right length, the tokens have to say the bytes.
        right = fine.copy()
        text = words[np.repeat(fine, many)]
        for x, n, spelt, size in zip(ids, counts, self.spelt, self.sizes):
            x = x[np.repeat(fine, n)]
            unlike = np.flatnonzero(_take(spelt.flat, spelt.first[x], size[x]) != text)
            right[np.flatnonzero(fine)[np.searchsorted(np.cumsum(many[fine]), unlike, side="right")]] = False
        ids = [x[np.repeat(right, n)] for x, n in zip(ids, counts)]
        to, of_word = self._cut(ids, np.cumsum(many[right]))
        from_ = [np.concatenate(([0], x[:-1])) if len(x) else x for x in to]
        n_a, n_b = (x - y for x, y in zip(to, from_))
        begin = np.arange(len(n_a)) + from_[0] + from_[1]
        rows = np.empty(len(ids[0]) + len(ids[1]) + len(begin), np.int32)
        rows[begin], rows[_runs(begin + 1, n_a)], rows[_runs(begin + 1 + n_a, n_b)] = n_a, ids[0], ids[1]
        number, new = self.windows.numbers(rows, begin, 1 + n_a + n_b)
        self._align([_take(x, at[new], n[new]) for x, at, n in zip(ids, from_, (n_a, n_b))], [n_a[new], n_b[new]])
        windows = np.zeros(len(texts), np.int64)
        windows[right] = of_word
        self.held.add(number, windows)
        self.bad.frombytes((~right).astype(np.int8).tobytes())

    def block(self, data: np.ndarray, offsets: np.ndarray) -> "Block":
        if len(self.words) > MEMO_WORDS or len(self.windows.flat) > 2 * MEMO_IDS:
            self.forget()
        raw = data.tobytes()
        spaced = [b" " + raw[i:j] if j > i else b"" for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        raw = b"".join(spaced)
        data, offsets = np.frombuffer(raw, np.uint8), np.concatenate(([0], np.cumsum([len(t) for t in spaced], dtype=np.int64)))
        at = word_starts(data, offsets) if self.b.by_word else offsets[:-1][np.diff(offsets) > 0]
        many = np.diff(at, append=len(data)) if len(at) else at
        number, new = self.words.numbers(data, at, many)
        for k in range(0, len(new), ENCODE_WORDS):
            some = new[k:k + ENCODE_WORDS]
            self._learn(_take(data, at[some], many[some]), many[some])
        return Block(self, number, np.diff(np.searchsorted(at, offsets)))


class Block:
    """The windows of some texts by their number with the aligner; a text with a word whose bytes do not come back has none."""

    def __init__(self, aligner: Aligner, words: np.ndarray, counts: np.ndarray):
        self.aligner, self.n_texts = aligner, len(counts)
        owner = np.repeat(np.arange(len(counts)), counts)
        bad = np.zeros(len(counts), bool)
        bad[owner[np.frombuffer(aligner.bad, np.int8)[words] != 0]] = True
        words, owner = words[~bad[owner]], owner[~bad[owner]]
        held = aligner.held
        many = held.many(words)
        self.windows, self.owner = _take(held.flat, held.first[words], many).astype(np.int64), np.repeat(owner, many)

    def add(self, of: np.ndarray) -> np.ndarray:
        """Sum over the windows of each text."""
        return np.bincount(self.owner, of, self.n_texts).astype(np.int64)

    def flat(self, name: str) -> tuple[np.ndarray, np.ndarray]:
        """What the windows have, one after the other, and how many there are of each window."""
        rows = self.aligner.links if name == "links" else self.aligner.windows
        begin, many = rows.first[self.windows], rows.many(self.windows)
        if name != "links":
            n_a = rows.flat[begin].astype(np.int64)
            begin, many = (begin + 1, n_a) if name == "a" else (begin + 1 + n_a, many - 1 - n_a)
        return _take(rows.flat, begin, many), many

    def n_groups(self) -> np.ndarray:
        return self.add(np.frombuffer(self.aligner.n_groups, np.int32)[self.windows])

    def said(self) -> Iterator[memoryview]:
        """The groups of each text."""
        rows = self.aligner.texts
        if not len(self.windows):
            yield from [memoryview(b"")] * self.n_texts
            return
        texts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(rows.first), pa.py_buffer(rows.flat)])
        _, offsets, data = texts.take(pa.array(self.windows)).buffers()
        at = np.frombuffer(offsets, np.int64)[np.searchsorted(self.owner, np.arange(self.n_texts + 1))].tolist()
        data = memoryview(data)
        for i, j in zip(at[:-1], at[1:]):
            yield data[i:max(i, j - 1)]

    def texts(self) -> list[str]:
        return [str(t, "ascii") for t in self.said()]


@functools.lru_cache(1)
def _aligner(byte_level: str, pieces: str) -> Aligner:
    return Aligner(byte_level, pieces)


def _narrow(x: np.ndarray) -> np.ndarray:
    """The same counts in the fewest bytes each."""
    return x.astype(np.min_scalar_type(int(x.max()) if len(x) else 0))


def _wide(packed: pa.BinaryScalar, n: int) -> np.ndarray:
    """``n`` numbers of a narrow array's bytes."""
    raw = packed.as_buffer()
    return np.frombuffer(raw, f"u{raw.size // n}").astype(np.int64) if n else np.zeros(0, np.int64)


class _Shard:
    """The links of some megabytes of text."""

    def __init__(self):
        self.bytes, self.docs, self.doc_id = 0, 0, []
        self.per_doc: dict[str, list] = {n: [] for n in (*_PER_DOC, "groups_sha256", "n_pairs")}
        self.pairs, self.times = [], []

    def add(self, doc_id: pa.Array, aligner: Aligner, data: np.ndarray, offsets: np.ndarray) -> None:
        block = aligner.block(data, offsets)
        digests = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in block.said()]
        links, many = block.flat("links")
        width = len(aligner.sizes[0]) * aligner.width
        held, times = np.unique(np.repeat(block.owner, many) * width + links, return_counts=True)
        per_text = lambda name: block.add(block.flat(name)[1])
        new = {"n_a": per_text("a"), "n_b": per_text("b"), "n_groups": block.n_groups(), "n_links": block.add(many), "groups_sha256": digests,
               "n_pairs": np.bincount(held // width, minlength=len(offsets) - 1)}
        for n, values in new.items():
            self.per_doc[n].append(values)
        self.doc_id.append(doc_id)
        x, y = np.divmod(held % width, aligner.width)
        self.pairs.append(x << 32 | y)
        self.times.append(_narrow(times))
        self.bytes += len(data)
        self.docs += len(doc_id)

    def row(self, block: int) -> pa.RecordBatch:
        pairs, times = np.concatenate(self.pairs), np.concatenate(self.times)
        distinct, places, held = np.unique(pairs, return_inverse=True, return_counts=True)
        one = lambda x, kind=pa.int32(): tx.ragged(x, [len(x)], kind)
        ids = pa.concat_arrays(self.doc_id)
        shas = [x for part in self.per_doc["groups_sha256"] for x in part]
        flat = {n: one(np.concatenate(x)) for n, x in self.per_doc.items() if n != "groups_sha256"}
        packed = lambda x: pa.array([_narrow(x).tobytes()], pa.binary())
        columns = {"block": pa.array([block], pa.int64()), "doc_id": tx.ragged(ids, [len(ids)]), **flat, "groups_sha256": one(shas, pa.string()),
                   "places": packed(places), "times": packed(times), "a": one(distinct >> 32), "b": one(distinct & 0xFFFFFFFF), "held": one(held)}
        names = [x.split()[0] for x in SHARD.split(", ")]
        return pa.record_batch([columns[n] for n in names], names)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def align(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(doc_id, a, b, group_a, group_b) per row: both id lists, and where each group ends in them (exclusive).

    For nulls, empty texts and texts whose bytes do not come back, and for repeated rows, see ``score``.
    """
    def run(batches):
        aligner = _aligner(byte_level, pieces)
        for batch in batches:
            for at, end, data, offsets in tx.blocks(batch.column("text")):
                block = aligner.block(data, offsets)
                lists = []
                for name in "ab":
                    ids, many = block.flat(name)
                    lists.append(tx.ragged(ids, block.add(many), pa.int32()))
                for side in (0, 1):
                    ends = [np.cumsum([g.split("|")[side].count(",") + 1 for g in t.split(";")]) if t else np.zeros(0, np.int64) for t in block.texts()]
                    lists.append(tx.ragged(np.concatenate(ends), [len(x) for x in ends], pa.int32()))
                yield pa.record_batch([batch.column("doc_id").slice(at, end - at), *lists], ["doc_id", "a", "b", "group_a", "group_b"])
    return _texts(docs).mapInArrow(tx.tidy_batches(run), "doc_id long, a array<int>, b array<int>, group_a array<int>, group_b array<int>")


def write_shards(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """The links of all texts, a row for each shard, written to the shared folder: tokenising happens once."""
    def run(batches):
        aligner, shard, number = _aligner(byte_level, pieces), _Shard(), TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, end, data, offsets in tx.blocks(batch.column("text")):
                shard.add(batch.column("doc_id").slice(at, end - at), aligner, data, offsets)
                if shard.bytes >= SHARD_BYTES:
                    yield shard.row(number)
                    shard, number = _Shard(), number + 1
                    tx.release()
        if shard.docs:
            yield shard.row(number)
    folder = shared_folder(docs.sparkSession, "alignment")
    _texts(docs).mapInArrow(tx.tidy_batches(run), SHARD).write.parquet(folder)
    return docs.sparkSession.read.schema(SHARD).parquet(folder)


def pair_counts(shards: DataFrame) -> DataFrame:
    """(a, b, docs, best): in how many documents the ids are linked, and whether no other B id has more with this A id."""
    pairs = shards.select(F.explode(F.arrays_zip("a", "b", "held")).alias("p")).select("p.*")
    counts = pairs.groupBy("a", "b").agg(F.sum("held").alias("docs"))
    # The B ids of an A id are at most the other vocabulary.
    return counts.withColumn("best", F.col("docs") == F.max("docs").over(Window.partitionBy("a")))


def _score(shards: pa.Table, counts: pa.Table) -> pa.Table:
    _aligner.cache_clear()  # all shards are written by now, and the shuffles beside this worker need the room
    out = []
    place = counts.column("place").to_numpy()
    for k in range(len(shards)):
        row = {n: shards.column(n)[k] for n in shards.column_names}
        docs, best = np.zeros((2, len(row["a"])), np.int64)
        docs[place], best[place] = counts.column("docs").to_numpy(), counts.column("best").to_numpy()
        edge = np.concatenate(([0], np.cumsum(row["n_pairs"].values.to_numpy(), dtype=np.int64)))
        places, times = (_wide(row[n], int(edge[-1])) for n in ("places", "times"))
        sums = [np.diff(np.concatenate(([0], np.cumsum(of[places] * times)))[edge]) for of in (best, docs)]
        columns = {"doc_id": row["doc_id"].values, **{n: row[n].values.cast(pa.int64()) for n in _PER_DOC}, "n_best": pa.array(sums[0]),
                   "count_sum": pa.array(sums[1]), "groups_sha256": row["groups_sha256"].values.cast(pa.string())}
        out.append(pa.table(columns))
    kinds = {"doc_id": pa.int64(), **{n: pa.int64() for n in (*_PER_DOC, "n_best", "count_sum")}, "groups_sha256": pa.string()}
    return pa.concat_tables(out) if out else pa.table({n: pa.array([], k) for n, k in kinds.items()})


def score(docs: DataFrame, byte_level: str, pieces: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) per row of ``docs`` (doc_id, text).

    A is the byte-level BPE of the file ``byte_level`` over a space and the text, B the sentencepiece model ``pieces``
    over the text; special tokens in a text are plain text.  Groups lie between shared ends, links are all pairs of
    occurrences that share bytes, ``count_sum`` adds each link's number of documents, ``n_best`` counts the links whose
    number is the highest of their A id.  The digest is of the groups, ``a1,a2|b1;a3|b2``.

    Null and empty texts, and texts whose tokens do not say the text's bytes, have zeros and an empty digest.  Every row
    is a document, so repeated rows count each time and null doc_ids stay; other columns are ignored; an empty table
    gives an empty one.  A text is tokenised whole, so a very long one takes its task some thirty times its size, and
    its shard is as large as it.  A worker's memory of windows is bounded and affects no result.
    """
    shards = write_shards(docs, byte_level, pieces)
    asked = shards.select(F.col("block").alias("asker"), F.posexplode(F.arrays_zip("a", "b")).alias("place", "p")).select("asker", "place", "p.*")
    answers = asked.join(pair_counts(shards), ["a", "b"]).select("asker", "place", "docs", F.col("best").cast("int").alias("best"))
    return shards.groupBy("block").cogroup(answers.groupBy("asker")).applyInArrow(tx.tidy_tables(_score), SCORED)
