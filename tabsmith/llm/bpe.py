"""Byte-level BPE encoding and decoding through one global table of distinct words.

A word is a run of pre-tokens cut at single inner spaces ("the", " cat,"): no match of the pre-token pattern crosses
such a cut, so words encode by themselves.  Each block of texts keeps its words' positions and sends its distinct
words to buckets by hash; a bucket encodes each distinct word once for all blocks; the ids come back to the block,
which puts them together by position.  Decoding looks ids up in the token-byte table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm import packed
from tabsmith.llm import text as tx

# Bytes of text whose positions one task puts together at a time, and words whose ids it lays out at a time.
ASSEMBLY_BYTES = 8 << 20
LAYOUT_WORDS = 1 << 17

# Bytes beside which a single space may be a cut: printable ASCII, and lead bytes of no white-space character.
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_TWO_BYTE_LEAD = np.zeros(256, bool)
_TWO_BYTE_LEAD[0xC3:0xE0] = True
_NEXT = _PLAIN | _TWO_BYTE_LEAD
_NEXT[0xE4:0xF5] = True


@functools.lru_cache(4)
def token_bytes(path: str) -> list[bytes]:
    """Bytes of each id of a rank file; ids without an entry are empty."""
    with open(path, "rb") as f:
        found = {int(rank): base64.b64decode(word) for word, rank in map(bytes.split, filter(bytes.strip, f))}
    return [found.get(i, b"") for i in range(max(found) + 1)]


@functools.lru_cache(4)
def _encoder(path: str, pattern: str):
    import tiktoken
    ranks = {b: i for i, b in enumerate(token_bytes(path)) if b}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


# White space by the Unicode property, as the pattern's \\s has it: runs that the pattern's engine cannot take at once.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")


def _ids(encoding, text: str) -> list[int]:
    """Ids of a word.  Of a long run of white space the last character goes with what follows, the rest is one piece."""
    out, at = [], 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        out += encoding.encode_ordinary(text[at:run.start()]) + encoding._encode_single_piece(text[run.start():end])
        at = end
    return out + encoding.encode_ordinary(text[at:])


def word_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where words begin: at each nonempty text's start and at single spaces between characters that are not white space."""
    n = len(data)
    cut = np.zeros(n, bool)
    if n > 2:
        before = _PLAIN[data]
        before[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & _TWO_BYTE_LEAD[data[:-1]]
        cut[1:-1] = (data[1:-1] == 0x20) & before[:-2] & _NEXT[data[2:]]
    starts = offsets[:-1][offsets[:-1] < offsets[1:]]
    # A space at either edge of a text looks at the text beside it, so it is no cut.
    cut[starts[starts > 0] - 1] = False
    cut[starts] = True
    return np.flatnonzero(cut)


def _blocks(docs: DataFrame, schema: str, emit) -> DataFrame:
    """``emit`` of each block of texts: a run of rows with about ``ASSEMBLY_BYTES``."""
    def run(batches):
        got, size = [], 0
        for batch in batches:
            for at, end, data, offsets in tx.blocks(batch.column("text")):
                got.append((batch.column("doc_id").slice(at, end - at), data, offsets))
                size += len(data)
                if size >= ASSEMBLY_BYTES:
                    yield emit(_Block(got))
                    got, size = [], 0
                    tx.release()
        if got:
            yield emit(_Block(got))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(tx.tidy_batches(run), schema)


class _Block:
    """A block's words: ``where`` has the place of each among the ``distinct`` hashes, ``first`` where one stands."""

    def __init__(self, got: list[tuple[pa.Array, np.ndarray, np.ndarray]]):
        hashes, starts, ends, counts, base = [], [], [], [], 0
        for _, data, offsets in got:
            at = word_starts(data, offsets)
            end = np.append(at[1:], len(data)) if len(at) else at
            hashes.append(tx.span_hashes(data, at, end))
            starts.append(at + base)
            ends.append(end + base)
            counts.append(np.diff(np.searchsorted(at, offsets)))
            base += len(data)
        self.data = np.concatenate([x[1] for x in got])
        self.starts, self.ends = np.concatenate(starts), np.concatenate(ends)
        self.distinct, self.first, self.where, self.times = np.unique(
            np.concatenate(hashes), return_index=True, return_inverse=True, return_counts=True)
        self.counts = np.concatenate(counts).astype(np.uint32)
        self.doc_id = pa.concat_arrays([x[0] for x in got])
        # Known by its content, so that a second run over the same rows finds the same blocks.
        ids = b",".join(str(x).encode() for x in self.doc_id.to_pylist())
        name = hashlib.blake2b(ids, digest_size=8)
        for part in (self.distinct, self.times, self.counts):
            name.update(part.tobytes())
        self.name = int.from_bytes(name.digest(), "little", signed=True)


def _pressed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)


def _unpressed(raw: bytes) -> bytes:
    return pa.decompress(raw[8:], decompressed_size=int.from_bytes(raw[:8], "little"), codec="zstd", asbytes=True)


def _by_frequency(times: np.ndarray) -> np.ndarray:
    return np.argsort(-times.astype(np.int64), kind="stable")


def _positions(block: _Block) -> pa.RecordBatch:
    """The rows' ids and word counts, and each word's rank by frequency in the block, a byte plane at a time."""
    rank = np.empty(len(block.times), np.uint32)
    rank[_by_frequency(block.times)] = np.arange(len(block.times), dtype=np.uint32)
    planes = rank[block.where].view(np.uint8).reshape(-1, 4).T.tobytes()
    binary = lambda x: pa.array([_pressed(x)], pa.binary())
    return pa.record_batch(
        [pa.array([block.name]), pa.array([-1], pa.int32()), binary(block.counts.tobytes()), binary(block.times.astype(np.uint32).tobytes()),
         tx.ragged(block.doc_id, [len(block.doc_id)]), binary(planes)], ["block", "bucket", "counts", "ids", "doc_id", "places"])


def _words(buckets: int):
    """The distinct words by bucket of their hash, in order of hash."""
    def emit(block: _Block) -> pa.RecordBatch:
        bucket = packed.bucket_of(block.distinct, buckets)
        there, at = np.unique(bucket, return_index=True)
        raw, a, b = block.data.tobytes(), block.starts[block.first], block.ends[block.first]
        words, lengths = [], []
        for i, j in zip(at.tolist(), [*at[1:].tolist(), len(bucket)]):
            words.append(_pressed(b"".join([raw[x:y] for x, y in zip(a[i:j].tolist(), b[i:j].tolist())])))
            lengths.append(_pressed((b[i:j] - a[i:j]).astype(np.uint32).tobytes()))
        return pa.record_batch([pa.array(there), pa.array(np.full(len(there), block.name)), pa.array(words, pa.binary()), pa.array(lengths, pa.binary())],
                               ["bucket", "block", "words", "lengths"])
    return emit


def _encode_bucket(path: str, pattern: str):
    def run(table: pa.Table) -> pa.Table:
        encoding, known = _encoder(path, pattern), {}
        counts, ids = [], []
        for words, lengths in zip(table.column("words").to_pylist(), table.column("lengths").to_pylist()):
            words = _unpressed(words)
            ends = np.cumsum(np.frombuffer(_unpressed(lengths), np.uint32), dtype=np.int64).tolist()
            found, at = [], 0
            for end in ends:
                word, at = words[at:end], end
                if (got := known.get(word)) is None:
                    got = known[word] = array("I", _ids(encoding, word.decode()))
                found.append(got)
            counts.append(_pressed(np.array([len(x) for x in found], np.uint32).tobytes()))
            ids.append(_pressed(_narrow(np.frombuffer(b"".join(found), np.uint32))))
        return pa.table([table.column("block"), table.column("bucket"), pa.array(counts, pa.binary()), pa.array(ids, pa.binary())],
                        ["block", "bucket", "counts", "ids"])
    return run


def _narrow(ids: np.ndarray) -> bytes:
    """Ids as low halves, then high halves if any is not zero."""
    low, high = ids.astype(np.uint16), (ids >> 16).astype(np.uint16)
    return b"\1" + low.tobytes() + high.tobytes() if high.any() else b"\0" + low.tobytes()


def _wide(raw: bytes) -> np.ndarray:
    halves = np.frombuffer(raw, np.uint16, offset=1)
    return halves[:len(halves) // 2].astype(np.int32) | halves[len(halves) // 2:].astype(np.int32) << 16 if raw[0] else halves.astype(np.int32)


def _assemble(path: str | None):
    """Ids of a block's rows in order, and with ``path`` the bytes that they stand for."""
    def run(table: pa.Table) -> pa.Table:
        return _assembled(table, path)
    return run


def _decoded(ids: np.ndarray, ends: np.ndarray, path: str) -> pa.Array:
    """Bytes of each run of ids by the token-byte table; an id outside it is an error."""
    table, out, at = token_bytes(path), [], 0
    for end in ends.tolist():
        out.append(b"".join(map(table.__getitem__, ids[at:end].tolist())))
        at = end
    return pa.array(out, pa.binary())


def _assembled(table: pa.Table, path: str | None) -> pa.Table:
    rows = sorted(table.to_pylist(), key=lambda r: r["bucket"])
    whole = [r for r in rows if r["bucket"] < 0]
    # A block that comes twice has its parts twice, equal ones side by side.
    parts = [r for r in rows if r["bucket"] >= 0][::max(1, len(whole))]
    read = lambda raw: np.frombuffer(_unpressed(raw), np.uint32)
    per_word = np.concatenate([read(r["counts"]) for r in parts] or [np.zeros(0, np.uint32)]).astype(np.int64)
    ids = np.concatenate([_wide(_unpressed(r["ids"])) for r in parts] or [np.zeros(0, np.int32)])
    first = np.concatenate(([0], np.cumsum(per_word)))
    out = []
    for row in whole:
        by_frequency = _by_frequency(read(row["ids"]))
        if len(by_frequency) != len(per_word):
            raise ValueError("words of a block did not come back")
        planes = np.frombuffer(_unpressed(row["places"]), np.uint8).reshape(4, -1)
        where = by_frequency[np.ascontiguousarray(planes.T).view(np.uint32).ravel()]
        del planes
        words = np.concatenate(([0], np.cumsum(read(row["counts"]), dtype=np.int64)))
        doc_id = pa.array(row["doc_id"], pa.int64())
        # Whole rows at a time, as places and ids in full width are many times the text.
        at = 0
        while at < len(doc_id):
            to = max(at + 1, int(np.searchsorted(words, words[at] + LAYOUT_WORDS, side="right")) - 1)
            part = where[words[at]:words[to]]
            many = per_word[part]
            end = np.cumsum(many)
            flat = ids[np.repeat(first[part] - end + many, many) + np.arange(end[-1] if len(end) else 0)]
            ends = np.concatenate(([0], end))[words[at:to + 1] - words[at]]
            got = [doc_id.slice(at, to - at), tx.ragged(flat, np.diff(ends), pa.int32())]
            names = ["doc_id", "ids"]
            out.append(pa.table([*got, _decoded(flat, ends[1:], path)], [*names, "decoded"]) if path else pa.table(got, names))
            at = to
    return pa.concat_tables(out)


def encode(docs: DataFrame, path: str, pattern: str, back: bool = False) -> DataFrame:
    """(doc_id, ids) per row of ``docs`` (doc_id, text; other columns are ignored), ids being an int array.

    With ``back`` there is a third column ``decoded``, the bytes that the ids decode to, as ``decode`` gives them.

    A null or empty text has no ids.  Repeated rows and null doc_ids stay as they are: nothing is joined by doc_id.
    ``path`` names a rank file that every executor can read; special tokens in a text are ordinary text.  A very long
    text is one word block, and takes its task some twenty times its size; runs of white space may be of any length.
    ``pattern`` must keep white space but for a run's last character in one piece, as those of the rank files do.  The
    rows are read twice, and must come in the same order both times, as they do from files.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = "block long, bucket int, counts binary, ids binary"
    parts = _blocks(docs, "bucket int, block long, words binary, lengths binary", _words(buckets)).groupBy("bucket").applyInArrow(
        tx.tidy_table(_encode_bucket(path, pattern)), part)
    parts = parts.withColumns({"doc_id": F.lit(None).cast("array<long>"), "places": F.lit(None).cast("binary")})
    whole = _blocks(docs, f"{part}, doc_id array<long>, places binary", _positions)
    return whole.unionAll(parts).groupBy("block").applyInArrow(
        tx.tidy_table(_assemble(path if back else None)), "doc_id long, ids array<int>" + ", decoded binary" * back)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """``tokens`` (with an ``ids`` array) and the bytes that its ids stand for, as ``decoded``; null ids give no bytes.

    The token-byte table is the vocabulary, which does not grow with the data; an id outside it is an error.
    """
    kind = T.StructType([*tokens.schema.fields, T.StructField("decoded", T.BinaryType())])

    def run(batches):
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("ids"))
            ends = np.cumsum(pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
            got = _decoded(ids.flatten().to_numpy(zero_copy_only=False), ends, path)
            yield pa.record_batch([*batch.columns, got], [*batch.schema.names, "decoded"])
    return tokens.mapInArrow(tx.tidy_batches(run), kind)
