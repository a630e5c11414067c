"""Benchmark decontamination with a generalised suffix automaton of the test items.

The words of all items make one automaton.  Training tokens are streamed through it, and the longest match that ends
at each token is tracked: where it reaches a window's length, the window's words are hit.  Stretches in which some two
neighbouring words stand side by side in no item can hold no window; they are skipped by a table of word pairs.

Items that are too many for one automaton are cut into shards by hash, and texts pass one shard after the other.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabsmith.llm import text as tx

# Words of items in one automaton, about.
SHARD_WORDS = 400_000
FOUND = "n_words long, spans array<struct<start: long, end: long>>, items array<long>"


class Automaton:
    """Generalised suffix automaton over word numbers; states carry the items whose windows end there."""

    def __init__(self, items: list[tuple[int | None, str]], window: int):
        self.window = window
        ids, texts = [i for i, _ in items], pa.array([t for _, t in items], pa.string())
        words: list[np.ndarray] = []
        for _, _, data, offsets in tx.blocks(texts):
            hashes, first, _, _ = words_of(data, offsets)
            words += [hashes[a:b] for a, b in zip(first[:-1], first[1:])]
        self.vocabulary = np.unique(np.concatenate(words)) if words else np.zeros(0, np.uint64)
        numbers = [np.searchsorted(self.vocabulary, w) for w in words]
        pairs = [n[:-1].astype(np.int64) * len(self.vocabulary) + n[1:] for n in numbers]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.least = min([min(len(n), window) for n in numbers if len(n)], default=window)
        self.maybe = np.zeros(1 << 18, bool)
        self.maybe[self.vocabulary & np.uint64((1 << 18) - 1)] = True
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        sequences = [n.tolist() for n in numbers]
        for sequence in dict.fromkeys(map(tuple, sequences)):
            last = 0
            for word in sequence:
                last = self._extend(last, word)
        self._mark(ids, sequences)

    def _extend(self, last: int, word: int) -> int:
        known = self.next[last].get(word)
        if known is not None:
            return known if self.length[known] == self.length[last] + 1 else self._clone(last, word, known)
        new = self._state(self.length[last] + 1, {}, 0)
        at = last
        while at >= 0 and word not in self.next[at]:
            self.next[at][word] = new
            at = self.link[at]
        if at >= 0:
            there = self.next[at][word]
            self.link[new] = there if self.length[there] == self.length[at] + 1 else self._clone(at, word, there)
        return new

    def _state(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _clone(self, at: int, word: int, there: int) -> int:
        new = self._state(self.length[at] + 1, dict(self.next[there]), self.link[there])
        self.link[there] = new
        while at >= 0 and self.next[at].get(word) == there:
            self.next[at][word] = new
            at = self.link[at]
        return new

    def _mark(self, ids: list, sequences: list[list[int]]) -> None:
        """windows: items by the state of a whole window; short: (length, item) of items shorter than a window, by state."""
        windows: dict[int, set] = {}
        short: dict[int, set] = {}
        for item, sequence in zip(ids, sequences):
            state = 0
            for n, word in enumerate(sequence, 1):
                state = self.next[state][word]
                if n >= self.window:
                    windows.setdefault(self._cut(state), set()).add(item)
            if 0 < len(sequence) < self.window:
                while self.length[self.link[state]] >= len(sequence):
                    state = self.link[state]
                short.setdefault(state, set()).add((len(sequence), item))
        self.windows = windows
        # The nearest state with short items on the way of suffix links, itself included.
        self.short, self.near_short = short, [-1] * len(self.next)
        if short:
            for state in sorted(range(1, len(self.next)), key=self.length.__getitem__):
                self.near_short[state] = state if state in short else self.near_short[self.link[state]]

    def _cut(self, state: int) -> int:
        """The state of the last ``window`` words of what ``state`` stands for."""
        while self.length[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def stream(self, words: list[int]) -> tuple[list[tuple[int, int]], set]:
        """Merged spans of hit words, and the items hit."""
        spans: list[tuple[int, int]] = []
        items: set = set()
        state = length = 0
        for at, word in enumerate(words, 1):
            while word not in self.next[state] and state:
                state = self.link[state]
                length = self.length[state]
            if word not in self.next[state]:
                continue
            state, length = self.next[state][word], length + 1
            begin = at
            if length >= self.window:
                begin = at - self.window
                items |= self.windows[self._cut(state)]
            near = self.near_short[state]
            while near > 0:
                for n, item in self.short[near]:
                    if n <= length:
                        begin = min(begin, at - n)
                        items.add(item)
                near = self.near_short[self.link[near]]
            if begin < at:
                while spans and spans[-1][1] >= begin:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, at))
        return spans, items

    def find(self, hashes: np.ndarray, first: np.ndarray) -> list[tuple[list[tuple[int, int]], set]]:
        """Spans (in words of the text) and items of each text of a block."""
        out: list[tuple[list[tuple[int, int]], set]] = [([], set()) for _ in first[1:]]
        if not len(hashes) or not len(self.vocabulary):
            return out
        likely = np.flatnonzero(self.maybe[hashes & np.uint64((1 << 18) - 1)])
        place = np.minimum(np.searchsorted(self.vocabulary, hashes[likely]), len(self.vocabulary) - 1)
        known = self.vocabulary[place] == hashes[likely]
        at, number = likely[known], place[known]
        text = np.searchsorted(first, at, side="right") - 1
        beside = (at[1:] == at[:-1] + 1) & (text[1:] == text[:-1])
        pair = number[:-1].astype(np.int64) * len(self.vocabulary) + number[1:]
        beside[beside] = _within(self.pairs, pair[beside])
        edge = np.concatenate(([0], np.flatnonzero(~beside) + 1, [len(at)])) if len(at) else np.zeros(1, np.int64)
        for i in np.flatnonzero(np.diff(edge) >= self.least).tolist():
            a, b = int(edge[i]), int(edge[i + 1])
            spans, items = self.stream(number[a:b].tolist())
            if spans:
                t = int(text[a])
                base = int(at[a] - first[t])
                out[t][0].extend((x + base, y + base) for x, y in spans)
                out[t][1].update(items)
        return [(merge(spans), items) for spans, items in out]


def _within(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(ordered):
        return np.zeros(len(values), bool)
    return ordered[np.minimum(np.searchsorted(ordered, values), len(ordered) - 1)] == values


def words_of(data: np.ndarray, offsets: np.ndarray):
    """Hashes of the normalised words, the index of each text's first, and the words' starts and ends in the bytes."""
    data = tx.LOWER[data]
    starts, ends, first = tx.spans(data, offsets, tx.ALNUM)
    return tx.span_hashes(data, starts, ends), first, starts, ends


def _shards(benchmark: DataFrame) -> list[list[tuple[int | None, str]]]:
    """The items, a bounded number of words at a time."""
    items = benchmark.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    n = max(1, -(-chars // (4 * SHARD_WORDS)))
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    return [[(r["item_id"], r["text"]) for r in items.where(part == i).orderBy("item_id", "text").collect()] for i in range(n)]


_built: dict[str, Automaton] = {}


def _automaton(broadcast) -> Automaton:
    mark, items, window = broadcast.value
    if mark not in _built:
        _built.clear()
        _built[mark] = Automaton(items, window)
    return _built[mark]


def find_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, keep: str = "*") -> DataFrame:
    """``docs`` with n_words, spans (of hit words, from 0, end exclusive, sorted, disjoint) and items (sorted ids).

    A window is ``window`` consecutive words of an item of ``benchmark`` (item_id, text), or a shorter item whole; a
    word of a text is hit inside any occurrence of a window.  Null texts and items have no words; an item with a null
    id hits words but is not among the items; repeated items count once.  Repeated rows are each judged for themselves.
    A very long text is streamed once, and takes its task some twenty times its size.  Columns of ``docs`` with the names of the
    result are replaced.  ``keep`` names the columns to keep, separated by commas.
    """
    new = [f.name for f in T._parse_datatype_string(FOUND).fields]
    names = [n for n in docs.columns if n not in new] if keep == "*" else keep.split(",")
    text = "text" if "text" in names and dict(docs.dtypes)["text"] == "string" else "_text"
    broadcasts = [docs.sparkSession.sparkContext.broadcast((f"{window} {len(x)} {hash(tuple(x))}", x, window)) for x in _shards(benchmark)]
    return _with_found(docs, broadcasts, names, text).drop("_text")


def _with_found(docs: DataFrame, broadcasts: list, names: list[str], text: str) -> DataFrame:
    """The rows with the columns of what is found, after a pass for each shard of the items."""
    own = [F.col("text").cast("string").alias(text)] if text == "_text" else []
    rows = docs.select(*(F.col(f"`{n}`") for n in names), *own, *(F.lit(None).cast(f.dataType).alias(f.name) for f in T._parse_datatype_string(FOUND).fields))
    for broadcast in broadcasts:
        rows = rows.mapInArrow(tx.tidy_batches(_finder(broadcast, text)), rows.schema)
    return rows


def _finder(broadcast, text: str):
    def run(batches):
        automaton = _automaton(broadcast)
        for batch in batches:
            if not batch.num_rows:
                continue
            before = list(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist()))
            words, found = [], []
            for at, _, data, offsets in tx.blocks(batch.column(text)):
                hashes, first, _, _ = words_of(data, offsets)
                words.append(np.diff(first))
                for (spans, items), (old, known) in zip(automaton.find(hashes, first), before[at:]):
                    if old:
                        spans = merge(spans + [(x["start"], x["end"]) for x in old])
                    found.append((spans, sorted(items.difference([None]).union(known or []))))
            flat = np.array([x for spans, _ in found for x in spans], np.int64).reshape(-1, 2)
            spans = pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["start", "end"])
            new = [pa.array(np.concatenate(words)), tx.ragged(spans, [len(s) for s, _ in found]),
                   tx.ragged(np.array([i for _, items in found for i in items], np.int64), [len(i) for _, i in found])]
            yield pa.record_batch(batch.columns[:-3] + new, batch.schema.names)
    return run


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def remove_leaks(docs: DataFrame, benchmark: DataFrame, window: int = 10, most_words: int = 20, most_share: float = 0.2) -> DataFrame:
    """``docs`` (doc_id, text, ...) without leaked passages; untouched texts stay as they are.

    A text goes if a hit span is longer than ``most_words`` or the spans cover more than ``most_share`` of its words;
    shorter spans are cut out of the text, and a blank line stands in their place.  If the words around a cut make a
    new window, that is cut as well.  A number column ``n_chars``, if there
    is one, follows a text that was cut.
    """
    given = docs.columns
    # Own names while at work, so that no column of the rows is in the way.
    names = [n if n == "text" else f"_c{i}" for i, n in enumerate(given)]
    chars = names[given.index("n_chars")] if dict(docs.dtypes).get("n_chars") in ("int", "bigint") else None
    docs = docs.toDF(*names)
    shards = _shards(benchmark)
    broadcasts = [docs.sparkSession.sparkContext.broadcast((f"{window} {len(x)} {hash(tuple(x))}", x, window)) for x in shards]

    def cut(text: str, spans: list[tuple[int, int]]) -> str:
        automata = [Automaton(b.value[1], window) for b in broadcasts] if len(broadcasts) > 1 else [_automaton(broadcasts[0])]
        while spans:
            raw = text.encode()
            data = np.frombuffer(raw, np.uint8)
            _, _, starts, ends = words_of(data, np.array([0, len(data)]))
            out, at = [], 0
            for a, b in spans:
                out.append(raw[at:starts[a]].rstrip())
                at = ends[b - 1]
            text = b"\n\n".join([*out, raw[at:].lstrip()]).decode().strip()
            hashes, first, _, _ = words_of(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
            spans = merge([s for a in automata for s in a.find(hashes, first)[0][0]])
        return text

    def run(batches):
        for batch in _finder(broadcasts[-1], "text")(batches):
            spans = [[(x["start"], x["end"]) for x in s] for s in batch.column("spans").to_pylist()]
            words = batch.column("n_words").to_pylist()
            keep = [max((b - a for a, b in s), default=0) <= most_words and sum(b - a for a, b in s) <= most_share * n for s, n in zip(spans, words)]
            at = batch.schema.get_field_index("text")
            if any(spans):
                old = batch.column("text").to_pylist()
                texts = [cut(t, s) if s and k else t for t, s, k in zip(old, spans, keep)]
                batch = batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))
                if chars:
                    n = batch.schema.get_field_index(chars)
                    sizes = [len(t) if s else before for t, s, before in zip(texts, spans, batch.column(n).to_pylist())]
                    batch = batch.set_column(n, batch.schema.field(n), pa.array(sizes, batch.schema.field(n).type))
            yield batch.select(names).filter(pa.array(keep))
    found = _with_found(docs, broadcasts[:-1], names, "text")
    return found.mapInArrow(tx.tidy_batches(run), docs.schema).toDF(*given)
