"""n-gram join and decontamination against brute force."""

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tabsmith.llm import decontaminate, ngram_join
from tabsmith.llm.components import components

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                root[find(i)] = find(j)
    lowest = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            lowest[find(i)] = min(k, lowest.get(find(i), k))
    return sorted(((k, len(s), lowest.get(find(i)) if s else k) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def test_components_are_those_of_all_links(docs, rows):
    got = ngram_join.ngram_components(docs).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_many_copies_of_copies(spark):
    """A hub with edited copies that do not all link each other, and boilerplate that most texts share."""
    import random
    rng = random.Random(3)
    hub = [f"w{i}" for i in range(80)]
    rows = []
    for k in range(60):
        words = list(hub)
        for at in rng.sample(range(80), rng.choice((1, 2, 3, 4))):
            words[at] = f"e{k}.{at}" if rng.random() < 0.7 else f"e{at}"
        rows.append((k, " ".join(words)))
    rows += [(100 + k, " ".join([f"u{k}.{i}" for i in range(30)] + hub[:40])) for k in range(20)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_components(rows)


def test_one_of_each_group_stays(docs, rows):
    kept = [r.doc_id for r in ngram_join.keep_one(docs).collect()]
    want = {k for k, _, c in brute_components(rows) if k is None or k == c}
    assert set(kept) == want
    assert kept.count(3) == 1  # the repeated row


def test_no_rows(none):
    assert ngram_join.ngram_components(none).count() == 0
    assert ngram_join.keep_one(none).columns == none.columns


def test_chain_has_one_root(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(chain.union(spark.sql("select 500L, 500L")).union(spark.sql("select 900L, 901L")))
    assert {(r.node, r.root) for r in got.collect()} == {(i, 0) for i in range(201)} | {(900, 900), (901, 900)}


def leak_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def brute_leaks(text, items, window=10):
    words, hit, found = leak_words(text), set(), set()
    for k, t in items:
        w = leak_words(t)
        if not w:
            continue
        size = min(window, len(w))
        grams = {tuple(w[i:i + size]) for i in range(len(w) - size + 1)}
        for i in range(len(words) - size + 1):
            if tuple(words[i:i + size]) in grams:
                hit.update(range(i, i + size))
                found.add(k)
    return len(words), hit, found - {None}


ITEMS = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "Three four, five!"), (30, "solo"), (4, None), (5, " .. "),
         (6, "a a a a a a a a a a a a"), (7, "three four five six seven eight nine ten eleven twelve thirteen"), (7, "solo"), (None, "null item here")]


@pytest.fixture(scope="module")
def leaky(spark, docs):
    more = [(1000 + i, t) for i, t in enumerate((
        "x one two three four five six seven eight nine ten y", "ONE-two three four five six seven eight nine nine", "three four five", "solo solo",
        "a " * 11, "a " * 9, "null item here", "q two three four five six seven eight nine ten eleven twelve thirteen", "\u00e9 three\u00e9 four five"))]
    return docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))


def test_spans_and_items(spark, leaky):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for r in decontaminate.find_leaks(leaky, items).join(leaky.withColumnRenamed("text", "t"), "doc_id", "left").where("text <=> t").collect():
        n, hit, found = brute_leaks(r.text, ITEMS)
        assert r.n_words == n and r["items"] == sorted(found)
        assert sorted(p for s in r.spans for p in range(s.start, s.end)) == sorted(hit), r.text
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_several_automata_find_the_same(spark, leaky, monkeypatch):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = {(r.doc_id, r.text): r for r in decontaminate.find_leaks(leaky, items).collect()}
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", 8)
    more = {(r.doc_id, r.text): r for r in decontaminate.find_leaks(leaky, items).collect()}
    assert one.keys() == more.keys()
    for k, r in one.items():
        assert {p for s in r.spans for p in range(s.start, s.end)} == {p for s in more[k].spans for p in range(s.start, s.end)}
        assert r["items"] == more[k]["items"]


def test_no_window_is_left(spark, leaky):
    items = [i for i in ITEMS if i[0] in (1, 7, 6)][:3]
    frame = spark.createDataFrame(items, "item_id long, text string")
    texts = {r.doc_id: r.text for r in leaky.where("doc_id is not null").collect()}
    out = decontaminate.remove_leaks(leaky.withColumn("n_chars", F.length("text")), frame, most_share=1.0).where("doc_id != 5").collect()
    assert len(out) > 40
    for r in out:
        before, after = brute_leaks(texts[r.doc_id], items)[1], brute_leaks(r.text, items)[1]
        assert not after and (before or r.text == texts[r.doc_id])
        assert r.n_chars == (None if r.text is None else len(r.text))
    strict = decontaminate.remove_leaks(leaky, frame).where("doc_id >= 1000").collect()
    assert {r.doc_id for r in strict} == {1001, 1002, 1003, 1005, 1006, 1008}


def test_empty_sides(spark, none, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.find_leaks(none, items).count() == 0
    clean = decontaminate.find_leaks(docs, items.where("false"), keep="doc_id").collect()
    assert clean and not any(r.spans or r["items"] for r in clean)
    assert hashlib.sha256(b"").hexdigest() == docs.limit(1).select(F.sha2(F.lit(""), 256)).first()[0]
