"""PPM, language filters and the quality discriminant."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tabsmith.llm import langid, ppm, quality, queries
from tabsmith.llm import text as tx

PLAIN = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def trie_of(texts, order=ppm.ORDER):
    counts = Counter()
    for t in texts:
        s = [ppm.BOS] * order + list((t or "").encode()) + [ppm.END]
        for i in range(order, len(s)):
            for k in range(order + 1):
                counts[tuple(s[i - k:i]), s[i]] += 1
    return counts


def as_arrays(counts):
    pack = lambda c: sum(s << ppm.BITS * j for j, s in enumerate(reversed(c)))
    rows = [(len(c), pack(c), s, n) for (c, s), n in counts.items()]
    return dict(zip(("k", "context", "symbol", "count"), map(np.array, zip(*rows)))) | {"mark": np.uint64(1)}


def naive_log10(text, counts):
    """Method D with exclusion, symbol by symbol, by walking down from the longest known context."""
    table = defaultdict(dict)
    for (c, s), n in counts.items():
        table[c][s] = n
    s = [ppm.BOS] * ppm.ORDER + list((text or "").encode()) + [ppm.END]
    total = 0.0
    for i in range(ppm.ORDER, len(s)):
        k = max(k for k in range(ppm.ORDER + 1) if tuple(s[i - k:i]) in table)
        excluded = set()
        while k >= 0:
            here = {x: n for x, n in table[tuple(s[i - k:i])].items() if x not in excluded}
            if s[i] in here:
                total += math.log10((here[s[i]] - 0.5) / sum(here.values()))
                break
            if here:
                total += math.log10(len(here) / 2 / sum(here.values()))
            excluded |= set(here)
            k -= 1
        else:
            total -= math.log10(257 - len(excluded))
    return total


def test_automaton_is_the_walk(texts):
    counts = trie_of(texts[:20])
    automaton = ppm.Automaton(as_arrays(counts))
    sample = [t for t in texts if len(t or "") < 5000]
    (_, _, data, offsets), = tx.blocks(pa.array(sample, pa.string()))
    for t, got in zip(sample, automaton.score(data, offsets)):
        assert got == pytest.approx(naive_log10(t, counts), rel=1e-4), t


def test_probabilities_of_each_state_add_up_to_one_at_most(texts):
    a = ppm.Automaton(as_arrays(trie_of(texts[:20])))
    p = 10.0 ** a.gain.reshape(-1, a.width)
    unseen = 257 - (len(np.unique(a.column[:257])) - 1)
    total = p[:, a.column[:257][np.unique(a.column[:257], return_index=True)[1]]][:, :-1].sum(1) + p[:, a.width - 1] * unseen
    assert total.max() < 1.001 and total.min() > 0.2


def test_scores_and_base(docs, rows):
    held = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 5 == 1
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(PLAIN))
    seen = Counter()
    for i, t in rows:
        if not held(i):
            seen.update(words(t))
            seen["\0end"] += 1
    total, kinds = sum(seen.values()), len(seen)
    got = ppm.score(docs, queries.remainder(5) != 1).collect()
    trained = trie_of([t for i, t in rows if not held(i)])
    want = {}
    for i, t in rows:
        w = words(t) + ["\0end"]
        base = sum(math.log10((seen[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        want.setdefault(i, []).append((len(w), sum(seen[x] > 0 for x in w), base, t))
    assert len(got) == len(rows)
    for r in got:
        assert r.train_tokens == total and r.train == (not held(r.doc_id))
        near = [x for x in want[r.doc_id] if (r.n_tokens, r.n_known) == x[:2] and r.base_score == pytest.approx(x[2])]
        assert near
        if len(near[0][3] or "") < 500 and len(want[r.doc_id]) == 1:
            assert r.score == pytest.approx(naive_log10(near[0][3], trained), rel=1e-3)


def test_models_of_nothing(none, docs):
    assert ppm.score(none, F.lit(True)).count() == 0
    untrained = {r.doc_id: r for r in ppm.score(docs.where("doc_id < 3"), F.lit(False)).collect()}
    assert untrained[0].n_known == 0 and untrained[0].train_tokens == 0 and math.isfinite(untrained[0].base_score)
    assert langid.predict(none, langid.train(docs, F.lit(True))).count() == 0
    assert {r.lang_pred for r in langid.predict(docs, langid.train(none, F.lit(True))).collect()} == {"und"}
    assert quality.score(none, quality.fit(none, none.select("doc_id", "quality"), F.lit(True))).count() == 0
    blank = quality.score(docs, quality.fit(docs, none.select("doc_id", "quality"), F.lit(True))).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in blank) and len(blank) == docs.count()


def test_language_popcounts_by_hand(spark):
    rng = random.Random(1)
    make = lambda letters: " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 7))) for _ in range(60))
    rows = [(i, make("abcde"), "x") for i in range(30)] + [(100 + i, make("defgh"), "y") for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs, F.lit(True))
    assert model.languages == ["x", "y"]
    grams = {}
    for lang in "xy":
        n = Counter()
        for _, t, of in rows:
            if of == lang:
                n.update(g for w in t.split() for g in (lambda p: [p[i:i + 4] for i in range(len(p) - 3)])(f"\0{w}\0"))
        grams[lang] = {g for g, c in n.items() if c > 1}
    new = [make("abcdefgh"), make("abcd"), make("efgh"), "a b", "12 ..", None, ""]
    got = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate(new)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    false = model.false_rate()
    for t, r in zip(new[:3], got):
        all_grams = [g for w in t.split() for g in (lambda p: [p[i:i + 4] for i in range(len(p) - 3)])(f"\0{w}\0")]
        shares = [sum(g in grams[lang] for g in all_grams) / len(all_grams) for lang in "xy"]
        assert r.score == pytest.approx(max(shares), abs=0.02 + false.max())
        assert r.lang_pred == "xy"[shares.index(max(shares))]
    assert [(r.lang_pred, r.score) for r in got[3:]] == [("x", 0.0), ("und", 0.0), ("und", 0.0), ("und", 0.0)]


@pytest.mark.parametrize("name, truth, least", [("op4_language", "lang", 0.98), ("op7_quality", "quality", 0.9)])
def test_held_out_accuracy(spark, name, truth, least):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf).where("held_out")
    if truth == "lang":
        got = got.join(queries.documents(spark, sf).select("doc_id", "lang"), "doc_id")
        right = got.selectExpr("avg(cast(lang_pred = lang as int))").first()[0]
    else:
        got = got.join(queries.table(spark, sf, "labels"), "doc_id")
        right = got.selectExpr("avg(cast(predicted = quality as int))").first()[0]
    assert right >= least


def test_discriminant_by_hand():
    rng = np.random.default_rng(5)
    p = 3
    x = [rng.normal(size=(40, p)) @ rng.normal(size=(p, p)) + 2, rng.normal(size=(90, p)) * [1, 3, 0.5]]
    one = [np.column_stack([np.ones(len(a)), a]) for a in x]
    model = quality.discriminant(np.array([a.T @ a for a in one]), 0.3, 0.1)
    both = np.vstack(x)
    z = [(a - both.mean(0)) / both.std(0) for a in x]
    pooled = sum((a - a.mean(0)).T @ (a - a.mean(0)) for a in z) / len(both)
    logs = []
    new = rng.normal(size=(7, p)) * 2
    for a in z:
        cov = 0.7 * np.cov(a.T, bias=True) + 0.3 * pooled
        cov = 0.9 * cov + 0.1 * np.trace(cov) / p * np.eye(p)
        d = (new - both.mean(0)) / both.std(0) - a.mean(0)
        logs.append(-0.5 * np.einsum("ij,jk,ik->i", d, np.linalg.inv(cov), d) - 0.5 * np.linalg.slogdet(cov)[1] + np.log((len(a) + 0.5) / (len(both) + 1)))
    assert model.score(new) == pytest.approx(1 / (1 + np.exp(logs[0] - logs[1])))


def test_other_columns_are_kept(docs):
    out = quality.score(docs, quality.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 2 as int) as quality"), F.lit(True)))
    assert set(out.columns) == set(docs.columns) and out.count() == docs.count()


def test_every_counted_context_scores(spark):
    """More contexts than any model of fixed size had: scores are still those of the walk over all counts."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(400)) for _ in range(200)]
    counts = trie_of(texts)
    assert len({c for c, _ in counts}) > 65536
    new = [texts[0], texts[199][:50] + "?" + texts[7][50:90], "zz Zz", "", None]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t) for i, t in enumerate(new)]
    got = {r.doc_id: r.score for r in ppm.score(spark.createDataFrame(rows, "doc_id long, text string"), F.col("doc_id") < 1000).collect()}
    assert len(got) == len(rows)
    for i, t in rows[::40] + rows[-5:]:
        assert got[i] == pytest.approx(naive_log10(t, counts), rel=1e-5), t


def test_language_with_one_short_text_is_known(spark):
    """All its n-grams are in the filters, those seen once too, beside a language with very many."""
    rng = random.Random(3)
    rows = [(i, " ".join("".join(rng.choice("abcdefghijklm") for _ in range(6)) for _ in range(400)), "many") for i in range(100)]
    rows.append((1000, "zuvor wusste xylophon quartz", "few"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = langid.predict(docs, langid.train(docs, F.lit(True), least=1), share=0.9).collect()
    assert len(got) == len(rows) and all(r.lang_pred == r.lang and r.score > 0.99 for r in got)


def test_pipeline_keeps_languages_with_one_short_text(spark):
    import corpus_pipeline
    rows = [(i, "the same plain english text again and again", "en") for i in range(50)] + [(99, "zuvor wusste xylophon quartz", "few")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()} == {i for i, _, _ in rows}
