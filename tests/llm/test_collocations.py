import random
import re
from collections import Counter, defaultdict

import numpy as np

from tabsmith.llm import collocations as co
from tabsmith.llm import text as tx


def by_hand(rows, least, longest=5, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, longest + 1):
                f[lang].update(tuple(words[i:i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, counts in f.items():
        often = {g: n for g, n in counts.items() if n >= least}
        inside = {h for g, n in often.items() for i in range(len(g)) for j in range(i + 1, len(g) + 1) for h in [g[i:j]] if len(h) < len(g) and counts[h] <= n}
        found = []
        for g, a in often.items():
            if len(g) > 1 and g not in inside:
                score, _, l, r = min((1000 * a * total[lang] // (counts[g[:k]] * counts[g[k:]]), k, counts[g[:k]], counts[g[k:]]) for k in range(1, len(g)))  # noqa: E741
                found.append((-score, -a, " ".join(g).encode(), l, r))
        for rank, (score, a, g, l, r) in enumerate(sorted(found)[:top], 1):  # noqa: E741
            out.append((lang, rank, g.decode(), -a, l, r, total[lang], -score))
    return sorted(out)


def rows_of_phrases(texts):
    rng = random.Random(3)
    some = "alpha beta gamma delta Épsilon zeta eta theta iota kappa".split()
    made = [" ".join(rng.choice(some) + rng.choice(("", "", "", ",", ".", "\n", "\t")) for _ in range(rng.randint(1, 80))) for _ in range(60)]
    made += ["one fixed PHRASE here, one fixed phrase here", "a a a a a a a a", "a a a\x0ba a a", "x y \u0085 z"] * 4
    kinds = ["en", None, "und", "fr", ""]
    return [(kinds[i % 5], t) for i, t in enumerate(made + list(texts))]


def frame(spark, rows):
    return spark.createDataFrame([(x, t, 1, "p") for x, t in rows], "lang string, text string, f int, phrase string").repartition(3)


def test_phrases_by_brute_force(spark, texts, monkeypatch):
    rows = rows_of_phrases(texts)
    monkeypatch.setattr(co, "SHARD_WORDS", 300)
    monkeypatch.setattr(co, "WORD_BYTES", 2000)
    monkeypatch.setattr(co, "BUCKET_KEYS", 50)
    got = co.collocations(frame(spark, rows), least=4)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = sorted(map(tuple, got.collect()))
    assert found == by_hand(rows, 4) and len(found) > 150 and max(len(r[2].split(" ")) for r in found) == 5


def test_a_full_filter_changes_nothing(spark, texts, monkeypatch):
    rows = rows_of_phrases(texts[:40])
    monkeypatch.setattr(co, "MOST_BITS", 64)
    assert sorted(map(tuple, co.collocations(frame(spark, rows), least=5, top=7).collect())) == by_hand(rows, 5, top=7)


def test_only_pairs(spark, texts):
    rows = rows_of_phrases(texts[:20])
    assert sorted(map(tuple, co.collocations(frame(spark, rows), least=3, longest=2).collect())) == by_hand(rows, 3, 2)


def test_index_counts_patterns():
    rng = np.random.default_rng(1)
    for n, kinds in ((1, 2), (2, 2), (60, 3), (500, 4), (500, 40)):
        text = rng.integers(0, kinds, n).astype(np.int32)
        text[-1] = 0
        want = Counter(tuple(text[i:i + k].tolist()) for k in range(2, 6) for i in range(n - k + 1) if 0 not in text[i:i + k])
        got = {tuple(s.tolist()): c for symbols, counts in co.FMIndex(text, 5).intervals(5) for s, c in zip(symbols, counts)}
        assert got == want


def test_a_filter_keeps_what_it_holds():
    keys = np.random.default_rng(2).integers(0, 1 << 63, 3000).astype(np.uint64)
    slots = np.zeros(1 << 10, np.uint64)
    np.bitwise_or.at(slots, *co.Filter.places(tx.mix(keys[:1500]), len(slots)))
    held = co.Filter(slots).has(keys)
    assert held[:1500].all() and held[1500:].mean() < 0.1


def test_scores_are_whole_numbers(spark):
    """Every text is the one phrase, so 1000 * a * n / (l * r) is 1000 * n / a exactly."""
    got = co.collocations(frame(spark, [("en", "x y. " * 700)] * 9), least=100).collect()
    assert [tuple(r) for r in got] == [("en", 1, "x y", 6300, 6300, 6300, 12600, 2000)]


def test_phrases_of_an_empty_table(none):
    assert co.collocations(none).collect() == []
