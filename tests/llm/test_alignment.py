import hashlib
import os
from collections import Counter, defaultdict

import public_tokenizers
import pytest

from tabsmith.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = ["▁a b", "<s> </s> <unk>", "a<|endoftext|>b", "<0x41>", "\x00a", "é  z   q", "  two  spaces ", " ", "\n\n x\ty", "\U0001F600\U0001F1E9 你好　世",
       "don't we'LL 12,345.67", "x" * 500, "a" + " " * 70 + "b", "café ﬁ ½ Ⅳ", "\r\n", "tab\t\ttab  \n  end"]


@pytest.fixture(scope="module")
def all_rows(rows):
    return rows + [(900 + i, t) for i, t in enumerate(ODD)] + [(900, ODD[3]), (None, ODD[5])]


def plain(texts):
    """Ids and bytes of both tokenizers over whole texts, straight from the libraries; None where the bytes differ."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import sentencepiece
    from tokenizers import Tokenizer, decoders
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    for t in texts:
        x, y = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        said_b = b"".join(bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode() for i in y for p in [b.id_to_piece(i)])
        good = bool(t) and decoders.ByteLevel().decode([a.id_to_token(i) for i in x]) == " " + t and said_b == (" " + t).encode()
        yield (x, y) if good else ([], [])


def sizes():
    aligner = alignment._aligner(A, B)
    return aligner.sizes


def by_hand(x, y):
    """Groups and links by the byte ranges of all tokens."""
    size_a, size_b = sizes()
    owner = [[k for k, i in enumerate(ids) for _ in range(size[i])] for ids, size in ((x, size_a), (y, size_b))]
    assert len(owner[0]) == len(owner[1])
    links = Counter((x[i], y[j]) for i, j in set(zip(*owner)))
    edges = [{k for k in range(1, len(o) + 1) if k == len(o) or o[k] != o[k - 1]} for o in owner]
    groups, at = [], 0
    for end in sorted(edges[0] & edges[1]):
        groups.append(",".join(str(x[i]) for i in sorted(set(owner[0][at:end]))) + "|" + ",".join(str(y[i]) for i in sorted(set(owner[1][at:end]))))
        at = end
    return groups, links


def test_scores_by_brute_force(spark, all_rows, monkeypatch):
    monkeypatch.setattr(alignment, "SHARD_BYTES", 4000)
    found = [(i, x, y, *by_hand(x, y)) for (i, _), (x, y) in zip(all_rows, plain([t for _, t in all_rows]))]
    held, top = Counter(p for *_, links in found for p in links), defaultdict(int)
    for (a, _), n in held.items():
        top[a] = max(top[a], n)
    want = [(i, len(x), len(y), len(g), sum(k.values()), sum(n for p, n in k.items() if held[p] == top[p[0]]), sum(n * held[p] for p, n in k.items()),
             hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for i, x, y, g, k in found]
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in all_rows], "doc_id long, text string, block int, `a` string").repartition(3)
    got = alignment.score(docs, A, B)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert sum(1 for r in want if r[1] == 0) >= 3 and any(r[5] < r[4] for r in want)


def test_groups_are_given_back(spark, all_rows):
    docs = spark.createDataFrame(all_rows, "doc_id long, text string").repartition(3)
    got = Counter()
    for r in alignment.align(docs, A, B).collect():
        cut = lambda ids, ends: [",".join(map(str, ids[i:j])) for i, j in zip([0, *ends], ends)]
        got[r["doc_id"], ";".join(f"{x}|{y}" for x, y in zip(cut(r["a"], r["group_a"]), cut(r["b"], r["group_b"])))] += 1
    want = Counter((i, ";".join(by_hand(x, y)[0])) for (i, _), (x, y) in zip(all_rows, plain([t for _, t in all_rows])))
    assert got == want


def test_forgetting_changes_nothing(monkeypatch):
    import numpy as np
    monkeypatch.setattr(alignment, "MEMO_WORDS", 2)
    aligner = alignment.Aligner(A, B)
    for text in ("one two three, four", "two three, five  six", "one two three, four") * 2:
        data = np.frombuffer(text.encode(), np.uint8)
        block = aligner.block(data, np.array([0, len(data)]))
        (x, y), = plain([text])
        assert block.texts() == [";".join(by_hand(x, y)[0])] and block.flat("a")[0].tolist() == x and block.flat("b")[0].tolist() == y


def packed(texts):
    import numpy as np
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


def test_remembered_words_take_little_room():
    """An executor's two workers remember 400,000 words each beside the JVM."""
    import random
    import tracemalloc
    rng = random.Random(3)
    words = ["".join(rng.choice(("an", "the", "re", "on", "ti", "ou", "est", "ing")) for _ in range(6)) + str(i) for i in range(20_000)]
    aligner = alignment.Aligner(A, B)
    aligner.block(*packed(["some words first"]))
    tracemalloc.start()
    try:
        for k in range(0, len(words), 4000):
            aligner.block(*packed([" ".join(words[k:k + 4000])]))
        assert len(aligner.words) > 20_000 and tracemalloc.get_traced_memory()[0] < 400 * len(words)
    finally:
        tracemalloc.stop()


def test_words_and_windows_whose_hashes_meet(all_rows, monkeypatch):
    import numpy as np
    texts = ["\u2581a b", "one two three", "two three, four  five", "one\u2581 two"] + [t for _, t in all_rows[:12] if t]
    hashes = alignment.tx.span_hashes
    monkeypatch.setattr(alignment.tx, "span_hashes", lambda *x: hashes(*x) % np.uint64(3))
    aligner = alignment.Aligner(A, B)
    for some in ([texts[0]], texts, texts[::-1]):
        block = aligner.block(*packed(some))
        found = [(x, y) for x, y in plain(some)]
        assert block.texts() == [";".join(by_hand(x, y)[0]) if x else "" for x, y in found]
        assert block.flat("a")[0].tolist() == [i for x, _ in found for i in x] and block.flat("b")[0].tolist() == [i for _, y in found for i in y]


def test_whole_texts_where_pieces_reach_over_words(all_rows):
    """Without cuts at words the results are the same."""
    import numpy as np
    texts = [t for _, t in all_rows if t]
    aligner, whole = alignment.Aligner(A, B), alignment.Aligner(A, B)
    whole.b.by_word = False
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    one, other = aligner.block(data, offsets), whole.block(data, offsets)
    assert one.texts() == other.texts() and one.n_groups().tolist() == other.n_groups().tolist()
    assert sorted(one.flat("b")[0].tolist()) == sorted(other.flat("b")[0].tolist())


def test_a_million_blanks_and_one_long_word(spark):
    rows = [(0, "a" + " " * 1_000_000 + "b"), (1, "x" * 300_000), (2, "\n" * 300_000)]
    got = {r["doc_id"]: r for r in alignment.score(spark.createDataFrame(rows, "doc_id long, text string"), A, B).collect()}
    assert all(r["n_links"] >= max(r["n_a"], r["n_b"]) > 0 for r in got.values())


def test_alignment_of_an_empty_table(none):
    assert alignment.score(none, A, B).collect() == [] and alignment.align(none, A, B).collect() == []
