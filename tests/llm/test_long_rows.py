"""One very long row of a kind that is hard on an operator: whole results, in little time."""

import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tabsmith.llm import bpe, decontaminate, page_diff

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(autouse=True)
def soon():
    start = time.time()
    yield
    assert time.time() - start < 60


@pytest.fixture(scope="module")
def library():
    ranks = {b: i for i, b in enumerate(bpe.token_bytes(RANKS)) if b}
    return tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("text", [
    "a" + " " * 5000 + "b", " " * 1000, "a" + "\n" * 3001, "x" + "\t \n" * 700 + "12", "　" * 1500 + "q", "\x1c" * 1500 + " r",
    "a" + " " * 999 + "b" + " " * 1000 + "'s" + "\n" * 1001 + "!" + "\r\n" * 600])
def test_runs_of_white_space_as_the_library(library, text):
    assert bpe._ids(library, text) == library.encode_ordinary(text)


def test_millions_of_blanks(spark):
    texts = ["a" + c * 2_000_000 + "b" for c in " \n\t"] + ["a b"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, back=True).collect()
    assert len(got) == 4 and all(r["decoded"] == texts[r["doc_id"]].encode() for r in got)


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    return row[-1]


def test_common_of_lines_that_repeat():
    rng = random.Random(4)
    for kinds, n, m in ((2, 700, 600), (3, 500, 900), (40, 300, 300), (1, 50, 400)):
        a, b = [rng.randrange(kinds) for _ in range(n)], [rng.randrange(kinds) for _ in range(m)]
        found = page_diff.common(a, b)
        assert found == sorted(set(found)) and len(found) == longest(a, b)
        at = iter(b)
        assert all(any(a[i] == y for y in at) for i in found)


def test_common_of_many_equal_lines():
    a = [7] * 50_000
    assert page_diff.common(a, a) == list(range(50_000)) and len(page_diff.common(a, [1, *a[1:], 2])) == 49_999
    rng = random.Random(5)
    x, y = ([rng.randrange(2) for _ in range(20_000)] for _ in range(2))
    assert len(page_diff.common(x, y)) > 16_000


def test_many_open_tags():
    html = "<div>" * 25_000 + "<b>x</b>" + "<section><i>y" * 25_000 + "</nav></p>z</div>"
    assert [t for _, t in page_diff.lines_of(html)][-1] == "z"


def test_pages_of_equal_lines(spark):
    body = "<p>same</p>" * 30_000
    rows = [(i, f"http://h.org/a/{i}", f"<body>{body}<p>own {i}</p></body>") for i in range(2)]
    got = {r["page_id"]: r["text"] for r in page_diff.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {0: "own 0", 1: "own 1"}


def test_many_hit_stretches(spark):
    item = "one two three four five six seven eight nine ten"
    text = f"{item} other " * 100_000
    docs = spark.createDataFrame([(0, text)], "doc_id long, text string")
    got = decontaminate.find_leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string"), keep="doc_id").selectExpr("size(spans) as n", "n_words", "items").first()
    assert tuple(got) == (100_000, 1_100_000, [5])


def test_merged_spans():
    rng = np.random.default_rng(3)
    spans = [(int(a), int(a + n)) for a, n in zip(rng.integers(0, 300, 60), rng.integers(1, 9, 60))]
    covered = sorted({p for a, b in spans for p in range(a, b)})
    assert [p for a, b in decontaminate.merge(spans) for p in range(a, b)] == covered
