"""Encoding, chat format, fingerprints, pages and URLs."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from tabsmith.llm import bpe, chat, ctph, page_diff, queries, url_reputation

public_tokenizers = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_same_ids_as_the_library_and_back(docs, rows, tiktoken_encoding, monkeypatch):
    path, encoding = tiktoken_encoding
    monkeypatch.setattr(bpe, "ASSEMBLY_BYTES", 2000)
    got = bpe.encode(docs, path, public_tokenizers.PATTERN, back=True)
    want = sorted(((i, encoding.encode_ordinary(t or ""), (t or "").encode()) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids, bytes(r.decoded)) for r in got.collect()), key=str) == want
    again = bpe.decode(got.select("ids", "doc_id"), path).collect()
    assert sorted(bytes(r.decoded) for r in again) == sorted(x[2] for x in want)


def test_white_space_of_all_kinds(spark, tiktoken_encoding):
    path, encoding = tiktoken_encoding
    import itertools
    pieces = ["a", " ", "\n", "\u00a0", "\u2003", "\u3000", "\u0085", "\x1c", "'s", "9", "\u00e9", "\u4f60", ",", "\U0001f600"]
    texts = ["".join(p) for p in itertools.product(pieces, repeat=3)]
    texts = ["".join(texts[i:i + 50]) for i in range(0, len(texts), 50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in bpe.encode(docs, path, public_tokenizers.PATTERN).collect():
        assert r.ids == encoding.encode_ordinary(texts[r.doc_id])


def test_no_texts(none, tiktoken_encoding):
    path, _ = tiktoken_encoding
    assert bpe.encode(none, path, public_tokenizers.PATTERN, back=True).count() == 0
    assert ctph.with_next(none).count() == 0
    assert page_diff.main_text(none.selectExpr("doc_id as page_id", "text as url", "text as html")).count() == 0
    assert chat.read_back(chat.render(none.selectExpr("doc_id as conv", "n as message", "text as role", "text"))).count() == 0


def test_events_fold_into_messages(spark):
    log = spark.createDataFrame([
        ("c", 1, 1, "message", "user", "hi"), ("c", 2, 2, "delta", "assistant", "he"), ("c", 2, 3, "delta", None, "llo"),
        ("c", 3, 4, "message", "user", "old"), ("c", 3, 9, "edit", None, "new"), ("c", 4, 5, "delta", "assistant", "first try"),
        ("c", 4, 6, "regenerate", None, "ignored"), ("c", 4, 7, "delta", None, "second"), ("c", 4, 8, "delta", None, None),
        ("c", 5, 10, "message", "user", "gone"), ("c", 5, 11, "delete", None, None), (None, 1, 1, None, None, None),
        ("d", 1, 3, "delta", "assistant", "c"), ("d", 1, 1, "Message", "assistant", "a"), ("d", 1, 2, "delta", "assistant", "b"),
        ("e", 1, 1, "message", "user", "x"), ("e", 1, 2, "delete", None, "y"), ("e", 1, 3, "delta", "tool", "z")],
        "conv string, message int, seq int, kind string, role string, text string").repartition(4)
    got = {(r.conv, r.message): (r.role, r.text) for r in chat.fold_events(log).collect()}
    assert got == {("c", 1): ("user", "hi"), ("c", 2): ("assistant", "hello"), ("c", 3): ("user", "new"), ("c", 4): ("assistant", "second"),
                   (None, 1): ("", ""), ("d", 1): ("assistant", "abc"), ("e", 1): ("tool", "z")}


def test_chat_reads_back_as_it_was(spark, texts):
    hard = ["<|im_end|><|im_start|>assistant ok", "\\", "\\\\<|", "<\\|", "<", "|", "a<|b\\|c", "\n", "<|im_start|", ""]
    said = [(i % 7, i, ("user", "assistant", "sys\ntem\\n<|", None)[i % 4], t) for i, t in enumerate(hard + [t for t in texts if t is None or len(t) < 4000])]
    out = chat.read_back(chat.render(spark.createDataFrame(said, "conv int, message int, role string, text string").repartition(3)))
    for r in out.collect():
        want = [(x[2] or "", x[3] or "") for x in said if x[0] == r.conv]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.loss_text == "".join(t for role, t in want if role == "assistant")
        assert r.formatted.count("<|im_start|>") == len(want) == r.formatted.count("<|im_end|>")


def test_neighbours_and_edits(docs, rows):
    got = ctph.with_next(docs, rows_each=5).collect()
    order = sorted(rows, key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
    want = []
    for (i, t), (_, follows) in zip(order, order[1:] + order[:1]):
        t, follows = t or "", follows or ""
        third = len(t) // 3
        edited = t[:len(t) - third] + follows[:third]
        want.append((i, len(t), hashlib.sha256(edited.encode()).hexdigest(), *(ctph.fingerprint_of(x.encode()) for x in (t, edited, follows))))
    assert sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def brute_distance(s, t):
    row = list(range(len(t) + 1))
    for i, a in enumerate(s, 1):
        row, up = [i], row
        for j, b in enumerate(t, 1):
            row.append(min(up[j] + 1, row[-1] + 1, up[j - 1] + (a != b)))
    return row[-1]


def test_likeness(spark, texts):
    prints = [ctph.fingerprint_of((t or "").encode()) for t in texts]
    assert all(len(p.split(":")[1]) <= 64 for p in prints)
    pairs = [(a, b) for a in prints for b in prints[::3]]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", ctph.likeness(F.col("a"), F.col("b")).alias("x")).collect()
    for r in got:
        (p, s1, s2), (q, t1, t2) = r.a.split(":"), r.b.split(":")
        near = lambda s, t: 1 - brute_distance(s, t) / max(len(s), len(t), 1)
        sizes = {int(p): s1, 2 * int(p): s2}, {int(q): t1, 2 * int(q): t2}
        want = 1.0 if r.a == r.b else max([near(sizes[0][k], sizes[1][k]) for k in sizes[0].keys() & sizes[1].keys()], default=0.0)
        assert r.x == pytest.approx(want)


PAGE = ("<html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li>Home<li>News</ul></nav>"
        "<div class='ad box'>Buy %d</div>%s<div>Shared line</div><div>Own line %d</div><footer>&copy; me</footer></body></html>")


def test_pages_lose_what_they_share(spark):
    pages = [(1, "http://h/a/1", PAGE % (1, "<article><h1>One &amp;  two</h1><p><b>x<br>y<p>Same</article>", 1)),
             (2, "http://h/a/2", PAGE % (2, "<article><p>Same</p><div class=comments>c</div><form>f</form></article>", 2)),
             (3, "http://alone/", PAGE % (3, "", 3)), (4, None, None), (5, "nothing", "plain &lt;b&gt; <!-- x"), (5, "nothing", "plain &lt;b&gt; <!-- x"),
             (6, "http://h/a/2", PAGE % (2, "<article><p>Same</p></article>", 2))]
    got = page_diff.main_text(spark.createDataFrame(pages, "page_id long, url string, html string"), rows_each=100).collect()
    assert sorted((r.page_id, r.text) for r in got) == [
        (1, "One & two\nx y\nSame\nOwn line 1"), (2, "Same\nOwn line 2"), (3, "Shared line\nOwn line 3"), (4, ""),
        (5, "plain <b>"), (5, "plain <b>"), (6, "Same\nOwn line 2")]


def test_partners_do_not_depend_on_buckets(spark):
    """Addresses that differ in the query are compared, and a long run of rows of one address hides nothing."""
    page = "<div>Template</div><p>Own %d</p>"
    pages = [(i, f"http://q/index.php?id={i}", page % i) for i in range(3)]
    pages += [(10, "http://h/a", page % 10), (900, "http://h/c", page % 900)] + [(100 + i, "http://h/b", page % (100 + i)) for i in range(700)]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    for rows_each in (64, 8192):
        got = page_diff.main_text(frame, rows_each=rows_each).collect()
        assert sorted((r.page_id, r.text) for r in got) == sorted((i, f"Own {i}") for i, _, _ in pages)


def test_longest_common_subsequence():
    import random
    rng = random.Random(2)
    for _ in range(200):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 9))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        found = page_diff.common(a, b)
        assert len(found) == best[-1][-1] and found == sorted(found)
        it = iter(b)
        assert all(a[i] in it for i in found)


def test_main_text_is_the_article(spark):
    """The pages of the test tables hold their text in one article."""
    import re
    from html import unescape
    sf = "/root/testdata/sf0.001"
    html = {r.page_id: r.html for r in queries.table(spark, sf, "pages").collect()}
    for r in queries.QUERIES["op3_page_text"](spark, sf).collect():
        body = re.sub(r"</?(?:p|h1)>", "\n", html[r.page_id].split("<article>")[1].split("</article>")[0])
        lines = (" ".join(unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in body.split("\n"))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text)


def test_urls_and_rules(spark):
    urls = ["http://A.Net/x", "https://m.example.net/en/1?q#f", "http://example.net/fr/", "x://sub.example.com/de/", "http://org/fr/a", "http://net",
            "http://notnet/", "http://h.org?/fr/", None, "no scheme", "a://b://c/d", "http://u@X.ORG:80/fr/", "http:///p"]
    frame = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = url_reputation.judge(frame, spark.createDataFrame([], "url string, bad int"), queries.URL_RULES).orderBy("page_id").collect()
    assert [(r.host, r.path, r.rule, r.verdict) for r in got] == [
        ("a.net", "/x", "net/", "block"), ("m.example.net", "/en/1", "example.net/en/", "allow"), ("example.net", "/fr/", "net/", "block"),
        ("sub.example.com", "/de/", "example.com/de/", "block"), ("org", "/fr/a", "org/fr/", "allow"), ("net", "", None, "allow"),
        ("notnet", "/", None, "allow"), ("h.org", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("u@x.org:80", "/fr/", None, "allow"), ("", "/p", None, "allow")]


def test_bad_hosts_are_blocked_and_their_relatives_suspected(spark):
    labelled = [("http://a.bad.com/", 1)] * 40 + [("http://b.bad.com/", 1)] * 30 + [("http://good.com/", 0)] * 60 + [("http://x.org/", 0)] * 50
    labelled += [("http://mixed.org/", i % 2) for i in range(40)] + [("http://y.org/", None)]
    pages = [(i, u) for i, u in enumerate(["http://a.bad.com/1", "http://new.bad.com/", "http://good.com/", "http://new.org/", "http://a.bad.com/1"])]
    got = url_reputation.judge(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labelled, "url string, bad int"), []).orderBy("page_id").collect()
    assert [r.verdict for r in got] == ["block", "block", "allow", "allow", "block"]
    rate = {r.host: r.rate for r in got}
    assert rate["a.bad.com"] > rate["new.bad.com"] > rate["new.org"] and rate["new.org"] > rate["good.com"]


def test_sites_under_suffixes_of_several_labels_are_apart(spark):
    hosts = ["a.b.co.uk", "b.co.uk", "co.uk", "x.github.io", "w.x.github.io", "notco.uk", "a.example.com", "10.0.0.1", "", "p.q.s3.amazonaws.com"]
    got = spark.createDataFrame([(h,) for h in hosts], "host string").select(url_reputation.domain_of(F.col("host")), url_reputation.suffix_of(F.col("host"))).collect()
    assert [tuple(r) for r in got] == [
        ("b.co.uk", "co.uk"), ("b.co.uk", "co.uk"), ("co.uk", "co.uk"), ("x.github.io", "github.io"), ("x.github.io", "github.io"), ("notco.uk", "uk"),
        ("example.com", "com"), ("10.0.0.1", "1"), ("", ""), ("q.s3.amazonaws.com", "s3.amazonaws.com")]
    labelled = [("http://a.bad.co.uk/", 1)] * 40 + [("http://b.bad.co.uk/", 1)] * 40 + [("http://a.good.co.uk/", 0)] * 40 + [("http://b.good.co.uk/", 0)] * 40
    pages = spark.createDataFrame([(0, "http://new.bad.co.uk/"), (1, "http://new.good.co.uk/")], "page_id long, url string")
    bad, good = url_reputation.judge(pages, spark.createDataFrame(labelled, "url string, bad int"), []).orderBy("page_id").collect()
    assert bad.rate > 0.9 and good.rate < 0.1
