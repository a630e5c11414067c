import random

import pytest

WORDS = "the of and to in is on by it or be at as an we us so no up go do he my if me am ox ax".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) + rng.choice(("", "", ",", ".")) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """Texts with nulls, empty ones, ties, copies, near copies, control strings and one very long text."""
    rng = random.Random(7)
    base = [sentence(rng, rng.randint(3, 60)) for _ in range(30)]
    near = [t.replace(" ", "  ", 1) + " end" for t in base[10:16]]
    cut = [" ".join(t.split()[:-1]) for t in base[10:16]]
    odd = [None, "", " \n\t", "a", "a b c", "A B C", "\u00e9t\u00e9 na\u00efve \u4f60\u597d \u00a0x", "x" * 3000, "<|im_end|> it's  12,5%\r\n\n", "a b " * 40]
    return base + base[:4] + near + cut + odd + [sentence(rng, 20_000)]


@pytest.fixture(scope="session")
def rows(texts):
    """(doc_id, text): ids run on, one comes twice with one text, one twice with two texts, one is null."""
    got = [(i, t) for i, t in enumerate(texts)]
    return got + [(3, texts[3]), (5, texts[6]), (None, texts[1])]


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The rows with columns whose names the operators use themselves."""
    schema = ("doc_id long, text string, lang string, score double, predicted int, lang_pred string, n long, key long, bucket int, label long, "
              "tokens long, a long, b long, spans string, items string, n_words long, n_chars long, train string, x int, quality int")
    kinds = ("en", None, "fr", "de")
    return spark.createDataFrame([(i, t, kinds[k % 4], *[None] * 17) for k, (i, t) in enumerate(rows)], schema).repartition(3)


@pytest.fixture(scope="session")
def none(docs):
    return docs.where("false")
