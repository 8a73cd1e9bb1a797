import random

import pytest

random.seed(7)
SYLLABLES = ["an", "er", "ti", "on", "the", "re", "st", "en", "ou", "é", "ß", "in"]


def prose(n, rng):
    return " ".join("".join(rng.choices(SYLLABLES, k=rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Small documents with nulls, empty texts, copies, near copies, shared passages and odd white space."""
    rng = random.Random(11)
    passage = prose(70, rng)
    base = [prose(rng.randint(30, 160), rng) for _ in range(40)]
    texts = [None, "", "   \n\t ", "one", "a b c", "A B c", "x\x0by\x0cz\r\nq"]
    texts += base
    texts += [base[0], base[0], base[1], base[2] + " tail words", "head " + base[3]]
    texts += [t + " " + passage for t in base[5:9]] + [passage + "\n" + t for t in base[9:12]]
    texts += ["\n".join([prose(12, rng), "Shared  Line for all of the host pages here", prose(25, rng)]) for _ in range(45)]
    texts += ["\n".join([base[4][:200], base[4][:200], base[4][:200]])]
    texts += [" ".join(["again and again"] * 40), "### $$$ %% & | <> " * 10]
    near = base[20].split(" ")
    for k in range(6):
        edit = list(near)
        edit[k * 3] = "changed%d" % k
        texts.append(" ".join(edit))
    texts += [prose(6000, rng)]
    return [(i * 3 % 331, t, "h%d" % (i % 3) if i % 17 else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus with extra columns whose names the operators use inside."""
    rows = [(i, t, "en", h, len(t or ""), 1.5, "x", 3, True) for i, t, h in corpus]
    names = "doc_id long, text string, lang string, source string, n_chars long, hash double, key string, size int, rank boolean"
    return spark.createDataFrame(rows, names)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture(scope="session")
def null_rows(spark):
    """Rows of nulls and rows repeated with one id."""
    rows = [(None, None, None, None, None), (None, "a b", None, None, 3), (5, None, "en", "s", 0)] + [(7, "w " * 60, "en", "s", 120)] * 3
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
