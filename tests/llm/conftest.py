"""Small documents with every awkward case, for all operators."""

import random

import pytest

COLUMNS = (
    "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT, _key STRING, _text STRING, key STRING, "
    "n INT, label STRING, hash STRING, place INT, size INT, target INT, block STRING, _stats STRING, x STRING, rate STRING"
)


def words(rnd, n, stock=400):
    return " ".join(f"w{rnd.randrange(stock)}" for _ in range(n))


def make_rows():
    rnd = random.Random(7)
    base = words(rnd, 120)
    passage = words(rnd, 60)
    near = base.split(" ")
    near[60] = "changed"
    rows = [
        (1, base, "en", "a"),
        (2, base, "en", "a"),  # exact copy
        (3, " ".join(near), "en", "b"),  # near copy
        (4, words(rnd, 50) + "\n" + passage + " " + words(rnd, 30), "en", "b"),
        (5, passage + "\n\n" + words(rnd, 40), "de", "b"),
        (6, None, "en", "a"),
        (7, "", "fr", None),
        (8, " \t\n ", None, "c"),
        (9, "one", "en", "a"),
        (10, "one two three", "en", "a"),
        (11, "One TWO three", "en", "a"),
        (None, words(rnd, 30), "en", "a"),
        (None, None, None, None),
        (12, "same row " * 30, "en", "a"),
        (12, "same row " * 30, "en", "a"),  # repeated row
        (12, "another text " + words(rnd, 25), "en", "a"),  # same key, another text
        (13, " ".join(words(rnd, 100) for _ in range(60)), "en", "c"),  # long
        (14, "x" * 5000 + " é日本 😀 " + "-" * 300, "xx", "c"),  # long words
        (15, "mail jo.hn@mail.example.com or +1 (212) 555-0199, 10.0.0.1, card 4111 1111 1111 1111.", "en", "d"),
        (16, "A line.\nA line.\nAnother line of a few words.\nA line.", "en", "d"),
        (17, words(rnd, 15) + " " + words(rnd, 15), "en", "d"),
        (-5, base + " tail", "en", "e"),
    ]
    rows += [(100 + i, words(rnd, rnd.randrange(21, 90)), rnd.choice(["en", "de"]), rnd.choice("abc")) for i in range(60)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    extra = ("k", "t", "key", 1, "l", "h", 2, 3, 4, "b", "s", "x", "r")
    full = [(i, t, g, s, None if t is None else len(t), *extra) for i, t, g, s in rows]
    return spark.createDataFrame(full, COLUMNS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(docs):
    return docs.limit(0)
