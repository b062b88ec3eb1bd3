import random

import pytest


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns that clash with inner names."""
    rng = random.Random(7)
    vocabulary = ["alpha", "beta", "gamma", "delta", "the", "of", "é", "ßu", "漢字", "x1", "**", "A", "B!", "và"]
    make = lambda n: " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) for _ in range(n))
    base, long = make(120), make(9000)
    rows = [
        (0, base, "en"), (1, base, "fr"), (2, base + " tail", None), (3, None, "en"), (4, "", None), (5, " \n\t ", "en"), (6, "one two", "en"), (6, "one two", "en"),
        (7, "ONE two", "de"), (8, long, "en"), (9, long[:200] + " inserted words here " + long[200:], "en"), (None, base, "en"), (None, None, None), (10, "x" * 50_000, "en"), (11, "\n".join(["same line here"] * 9), "de"),
        (12, make(60) + " " + base, "fr"), (13, "a\x0bb\x0cc\rd e", "en"), (14, make(300), None),
    ]
    frame = [(i, t, g, None, 1, "d", "t", 0) for i, t, g in rows]
    return spark.createDataFrame(frame, "doc_id long, text string, lang string, source string, n_chars int, digest string, token string, node int")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
