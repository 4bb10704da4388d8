import random

import pytest

# small texts that every operator must survive
ODD = [
    (1, None),
    (2, ""),
    (3, " \n\t\n "),
    (None, "a row without an id"),
    (4, "same words again and again"),
    (4, "same words again and again"),
    (5, "Ünïcödé ☃ 𝔘𝔫𝔦 \u0000 end"),
    (6, "x" * 3000),
    (7, " " * 3000 + "tail"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty texts, repeated rows and extra columns with clashing names."""
    rows = [(i, t, "en", None, None, "clash", 7, "x") for i, t in ODD]
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, source string, n_chars long, key string, part int, label string"
    )


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


def prose(seed, n, vocabulary=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))
