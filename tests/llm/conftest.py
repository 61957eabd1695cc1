from __future__ import annotations

import random

import pytest

WORDS = "ab alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega".split()


@pytest.fixture
def rng():
    """One seed for each test: a case doesn't depend on the tests before it."""
    return random.Random(5)


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(30)) for _ in range(n))


def documents(spark, rows):
    """(doc_id, text) or (doc_id, text, lang, source) rows, with columns whose names clash with inner ones."""
    full = [(r[0], r[1], *(r[2:] or ("en", "s1")), len(r[1] or ""), "x") for r in rows]
    return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long, cid string").withColumnRenamed("cid", "rid")
