import random

import pytest

SCHEMA = "doc_id long, text string, lang string, _id string, spans string, bands long, rid long, key string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, ties, repeated rows, and columns whose names clash with the operators' own."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9)))
    long = " ".join(word() for _ in range(20_000))
    plain = [" ".join(word() for _ in range(rng.randint(1, 120))) for _ in range(40)]
    rows = [(i, t) for i, t in enumerate(plain)]
    rows += [(40, None), (41, ""), (None, "no id here at all"), (None, None), (42, long), (43, plain[0]), (44, plain[0]), (5, plain[5]), (5, plain[5]), (6, "another text, the same id"), (45, "   \n\t "), (46, "x" * 50_000), (47, "á é ß 漢字 🙂 end")]
    return spark.createDataFrame([(i, t, "en", "a", "b", 1, 2, "k") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
