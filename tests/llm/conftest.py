import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int, size int"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    r = random.Random(3)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "épsilon"]) + str(r.randrange(99)) for _ in range(30000))
    texts = [None, "", "...", "one two", long, long + " more", "a b c d e f g h i j k l m n", "a b c d e f g h i j k l m n", "x" * 200000]
    rows = [(i, t, "en", None if i % 3 == 0 else f"s{i % 2}", len(t or ""), 1, 2) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[6], (None, "a b c d e f g h i j k l m n", None, None, None, None, None)], DOCS)
