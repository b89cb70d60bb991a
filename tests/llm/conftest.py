import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
EXTRA = ", ids string, score string, fingerprint string, part string, rank string, i string, h string, t string, a string"


def sentence(rng, n, words=400):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows."""
    rng = random.Random(3)
    long = sentence(rng, 60_000)
    base = sentence(rng, 120)
    texts = [None, "", " \n\t ", "one", "two words", base, base, base + " tail", long, "mail a.b@c.org or +44 (20) 7946 0958 now",
             "x" * 50_000, sentence(rng, 200), "A" * 10 + " éß漢字 \U0001f600"]
    rows = [(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[5], rows[5], (None, base, None, None, None), (None, None, None, None, None), (7, "other text here", "fr", None, 1)]
    return rows


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame([r + ("x",) * 9 for r in odd_rows], COLUMNS + EXTRA).repartition(3)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
