import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside, as further columns of the input.
CLASHING = "t digest salt h n k1 k2 runs marks key uid part ids fp code run rank leaf size copies rate target s shift row all drops rest line pos at c a b events logs empty gram v score".split()


def words(rng, n):
    return [rng.choice("the and of to a in vi mo la den die êt über naïve x1 東京 😀 foo bar baz qux".split()) + rng.choice(["", "", ".", ",", "s"]) for _ in range(n)]


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and tied documents."""
    rng = random.Random(5)
    long_text = " ".join(words(rng, 12_000))
    rows = [
        (1, None, "en", "a", None),
        (2, "", "en", "a", 0),
        (3, " \t\n\r\n ", None, "b", 5),
        (4, long_text, "en", None, None),
        (5, long_text.upper(), None, None, None),
        (6, "one", "de", "b", 3),
        (6, "one", "de", "b", 3),
        (6, "another text under the same id", "de", "b", 3),
        (None, "a text without an id", "fr", "c", 3),
        (None, "a text without an id", "fr", "c", 3),
        (None, None, None, None, None),
        (7, "12345 !!! ...", "fr", "c", 3),
        (8, "x" * 70_000, "es", "c", 3),
        (9, "a b c\x1cd\x85e 'S don't\n\n\nend  ", "es", "c", 3),
    ]
    body = words(rng, 120)
    for i in range(12):  # near copies with a common passage
        changed = list(body)
        changed[rng.randrange(120)] = f"w{i}"
        rows.append((20 + i, " ".join(words(rng, 10)) + "\n" + " ".join(changed), "en", "d", None))
    return rows


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(rows):
        from pyspark.sql import functions as F

        df = spark.createDataFrame(rows, SCHEMA)
        return df.select("*", *[F.lit(f"extra {c}").alias(c) for c in CLASHING])

    return make
