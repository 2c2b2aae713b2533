import random

import pytest

from rollcall.llm.shipping import ship

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, key string, rep int, whole int, removed_words int"


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    ship(spark)


@pytest.fixture(scope="session")
def prose():
    """Invented prose: ``prose(words, seed)``."""
    syllables = "ta re mo li ka su ne vo di pra sto len".split()

    def make(words, seed):
        draw = random.Random(seed)
        return " ".join("".join(draw.choices(syllables, k=draw.randint(1, 4))) for _ in range(words))

    return make


@pytest.fixture(scope="session")
def odd_docs(spark, prose):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, other
    scripts, and columns with names that operators use themselves."""
    extra = (1, "k", 2, 3, 4)
    long = prose(30_000, 1)
    rows = [
        (1, prose(120, 2), "en", "a", 1, *extra),
        (1, prose(120, 2), "en", "a", 1, *extra),
        (2, prose(120, 2), "en", "b", 1, *extra),
        (3, None, "en", "a", None, *extra),
        (4, "", None, None, 0, *extra),
        (5, " \t\n ", "de", "a", 3, *extra),
        (6, long, "de", "b", len(long), *extra),
        (7, "日本語 の テキスト\u0000 <|endoftext|> 😀", "ja", "c", 9, *extra),
        (8, "one", None, "c", 3, *extra),
        (8, "two words", "en", "c", 9, *extra),
        (None, prose(60, 3), "en", "a", 1, *extra),
        (10, prose(80, 4), "en", None, 1, None, None, None, None, None),
    ]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
