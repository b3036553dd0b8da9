import random

import pytest

CLASHING = "id bigint, row bigint, n bigint, path string, size string, copies int, key string, word string, src int"
DOCUMENTS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {CLASHING}"
_REST = (1, 2, 3, "p", "s", 4, "k", "w", 5)


def sentence(rng: random.Random, n: int, words: int = 400) -> str:
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """Make a documents table with clashing extra columns from ``(id, text[, lang, source])``."""

    def make(rows):
        full = []
        for row in rows:
            number, text, lang, source = (*row, None, None)[:4]
            full.append((number, text, lang, source, None, *_REST))
        return spark.createDataFrame(full, DOCUMENTS)

    return make


@pytest.fixture(scope="session")
def awkward():
    """Nulls, empty, blank and very long texts, ties, repeated rows and ids."""
    rng = random.Random(5)
    long = sentence(rng, 120_000, 5000)
    return [
        (1, None), (2, ""), (3, "   \n"), (4, "one"), (5, "one two three"), (6, long), (7, long + " tail"),
        (8, "!!! ???"), (9, "é ü ß 漢字"), (10, sentence(rng, 40)), (10, sentence(rng, 41)), (11, "same same same"),
        (11, "same same same"), (None, "no id at all"), (12, None), (13, ""), (14, "a" * 300_000),
    ]


@pytest.fixture(scope="session")
def empty(documents):
    return documents([])
