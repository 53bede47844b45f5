import random

import pytest

WORDS = "amber birch cedar delta ember fjord grove harbor inlet juniper kelp lagoon meadow nectar orchard prairie".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with columns whose names clash with those the operators add."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, n_words long, score double, copy long, ids string, key long, node long"

    def make(rows):
        return spark.createDataFrame(
            [(i, t, "en", s, len(t or ""), 1, 0.5, 9, "x", 2, 3) for i, t, s in rows], schema).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null id, null and empty texts, a text of one very long word, a very long text, repeated rows."""
    long_text = prose(1, 60_000)
    return [
        (1, None, "a"), (2, "", "a"), (3, "x" * 200_000, None), (4, long_text, "a"), (5, prose(2, 80), "b"),
        (5, prose(2, 80), "b"), (None, prose(3, 80), "b"), (6, " \t\n", "b"), (7, "é ü 漢字 🙂", "a"),
    ]
