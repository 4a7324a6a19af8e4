import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string, bucket int, block int, count int, digest string, label int"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice(["ba", "ke", "lo", "mi", "nu", "ré", "st"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus() -> list[tuple]:
    """(doc_id, text, source): copies, near copies, nulls, empty and long texts, repeated rows, personal data."""
    rng = random.Random(4)
    rows = [(k, words(rng, rng.randint(1, 90)), f"s{k % 4}") for k in range(1, 60)]
    base = words(rng, 120)
    rows += [(100 + k, base, "s1") for k in range(5)]
    rows += [(110 + k, base.replace(base.split()[7 * k], "Changed", 1), "s2") for k in range(4)]
    rows += [(120, None, "s0"), (121, "", None), (122, " \n\t ", "s0"), (None, "an id that is null", "s3"), (None, None, None)]
    rows += [(130, "twice the same row here", "s3"), (130, "twice the same row here", "s3")]
    rows += [(140, words(rng, 6000), "s0"), (141, "x" * 5000, "s0"), (142, "ab" * 700, "s2")]
    rows += [(150, "Mail joe.b+x@mail.example.com or 10.1.2.3, card 4111 1111 1111 1111, +1 (654) 555-7485.", "s1"), (151, "@ 1.2.3 999.1.1.1 +12 a@b a@b.c.", "s1")]
    return rows


@pytest.fixture(scope="session")
def rows() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    full = [(i, t, "en", s, len(t or ""), "f", "i", 1, 2, 3, "d", 1) for i, t, s in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
