from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, uid long, fp string, size string, label string, found string, pid int, start int, h1 int, score int, kept int, media int"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghij", k=r.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, repeated rows, ties, control characters."""
    long = words(30_000, 1)
    texts = [
        (1, "a b c d e f g h"), (1, "a b c d e f g h"), (2, "A B C D E F G H"), (None, "a b c d e f g h"), (3, None), (4, ""), (5, " \n\t "),
        (6, long), (7, long + " tail"), (8, "one"), (9, "Ünï 日本 🙂  x"), (None, None), (10, "x\n" * 200), (11, "the same line\n" * 80), (-4, "a b"),
    ]
    extra = (None,) * 11
    return [(i, t, "en" if i else None, f"s{(i or 0) % 3}" if i != 8 else None, len(t or ""), *extra) for i, t in texts]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The odd rows with further columns whose names operators use themselves."""
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
