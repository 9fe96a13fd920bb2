import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n_words long, mark long, host string, row long, ids string, band long, unit string, kept boolean, document string, gone string, x string, words string"
WORDS = [a + b for a in "kar ble dot umi sen tor".split() for b in "an el is oth ur em ga".split()]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + r.choice(WORDS) for _ in range(n))


def row(doc_id, text, source="a"):
    """A document with columns whose names the operators use themselves."""
    return (doc_id, text, "en", source, None if text is None else len(text), -1, -1, "h", -1, "i", -1, "u", None, "d", "g", "x", "w")


@pytest.fixture(scope="session")
def odd_rows():
    base = prose(1, 400)
    edited = base.split()
    edited[200] = "changed"
    return [
        row(None, "one two three " * 30),
        row(1, None),
        row(2, ""),
        row(3, " \t\n \r\n"),
        row(4, base, None),
        row(5, base),
        row(5, base),
        row(6, " ".join(edited)),
        row(6, prose(9, 70)),
        row(7, prose(2, 40_000)),
        row(8, prose(3, 60) + "\n" + prose(1, 120)),
        row(9, "mail bob@example.com, 10.0.0.1 or +1 (017) 555-7713; é漢😀 ▁ <|endoftext|>"),
        row(10, "x"),
        row(11, "one two three four"),
        row(12, "one two three four"),
        *[row(100 + k, f"Shared  LINE \n{prose(50 + k, 60)}\n\tshared  line") for k in range(12)],
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
