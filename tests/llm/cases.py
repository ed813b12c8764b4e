"""Inputs that the tests of the training-data operators share."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tokens string, domain int, component string"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_documents() -> list[tuple]:
    """Nulls, empty, blank and long texts, ties, repeated rows, a null id, names that clash."""
    rng = random.Random(4)
    long_text = words(rng, 9000)
    base = words(rng, 60)
    near = base.split()
    near[7] = "changed"
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, base, "de", None), (5, base.upper(), "en", "a"), (6, " ".join(near), "fr", "b"),
        (7, long_text, "en", "b"), (7, long_text, "en", "b"), (8, "one two three", "es", "a"), (9, "One  two\nthree", "es", "a"), (None, words(rng, 12), "en", "a"), (10, "é" * 50, "fr", "c"),
    ]
    return [(*r, len(r[1]) if r[1] else 0, "x", 3, "y") for r in rows]


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)
