import random

import pytest

WORDS = "the of and river stone quiet paper window garden bridge morning letter music harbour silver forest table road winter field".split()


@pytest.fixture
def prose():
    """A maker of texts from a fixed list of words, different for each seed."""

    def make(seed, count=80, line=12):
        rnd = random.Random(seed)
        words = [rnd.choice(WORDS) + rnd.choice(["", "", "s", "ed", "er"]) for _ in range(count)]
        lines = [" ".join(words[i : i + line]).capitalize() + "." for i in range(0, count, line)]
        return "\n".join(lines)

    return make


@pytest.fixture
def documents(spark, prose):
    """Documents with nulls, empty and very long texts, repeated rows, and columns with awkward names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, ids string, fp string, size string, hash string, __copies string"
    rest = ("x",) * 6

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), *rest) for i, t, s in rows], schema)

    return make


@pytest.fixture
def hard_rows(prose):
    long = prose(5, 12_000) + "z" * 40_000
    return [
        (1, prose(1), "a"), (2, prose(1), "a"), (2, prose(1), "a"), (3, None, "b"), (4, "", None), (5, " \n\t ", "b"), (6, "one two", "c"),
        (7, long, "a"), (None, prose(2), None), (None, None, None), (8, prose(3) + " ünïcödé 🙂 ▁ \x00", "b"),
    ]
