from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside, as columns of the input.
CLASHING = ("node", "root", "id", "group_id", "keep", "h", "i", "line", "lines", "b", "score", "toxic", "band", "part", "pi", "p", "o", "chunk", "s", "t", "__id", "__y", "__spans", "__removed", "__gone", "__row", "__hits", "row", "file", "n_tokens", "selected")


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("bcdfglmnprstv") + rng.choice("aeiou") for _ in range(rng.randint(2, 4))) for _ in range(n))


@pytest.fixture(scope="session")
def documents(spark):
    """A DataFrame of documents from texts, or from (doc_id, text) pairs."""

    def make(texts, **columns):
        rows = [(k, t) if t is None or isinstance(t, str) else t for k, t in enumerate(texts)]
        return spark.createDataFrame([(d, t, columns.get("lang", "en"), f"src{(d or 0) % 3}", len(t or "")) for d, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def messy(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows, rows that share an id, and extra columns with clashing names."""
    rng = random.Random(3)
    long = prose(rng, 150_000)
    rows = [
        (None, None, None, None, None), (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, "a", 4), (4, long, "en", "a", len(long)), (5, long, "en", "b", len(long)),
        (6, "one two three four five six seven", "en", "b", 33), (6, "one two three four five six seven", "en", "b", 33), (7, "another text altogether, of no length", "de", None, 37), (7, "an id that comes twice", "de", "c", 22),
        (None, "a text without an id", "en", "c", 20), (None, "a text without an id", "en", "c", 20), (8, "x" * 300_000, "en", "c", 300_000), (9, "?!... --- ***", "en", "c", 13), (10, "\U0001f600 ünï İ cödé \x00 end", None, None, None),
    ]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, SCHEMA)
    return df.select("*", *(F.lit(f"own {c}").alias(c) for c in CLASHING))


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
