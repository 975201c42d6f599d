import random

import pytest
from pyspark.sql import types as T

LONG = " ".join(f"w{i % 977}" for i in range(60_000))
SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("size", T.StringType()), ("kept", T.StringType()), ("bin", T.IntegerType()), ("n_words", T.StringType()), ("component_id", T.StringType()))])


def rows(pairs):
    return [(i, t, None, s, len(t or ""), "x", None, 1, "y", "z") for i, t, s in pairs]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    same = "The first of the lines is here.\nAnd the second of the lines is there, as long as it is.\nOnly this one is of its own."
    pairs = [
        (None, None, None), (None, "a text without an id and with a line of its own", "s1"), (1, None, "s1"), (2, "", "s2"), (3, LONG, "s1"), (4, same, "s1"), (4, same, "s1"), (5, same, None), (6, same.upper(), "s2"),
        (7, "  \t\n\n\x0b \x0c", "s1"), (8, "\x1c\u00a0\u2003é \u0130 \U0001f600", "s2"), (9, "one", "s3"), (10, "one", "s3"), (11, "a\x00b\r\nc", "s3"), (4, "another text under an id that is taken already", "s1"),
    ]
    return spark.createDataFrame(rows(pairs), SCHEMA)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def some(spark):
    """Two hundred short texts over few words and lines, with copies and near copies."""
    rng = random.Random(11)
    words = [f"word{i}" for i in range(60)]
    lines = [" ".join(rng.choices(words, k=rng.randrange(1, 9))) for _ in range(80)]
    texts = ["\n".join(rng.choices(lines, k=rng.randrange(0, 7))) for _ in range(150)]
    texts += rng.choices(texts, k=30) + [t.replace("word1", "Word2", 1) for t in rng.choices(texts, k=20)]
    return spark.createDataFrame(rows([(i, t, rng.choice(["a", "b", "b", "b", "c", None])) for i, t in enumerate(texts)]), SCHEMA)


def table(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)
