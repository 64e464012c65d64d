import random

import pytest
from pyspark.sql import types as T

#: Columns that clash with names the operators use, one of them by case only.
CLASHING = ["name", "size", "kept", "digest", "part", "rep", "TEXT"]


def frame(spark, rows):
    """documents rows (doc_id, text[, source]) with clashing extra columns."""
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in CLASHING]
    )
    full = [(r[0], r[1], None, r[2] if len(r) > 2 else "s", 0, *["x"] * len(CLASHING)) for r in rows]
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture
def docs(spark):
    return lambda rows: frame(spark, rows)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Texts with exact and near copies, chains of edits, blanks, nulls and a very long text."""
    rng = random.Random(7)
    rows, texts = [], []
    for _ in range(12):
        base = sentence(rng, rng.randint(30, 120)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 5)):
            words = list(base)
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = sentence(rng, 1)
            texts.append((" " if rng.random() < 0.5 else " \n\t").join(words))
            if rng.random() < 0.3:
                base = words  # a chain
    texts += ["", "", None, " \n", "one two", "One  two", "a b c d", "x" * 300_000, "x" * 299_999 + "y", "x" * 300_000]
    texts += [sentence(random.Random(1), 9000)] * 2
    texts += ["é漢😀 I'll  go\r\n now.  ", "mail a.b@c.de or +1 (555) 010-9999 and 4111 1111 1111 1111, 10.0.0.1 " * 3]
    rng.shuffle(texts)
    return [(i * 3, t, rng.choice(["s", "s", "t", None])) for i, t in enumerate(texts)]
