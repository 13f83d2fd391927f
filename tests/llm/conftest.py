import random

import pytest

WORDS = "the of and river stone light under over quiet morning between paper walks slowly green house seven letters autumn window garden music silver bread north".split()


@pytest.fixture(scope="session")
def docs(spark):
    """Documents with nulls in any column, empty and long texts, repeated rows, near copies and shared passages."""
    rng = random.Random(7)
    say = lambda n: " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ly"]) for _ in range(n))
    base, passage = say(120), say(60)
    near = base.split()
    near[50] = "changed"
    rows = [
        (1, base, "en", "a"), (2, base, "fr", "b"), (3, " ".join(near), "en", "a"), (4, say(80) + " " + passage + " " + say(90), "en", None), (5, say(70) + " " + passage + " " + say(40), None, "a"),
        (6, None, "en", "a"), (7, "", "en", "a"), (8, "  \n\t ", "en", "a"), (9, "one two three", "en", "a"), (10, "ONE two\nthree", "en", "b"), (11, say(6000), "en", "a"),
        (None, say(90), "en", "a"), (12, base, "en", "a"), (12, base, "en", "a"), (13, "é" * 150 + base[:260], "de", "a"), (14, "ab" * 400, "en", "c"), (15, base.upper(), "en", "a"),
    ] + [(20 + i, say(rng.randint(1, 90)), "en", "s") for i in range(25)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # columns with the names of outputs
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in ("kept", "n_words", "severity", "ids", "bin", "shard", "removed", "c", "key", "label", "component_id")}).cache()


@pytest.fixture(scope="session")
def rows(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]
