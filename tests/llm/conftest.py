import random

import pytest

#: Columns that no operator reads, with names that operators use inside.
CLASHING = "size long, key string, label int, score double, n long, part int, a long, y int, line long"
DOCUMENTS = f"doc_id long, text string, lang string, source string, n_chars long, {CLASHING}"


def make(spark, rows, schema=DOCUMENTS):
    """Documents from (doc_id, text) or (doc_id, text, lang), and the clashing columns filled or null."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "SRC1", len(r[1]) if r[1] is not None else None, 1, "k", None, 0.5, 2, 3, None, 0, 9) for r in rows]
    return spark.createDataFrame(full, schema)


def prose(seed, n, vocabulary=900):
    """n made-up words."""
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocabulary)}" for _ in range(n))


@pytest.fixture(scope="session")
def edge(spark):
    """Null and empty texts, null ids, spaces only, a very long text, ties and repeated rows, and odd characters."""
    rows = [(1, None), (2, ""), (None, "no id here"), (3, "  \n\t "), (4, prose(4, 60_000)), (5, "one two three"), (5, "one two three"), (6, "one two three"), (7, "…!?"), (8, "ünïcödé 日本語 text\x00 end"), (None, None), (9, "x" * 5000)]
    return make(spark, rows)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, [])
