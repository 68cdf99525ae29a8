import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, id string, key string, seq string, label string"


@pytest.fixture(scope="session")
def words():
    r = random.Random(5)
    syllables = "the an on er re in st ou ti ha ed nd or at es th ing ble ion wh".split()
    return ["".join(r.choices(syllables, k=r.randint(1, 3))) for _ in range(3000)]


@pytest.fixture
def make_docs(spark):
    """Documents from (doc_id, text[, lang]), with extra columns whose names clash with those used inside."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", None, None if r[1] is None else len(r[1]), "x", None, "y", "z") for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make
