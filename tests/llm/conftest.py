"""Small tables with every odd case: nulls, empty and very long texts, repeated rows, columns with clashing names."""

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, id long, shard int, slot long, fp long, score double"


@pytest.fixture(scope="session")
def docs(spark):
    """Documents from (doc_id, text[, source]) with columns whose names the operators use themselves."""

    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", 1, "row", "key", 7, 3, 4, 5, 0.5) for r in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


ODD = [
    (1, None, None), (2, "", "a"), (None, "lost and found words of a text", None), (3, " \t\n ", "a"), (4, "one", "b"), (4, "one", "b"), (5, "One", "b"),
    (6, "the quick brown fox jumps over the lazy dog " * 3000, "a"), (7, "ein Satz über Käse", "b"), (None, None, None), (8, "x" * 50_000, "c"),
]
