from __future__ import annotations

import pytest

EXTRA = {"piece": 9, "simhash": 8, "words": 7, "key": 6, "range": 5, "label": 4, "value": 3, "component_id": 2, "rank": 1, "slot": 0}
LONG = "alpha beta gamma delta " * 20_000
HOT = "The same text again and again, with 1234 numbers and password=a8f3e1b99c0d4e21 in it."


@pytest.fixture(scope="session")
def documents(spark):
    """Nulls, empty and long texts, repeated rows, and columns named like the operators' own."""

    def make(rows):
        kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{k} int" for k in EXTRA)
        full = [(i, t, lang, "src", None if t is None else len(t), *EXTRA.values()) for i, t, lang in rows]
        return spark.createDataFrame(full, kinds)

    return make


@pytest.fixture(scope="session")
def odd(documents):
    rows = [(1, HOT, "en"), (2, None, "en"), (3, "", None), (4, LONG, "en"), (5, HOT, "en"), (5, HOT, "en"), (6, "1 2 3 ...", "en")]
    rows += [(None, "Der schnelle braune Fuchs springt über den Hund.", None), (8, "el perro y la casa", "es"), (9, "...　\x1c", None)]
    rows += [(k, HOT, None) for k in range(100, 130)]
    return documents(rows).repartition(5)


@pytest.fixture(scope="session")
def none(documents):
    return documents([])
