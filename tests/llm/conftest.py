from __future__ import annotations

import pytest

from made_up import words

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, hash string, maybe string, sha string, blob string, findings string, node string, ids string, score string, kept_id string"


@pytest.fixture(scope="session")
def odd_texts() -> list[tuple]:
    """Ids and texts: null, empty and blank ones, a very long one, an unsplit one, copies, near copies, repeated rows and a null id."""
    base = words(1, 120).split()
    near = [*base[:60], "changed", *base[61:]]
    return [
        (1, None), (2, ""), (3, " \n\t "), (4, words(4, 60_000)), (
            5, "same text here today"
        ), (5, "same text here today"), (
            6, "Same  text\nhere today"
        ), (7, "same text here today "),
        (8, "123 !!! ..."), (
            None, "a text without an id"
        ), (9, " ".join(base)), (10, " ".join(near)), (
            11, " ".join(base).upper()
        ), (12, "x" * 5000), (13, "two words"), (14, "TWO words"),
        (15, "naïve café — “quoted” 東京 \U0001f600 <|endoftext|> end's"),
    ]


@pytest.fixture(scope="session")
def odd(spark, odd_texts):
    rows = [
        (d, t, "en" if (d or 0) % 2 else None, None if d == 2 else "s", len(t or ""), *["clash"] * 9)
        for d, t in odd_texts
    ]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCUMENTS)
