"""Model tasks with templates of one's own, and answers that are refused."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sievelight.operators import tasks


@pytest.fixture
def queries(spark):
    return spark.createDataFrame([("k1", "bolest", "cs"), ("k2", "lék {x}", None)], "query_key string, query_text string, lang string")


def test_a_template_of_two_parts(queries):
    """The model gets both parts, each filled, and what it gets decides whether it is asked again."""
    template = "[SYSTEM]\nYou grade in {lang}.\n[USER]\nGrade: {query} ({lang})"

    def answer(prompt, system):
        return json.dumps({"mu": len(prompt) % 3, "pu": len(system) % 3, "et": 0}), len(prompt), len(system)

    rows = tasks.triage(queries, answer, "m", template=template, more={"lang": F.col("lang")}).collect()
    want = {"k1": ("Grade: bolest (cs)", "You grade in cs."), "k2": ("Grade: lék {x} ()", "You grade in .")}
    assert {r.query_key: (r.mu, r.pu, r.et) for r in rows} == {k: (len(p) % 3, len(s) % 3, 0) for k, (p, s) in want.items()}


def test_a_template_of_one_part(queries):
    answer = lambda prompt: (json.dumps({"mu": 1 if prompt == "Only bolest" else 2}), 1, 1)
    rows = tasks.triage(queries, answer, "m", template="Only {query}").collect()
    assert {r.query_key: r.mu for r in rows} == {"k1": 1, "k2": 2}


@pytest.mark.parametrize("value", [
    {"grade": 3}, {"grade": "1"}, {"grade": True}, {"confidence": 0}, {"mu_grade": "PU1"}, {"clinical_relevance": "some"}, {"urgency_potential": "LOW"},
    {"label": "x" * 201}, {"picks": [{"query": "a", "et_grade": "ET3"}]}, {"variants": [{"text": 5}]},
])
def test_what_fields_may_not_hold(value):
    with pytest.raises(ValueError):
        tasks.check(value)


def test_what_fields_may_hold():
    tasks.check({"grade": 2, "confidence": None, "picks": [{"query": "a", "et_grade": "ET2"}], "other": {"grade": 0}, "mu_grade": "MU0", "label": ""})


def test_refused_answers_are_asked_for_again(spark, queries, tmp_path):
    """The first answer to each prompt is out of range, no JSON or no object; the next one is taken."""
    folder = str(tmp_path)

    def answer(prompt):
        import hashlib
        import os

        path = f"{folder}/{hashlib.sha1(prompt.encode()).hexdigest()}"
        if not os.path.exists(path):
            open(path, "w").close()
            return ('{"mu": 7}' if "bolest" in prompt else "sorry"), 1, 1
        return '{"mu": 1, "pu": 0, "et": 2}', 1, 1

    rows = tasks.triage(queries, answer, "m").collect()
    assert [(r.mu, r.pu, r.et) for r in rows] == [(1, 0, 2)] * 2
    never = lambda prompt: ("[1]", 1, 1)
    rows = tasks.triage(queries, never, "m", attempts=1).collect()
    assert [(r.mu, r.pu, r.et) for r in rows] == [(None, None, None)] * 2
