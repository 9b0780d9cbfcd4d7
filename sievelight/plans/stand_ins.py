"""Stand-ins for models, whose answers SQL can repeat; for the queries and where no model can be reached."""

from __future__ import annotations

import hashlib
import json

from sievelight.operators.tasks import AXES, KINDS, LEVELS
from sievelight.sources.providers import Answer


def grade_by_words(prompt: str) -> tuple[str, int, int]:
    """An axis judge: a grade and a confidence that the prompt's hash gives."""
    h = int(hashlib.sha256(prompt.encode()).hexdigest(), 16)
    answer = {"grade": h % 3, "confidence": 1 + h // 3 % 5}
    return json.dumps(answer, sort_keys=True), len(prompt.split()), 8


def prompt_number(prompt: str, salt: str = "") -> int:
    """From 0 to 14: the sum of the digits of the prompt's hash, so SQL can repeat it."""
    return sum(int(c, 16) for c in hashlib.sha256((salt + prompt).encode()).hexdigest()) % 15


def _graded(d: int) -> dict:
    return {"mu_grade": f"MU{d % 3}", "pu_grade": f"PU{(d + 1) % 3}", "et_grade": f"ET{(d + 2) % 3}"}


def _judged(d: int) -> dict:
    return {**_graded(d), **{f"{a.lower()}_applicable": d % (k + 2) > 0 for k, a in enumerate(AXES)}, "confidence": 1 + d % 5}


_MADE = {
    "cluster_card": lambda d: {
        "label": f"topic {d}", "clinical_relevance": KINDS[d % 4], "urgency_potential": LEVELS[d % 3], "emotional_potential": LEVELS[(d + 1) % 3]
    },
    "cluster_picker": lambda d: {
        "picks": [{"query": f"pick {d} {k}", **_graded(d + k)} for k in range(d % 4)], "skip_reason": None if d % 4 else "nothing fits"
    },
    "blind_verifier": _judged,
    "reference": _judged,
    "backfill": lambda d: {"generated": [{"query": f"made {d} {k}"} for k in range(5)]},
    "variants": lambda d: {"variants": [{"text": f"variant {d} {g}", "target_grade": g} for g in range(1 + d % 4)]},
    "axis_judge": lambda d: {"grade": d % 3, "confidence": 1 + d // 3},
    "triage": lambda d: {"mu": d % 3, "pu": (d + 1) % 3, "et": (d + 2) % 3},
    "counterfactual": lambda d: {"paraphrase": f"like {d}", "up": "" if d % 5 == 0 else f"up {d}", "down": " " if d % 3 == 0 else f"down {d}"},
}


def stand_in(task: str, salt: str = "") -> Answer:
    """A deterministic answer to every prompt of a task, for tests and where no model can be reached."""

    def answer(prompt: str) -> tuple[str, int, int]:
        return json.dumps(_MADE[task](prompt_number(prompt, salt)), sort_keys=True), len(prompt.split()), 8

    return answer


def judged_backfill(prompt: str) -> tuple[str, int, int]:
    """Stand-in judge of generated queries, whose grade is the one that their number gives."""
    d = prompt_number(prompt)
    said = {"mu_grade": f"MU{2 if d % 2 else 0}", "pu_grade": f"PU{2 if d % 3 else 0}", "et_grade": "ET1", "confidence": 1 + d % 5}
    return json.dumps(said, sort_keys=True), len(prompt.split()), 8
