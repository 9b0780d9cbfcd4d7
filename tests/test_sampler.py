"""The greedy sampler's heap against scoring every row at every step."""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
import pytest

from sievelight.operators import golden


def made(n, seed):
    rng = np.random.default_rng(seed)
    rows = pd.DataFrame({
        "query_key": [f"q{k:07d}" for k in range(n)],
        "mu_grade": [f"MU{g}" for g in rng.choice(3, n, p=[0.7, 0.2, 0.1])],
        "pu_grade": [f"PU{g}" for g in rng.choice(3, n)],
        "et_grade": [f"ET{g}" if g < 3 else None for g in rng.choice(4, n)],
        "supercluster_id": [f"s{g}" for g in rng.integers(0, max(3, min(n // 20, 300)), n)],
        "category_weight": rng.choice([1.0, 0.7, 0.3, 0.0], n),
        "min_conf": rng.integers(1, 6, n),
    })
    rows["conf_factor"] = np.where(rows["min_conf"] >= 3, 1.0, 0.6)
    return rows.sort_values(["category_weight", "min_conf", "query_key"], ascending=[False, False, True]).reset_index(drop=True)


def every_row(rows, total, buffer, targets, cap):
    cells = [[c for c in r if c in targets] for r in rows[["mu_grade", "pu_grade", "et_grade"]].values.tolist()]
    weight, factor, cluster = (rows[c].tolist() for c in ("category_weight", "conf_factor", "supercluster_id"))
    have = {c: sum(c in own for own in cells) for c in targets}
    left, used, free, chosen = dict(targets), {}, set(range(len(rows))), []

    def take(k, phase):
        chosen.append((rows["query_key"][k], phase))
        free.remove(k)
        used[cluster[k]] = used.get(cluster[k], 0) + 1
        for c in cells[k]:
            left[c] -= 1

    for k in range(len(rows)):
        if len(chosen) < total and any(have[c] < targets[c] and left[c] > 0 for c in cells[k]):
            take(k, "scarce")
    for phase, n in (("greedy", total - len(chosen)), ("buffer", buffer)):
        for _ in range(n):
            best = None
            for k in sorted(free):
                if used.get(cluster[k], 0) < cap:
                    need = 0.0
                    for c in cells[k]:
                        need += left[c] / targets[c] if left[c] > 0 else -golden.OVERFILL / targets[c]
                    score = need * (weight[k] * factor[k]) + 0.01 * (weight[k] * factor[k])
                    if best is None or score > best[0]:
                        best = score, k
            if best is None:
                break
            take(best[1], phase)
    return chosen


@pytest.mark.parametrize("seed,total,buffer,cap", [(1, 60, 20, 4), (2, 150, 30, 100), (3, 400, 300, 2), (4, 0, 10, 5)])
def test_same_choices(seed, total, buffer, cap):
    rows = made(400, seed)
    targets = {"MU0": 40, "MU1": 50, "MU2": 60, "PU0": 20, "PU1": 35, "PU2": 30, "ET0": 29, "ET1": 200, "ET2": 14}
    got = golden._greedy(rows, total, buffer, targets, cap)
    assert list(zip(got["query_key"], got["phase"])) == every_row(rows, total, buffer, targets, cap)


def test_a_million_rows():
    rows = made(1_000_000, 5)
    began = time.monotonic()
    got = golden._greedy(rows, 100_000, 20_000, {k: 250 * v for k, v in golden.TARGETS.items()}, 1000)
    assert len(got) == 120_000 == got["query_key"].nunique() and time.monotonic() - began < 60
    assert got[got["phase"] != "scarce"]["supercluster_id"].value_counts().max() <= 1000


def test_no_rows():
    assert len(golden._greedy(made(0, 1), 5, 5, golden.TARGETS, 5)) == 0
