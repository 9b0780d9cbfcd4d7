"""Average linkage by rounds against the chain of nearest neighbours."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from sievelight.operators import linkage


def frame(spark, x, kinds):
    return spark.createDataFrame([(k, c, v.tolist()) for k, (v, c) in enumerate(zip(x, kinds, strict=True))], "cluster_id int, kind string, centroid array<double>")


def members(n, merges):
    """height and members of each merge, by the least clusters of both sides."""
    group, out = {k: frozenset([k]) for k in n}, []
    for a, b, h in sorted(merges, key=lambda m: m[2]):
        new = group.pop(b) | group[a]
        group[min(new)] = new
        out.append((h, new))
    return out


def test_two_thousand_points(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(1400, 8)) + rng.normal(size=8) * 2, rng.normal(size=(600, 8))])
    want = defaultdict(list)
    group = [frozenset([k]) for k in range(2000)]
    for a, b, h, _ in linkage.upgma(x):
        group.append(group[a] | group[b])
        want[group[-1]] = h
    found = linkage.linkage(frame(spark, x, ["all"] * 2000), "kind", block=300).collect()
    assert len(found) == 1999
    got = members(range(2000), [(r.a, r.b, r.height) for r in found])
    assert {g for _, g in got} == set(want) and all(h == pytest.approx(want[g], abs=1e-9) for h, g in got)
    sizes = sorted(r.size for r in found)
    assert sizes == sorted(map(len, want))


@pytest.mark.parametrize("block", [2048, 20])
def test_categories_stay_apart(spark, block):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(160, 5))
    kinds = ["a"] * 90 + ["b"] * 40 + [None] * 29 + ["one"]
    df = frame(spark, x, kinds)
    merges = linkage.linkage(df, "kind", block=block).cache()
    assert merges.count() == 89 + 39 + 28
    rows = {r.cluster_id: r for r in linkage.merge_within(df, "kind", merges=merges).collect()}
    heights = defaultdict(list)
    for r in linkage.merge_heights(df, "kind", merges=merges).collect():
        heights[r.kind].append(r.height)
    assert len(rows) == 160
    for kind in ("a", "b", None, "one"):
        own = [k for k in range(160) if kinds[k] == kind]
        chain = linkage.upgma(x[own])
        want = [h for *_, h, _ in chain]
        assert sorted(heights[kind]) == pytest.approx(want)
        cut = min(want) + 0.25 * (max(want) - min(want)) if want else 0.0
        assert [rows[k].merged for k in own] == linkage.cut_tree(len(own), chain, cut + 1e-12)
        assert all(rows[k].cut == pytest.approx(cut) for k in own)
    at = {r.cluster_id: r.merged for r in linkage.merge_at(df, "kind", 0.5, merges=merges).collect()}
    own = list(range(90))
    assert [at[k] for k in own] == linkage.cut_tree(90, linkage.upgma(x[own]), 0.5)


def test_equal_points_and_none(spark):
    x = np.concatenate([np.ones((30, 3)), np.eye(3), np.zeros((1, 3))])
    df = frame(spark, x, ["k"] * 34)
    found = members(range(34), [(r.a, r.b, r.height) for r in linkage.linkage(df, "kind", block=8).collect()])
    assert len(found) == 33 and frozenset(range(30)) in {g for _, g in found} and sum(abs(h) < 1e-9 for h, _ in found) == 29
    assert linkage.linkage(df.limit(0), "kind").count() == 0 and linkage.merge_within(df.limit(0), "kind").count() == 0
