"""Registered queries without SQL against brute-force versions over the smallest tables."""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import test_density
import test_layout
from sievelight import registry
from sievelight.plans import cluster_queries, views

SF = "/root/testdata/sf0.001"


def rows_of(spark, name):
    return registry.queries()[name](spark, SF).collect()


@pytest.fixture(scope="module")
def kinds(spark):
    """The clusters of each category and their centroids."""
    found = defaultdict(list)
    for r in cluster_queries._categories(spark, SF).orderBy("cluster_id").collect():
        found[r.category].append((r.cluster_id, np.array(r.centroid)))
    return found


def average_linkage(centres):
    """Merges (height, members) by the mean of all pairs' distances, looked at anew at every step."""
    u = [v / np.linalg.norm(v) for _, v in centres]
    groups, merges = [frozenset([k]) for k in range(len(u))], []
    while len(groups) > 1:
        mean = lambda a, b: np.mean([1 - u[i] @ u[j] for i in a for j in b])
        a, b = min(itertools.combinations(groups, 2), key=lambda p: mean(*p))
        merges.append((mean(a, b), a | b))
        groups = [g for g in groups if g not in (a, b)] + [a | b]
    return merges


def groups_at(centres, height):
    groups = {frozenset([k]) for k in range(len(centres))}
    for h, members in average_linkage(centres):
        if h <= height:
            groups = {g for g in groups if not g <= members} | {members}
    return groups


def cut_of(centres):
    heights = [h for h, _ in average_linkage(centres)]
    return min(heights) + 0.25 * (max(heights) - min(heights))


def test_merged_clusters(spark, kinds):
    got = defaultdict(lambda: defaultdict(set))
    for r in rows_of(spark, "upgma_merge"):
        got[r.category][r.merged].add(r.cluster_id)
        assert r.cut == pytest.approx(cut_of(kinds[r.category]), abs=1e-6)
    for kind, centres in kinds.items():
        want = {frozenset(centres[k][0] for k in g) for g in groups_at(centres, cut_of(centres))}
        assert {frozenset(g) for g in got[kind].values()} == want


def test_merges_of_each_category(spark, kinds):
    for r in rows_of(spark, "merge_breakdown"):
        groups = groups_at(kinds[r.category], cut_of(kinds[r.category]))
        n = len(kinds[r.category])
        single = sum(len(g) == 1 for g in groups)
        assert (r.n_clusters, r.n_groups, r.n_single) == (n, len(groups), single)
        assert r.reduction == pytest.approx(100 * (n - len(groups)) / n, abs=1e-5)


def test_merges_at_two_levels(spark, kinds):
    for r in rows_of(spark, "merge_levels"):
        groups = [g for centres in kinds.values() for g in groups_at(centres, {1: 0.2, 2: 0.6}[r.level])]
        sizes = Counter(len(g) > 1 for g in groups)
        assert (r.n_groups, r.n_single, r.n_after) == (sizes[True], sizes[False], len(groups))
        assert r.n_absorbed == sum(len(g) for g in groups if len(g) > 1)


def test_knee_of_merges(spark, kinds):
    heights = [h for centres in kinds.values() for h, _ in average_linkage(centres)]
    n = sum(map(len, kinds.values()))
    got = rows_of(spark, "knee_of_merges")
    assert len(got) == len(cluster_queries.THRESHOLDS)
    for r in got:
        merged = sum(h <= r.threshold for h in heights)
        assert (r.n_merges, r.n_clusters) == (merged, n - merged)


def test_density_clusters(spark):
    points = sorted((r.vec_id, r.embedding) for r in views.clusters(spark, SF).collect())
    u = np.array([np.array(v) / np.linalg.norm(v) for _, v in points])
    want = {frozenset(points[k][0] for k in leaf) for leaf in test_density.brute(u, 5, 10)}
    got = defaultdict(set)
    for r in rows_of(spark, "density_cluster"):
        got[r.cluster_id].add(r.vec_id)
    noise = got.pop(-1, set())
    assert {frozenset(v) for v in got.values()} == want and len(noise) + sum(map(len, want)) == len(points)


def test_layouts_keep_neighbours(spark):
    points = sorted((r.vec_id, r.embedding) for r in views.clusters(spark, SF).collect())
    u = np.array([np.array(v) / np.linalg.norm(v) for _, v in points])
    found = {}
    for name, dims in (("reduced_vectors", 5), ("plane_vectors", 2), ("component_vectors", 5)):
        rows = sorted((r.vec_id, r.reduced) for r in rows_of(spark, name))
        assert [k for k, _ in rows] == [k for k, _ in points] and {len(y) for _, y in rows} == {dims}
        found[name] = test_layout.kept(u, np.array([y for _, y in rows]))
    assert found["reduced_vectors"] > found["component_vectors"] > 10 / len(points) and found["plane_vectors"] > 20 / len(points)


def test_layout_clusters(spark):
    """The leaves of the layout's points, whatever the layout is."""
    rows = sorted((r.vec_id, r.reduced) for r in rows_of(spark, "reduced_vectors"))
    leaves = test_density.brute(np.array([y for _, y in rows]), 5, 10)
    got = defaultdict(set)
    for r in rows_of(spark, "layout_clusters"):
        got[r.cluster_id].add(r.vec_id)
    got.pop(-1, None)
    assert {frozenset(v) for v in got.values()} == {frozenset(rows[k][0] for k in leaf) for leaf in leaves} and leaves


def test_bootstrap_by_counts_is_near_that_by_rows(spark):
    got = {r.part: r for r in rows_of(spark, "bootstrap_qwk_counts")}
    rated = views.raters(spark, SF).collect()
    rng = np.random.default_rng(3)
    for part, odd in (("even", 0), ("odd", 1)):
        pairs = np.array([(r.rater_a, r.rater_b) for r in rated if r.doc_id % 2 == odd])
        values = []
        for _ in range(1500):
            a, b = pairs[rng.integers(0, len(pairs), len(pairs))].T
            if len(set(a)) > 1:
                m = np.zeros((3, 3))
                np.add.at(m, (a, b), 1)
                weight = np.subtract.outer(np.arange(3), np.arange(3)) ** 2
                values.append(1 - len(a) * (weight * m).sum() / (weight * np.outer(m.sum(1), m.sum(0))).sum())
        want = np.quantile(values, [0.025, 0.5, 0.975])
        assert (got[part].low, got[part].median, got[part].high) == pytest.approx(tuple(want), abs=0.05)


def test_fuzzy_names(spark):
    """Every name asked for against every known one, by the ratio of an edit script without replacements."""

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            last = row
            row = [0]
            for k, y in enumerate(b):
                row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
        return 100 * 2 * row[-1] / (len(a) + len(b))

    clean = lambda t: re.sub(r"\s+", " ", t.lower()).strip()
    known = {clean(r.s_name) for r in spark.read.parquet(f"{SF}/supplier.parquet").collect()}
    asked = {clean(r.c_name.replace("Customer", "Suppliers")) for r in spark.read.parquet(f"{SF}/customer.parquet").collect()}
    got = {r.key: r.match for r in rows_of(spark, "fuzzy_filter")}
    from sievelight.operators import filters

    cutoff = next(
        v.default for k, v in __import__("inspect").signature(filters.person_flags).parameters.items() if k == "cutoff"
    )
    want = {a for a in asked if any(ratio(a, b) >= cutoff for b in known)}
    assert set(got) == want
