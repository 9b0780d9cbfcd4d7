"""Layouts by neighbours: weights, curve, neighbours kept and repeatability."""

from __future__ import annotations

import numpy as np
import pytest

from sievelight.operators import clusters, layout


def frame(spark, x, parts=3):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "id long, embedding array<double>").repartition(parts)


def coordinates(df):
    return np.array([r.reduced for r in df.orderBy("id").collect()])


def near(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, axis=1, kind="stable")[:, :k]


def kept(x, y, k=10):
    """The share of each point's nearest that are among them still."""
    return np.mean([len(set(a) & set(b)) / k for a, b in zip(near(x, k), near(y, k), strict=True)])


@pytest.fixture(scope="module")
def rolled():
    """A rolled sheet and some groups, in ten dimensions, where straight axes mix what is far apart."""
    rng = np.random.default_rng(1)
    t, h = rng.uniform(3, 14, 350), rng.uniform(0, 8, 350)
    sheet = np.stack([t * np.cos(t), h, t * np.sin(t)], axis=1) @ rng.normal(size=(3, 10))
    groups = np.concatenate([rng.normal(rng.normal(0, 12, 10), 0.5, (25, 10)) for _ in range(6)])
    return np.concatenate([sheet, groups])


def test_weights_sum_to_what_they_should():
    rng = np.random.default_rng(2)
    d = np.sort(rng.uniform(0.1, 3, (20, 15)), axis=1)
    w = layout.smoothed(d)
    assert w[:, 0] == pytest.approx(1) and (np.diff(w, axis=1) <= 1e-12).all()
    assert w.sum(axis=1) == pytest.approx(np.log2(15), abs=1e-4)
    assert layout.smoothed(np.array([[0.0, 0.0, 1.0, np.inf]]))[0].tolist()[:3] == [1.0, 1.0, 1.0]
    assert layout.smoothed(np.full((1, 3), np.inf)).tolist() == [[0, 0, 0]]


def test_curve_is_near_what_is_wanted():
    for least in (0.0, 0.1, 0.5):
        a, b = layout.curve(least)
        x = np.linspace(0.01, 3, 200)
        want = np.where(x < least, 1, np.exp(-(x - least)))
        assert np.abs(1 / (1 + a * x ** (2 * b)) - want).mean() < 0.05
    assert layout.curve(0.1) == pytest.approx((1.577, 0.895), abs=0.01)


def test_pairs_unite_both_ends(spark):
    x = np.random.default_rng(3).normal(size=(60, 4))
    points = frame(spark, x).selectExpr("id", "embedding as v").cache()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    at = near(x, 5)
    w = layout.smoothed(np.take_along_axis(d, at, axis=1))
    one = np.zeros((60, 60))
    np.put_along_axis(one, at, w, axis=1)
    want = one + one.T - one * one.T
    got = layout.neighbour_pairs(points, 5, "euclidean").collect()
    assert len(got) == (np.triu(want) > 0).sum()
    assert all(r.weight == pytest.approx(want[r.u, r.v]) and r.u < r.v for r in got)


def test_neighbours_are_kept_better_than_by_components(spark, rolled):
    df = frame(spark, rolled)
    y = coordinates(layout.neighbour_layout(df, "id", 2, metric="euclidean", block=200))
    straight = coordinates(clusters.reduce_dimensions(df, "id", 2))
    assert kept(rolled, y) > kept(rolled, straight) + 0.1
    # Groups stay apart from all others.
    for g in range(6):
        own = np.arange(350 + 25 * g, 375 + 25 * g)
        assert np.isin(near(y, 10)[own], own).mean() > 0.9


def test_same_seed_same_places_and_a_cascade(spark, rolled):
    one = layout.neighbour_layout(frame(spark, rolled[200:], 2), "id", 5, rounds=3, block=100)
    two = layout.neighbour_layout(frame(spark, rolled[200:], 7), "id", 5, rounds=3, block=100)
    a, b = coordinates(one), coordinates(two)
    assert a.shape == (300, 5) and (a == b).all()
    other = coordinates(layout.neighbour_layout(frame(spark, rolled[200:]), "id", 5, rounds=3, block=100, seed=1))
    assert not (a == other).all()
    plane = layout.neighbour_layout(one, "id", 2, "reduced", min_dist=0.1, metric="euclidean", rounds=3)
    assert coordinates(plane).shape == (300, 2)


def test_odd_points(spark):
    rows = [(1, [1.0, 2.0]), (2, None), (None, [1.0, 1.0])]
    got = layout.neighbour_layout(spark.createDataFrame(rows, "id long, embedding array<double>"), "id", 2).collect()
    assert sorted((r.id or 0, r.reduced) for r in got if r.reduced is not None) == [(1, [0.0, 0.0])] and len(got) == 3
    same = frame(spark, np.ones((40, 3)))
    found = coordinates(layout.neighbour_layout(same, "id", 2, rounds=1))
    assert found.shape == (40, 2) and np.isfinite(found).all()
    assert layout.neighbour_layout(same.limit(0), "id", 2).count() == 0
