"""Operators on small hand-written frames."""

from __future__ import annotations

import hashlib
import json
import random
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.functions import hashing as hx
from sievelight.functions import text as tx
from sievelight.functions import vectors as vx
from sievelight.operators import clusters, density, filters, golden, graph, heads, linkage, logs, pairs, probes, ranking, reports, sets
from sievelight.operators import metrics as mx
from sievelight.plans import stand_ins
from sievelight.sources import providers, readers, storage, writers


def column(spark, values, kind="string"):
    return spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, x {kind}")


def values(df, expr):
    return [r[0] for r in df.orderBy("k").select(expr).collect()]


def test_folding_keeps_what_it_should(spark):
    texts = ["  Zdravý   DEN ", "Straße", "ŁÓDŹ", None, "İstanbul", "MUDr. Novák", "é́"]
    df = column(spark, texts)
    exact = values(df, tx.normalize_key("x"))
    want = [
        None
        if t is None
        else " ".join(
            "".join(c for c in unicodedata.normalize("NFD", t.casefold()) if unicodedata.category(c) != "Mn").split()
        )
        for t in texts
    ]
    assert exact == want and exact[1] == "strasse" and exact[2] == "łodz"
    fast = values(df, tx.fold(F.col("x")))
    assert fast[0] == "zdravy den" and fast[1] == "straße" and fast[2] == "łodz"
    assert values(df, tx.normalize_name(F.col("x")))[5] == "novak" == values(
        df, tx.normalize_name(F.col("x"), exact=True)
    )[5]


def test_predicates(spark):
    df = column(
        spark,
        [
            "123",
            "12",
            "١٢٣",
            " 4567 ",
            "1 2 3",
            "' or 5*5=25 --",
            "select (1)",
            "buy my pills online",
            "MUDr Novák",
            "magnet",
            "{x}",
            "ab",
            "--!",
            "jak dlouho trvá léčba",
            None,
        ],
    )
    assert values(df, tx.is_digits(F.col("x"))) == [True, False, True, True] + [False] * 11
    assert [k for k, v in enumerate(values(df, tx.is_spam(F.col("x")))) if v] == [5, 6, 7]
    assert [k for k, v in enumerate(values(df, tx.has_title(F.col("x")))) if v] == [8]
    assert [k for k, v in enumerate(values(df, tx.clean_query(F.col("x")))) if v is None] == [1, 10, 11, 12, 14]
    assert [k for k, v in enumerate(values(df, tx.is_natural(F.col("x")))) if v] == [7, 13]


def test_dates_and_numbers(spark):
    df = column(spark, ["1. 2. 2024 10:30", "31.12.2023", "30. 2. 2024", "x", None])
    assert [
        str(v) if v else None for v in values(df, tx.day_month_year(F.col("x")))
    ] == ["2024-02-01", "2023-12-31", None, None, None]
    assert values(column(spark, ["5", "5,3 %", "1e3", ""]), tx.number(F.col("x"))) == [5.0, None, 1000.0, None]
    heads_ = column(spark, ["# 20240101-20240131", "# 20240101", "# none"])
    assert [tuple(v) for v in values(heads_, tx.header_dates(F.col("x")))] == [
        ("2024-01-01", "2024-01-31"), ("2024-01-01", "2024-01-01"), (None, None)
    ]


@pytest.mark.parametrize("k", [5, 7, 1000])
def test_modulo_of_the_whole_hash(spark, k):
    texts = [f"cluster_{n}" for n in range(200)]
    want = [int(hashlib.sha256(t.encode()).hexdigest(), 16) % k for t in texts]
    assert values(column(spark, texts), hx.modulo(F.col("x"), k)) == want


def test_keys(spark):
    df = column(spark, ["a" * 300, "short", "MU2", "bad"])
    keys = values(df, hx.source_key("golden-v1:", F.col("x")))
    assert keys[0] == "golden-v1:" + hashlib.sha256(b"a" * 300).hexdigest() and keys[1] == "golden-v1:short"
    assert values(df, hx.text_id(F.col("x")))[1] == hashlib.sha1(b"short").hexdigest()[:16]
    assert values(df, hx.grade_of(F.col("x")))[2:] == [2, None]


def test_weighted_mean_dilutes_and_falls_back(spark):
    rows = [("a", 10, 0.5), ("a", 30, None), ("b", 0, 0.2), ("b", 0, 0.4), ("c", 5, None), ("d", 0, None)]
    df = spark.createDataFrame(rows, "k string, clicks long, ctr double")
    got = {r.k: r.m for r in df.groupBy("k").agg(logs.weighted_mean("ctr", "clicks").alias("m")).collect()}
    assert got["a"] == pytest.approx(0.125) and got["b"] == pytest.approx(0.3) and got["c"] == 0.0 and got["d"] is None


def test_dedup_ties_and_null_sums(spark):
    rows = [("k", "b", 5, None, None), ("k", "a", 5, None, None), ("k", "z", 1, None, 0.1)]
    r = logs.dedup(
        spark.createDataFrame(rows, "query_key string, query string, clicks long, impressions long, ctr double"),
        ["query_key"],
    ).first()
    assert (r["query"], r.clicks, r.impressions, r.n_rows) == ("a", 11, 0, 3)


def test_canonical_file(spark):
    rows = [
        ("s", "f1", "2024-01-01", "2024-01-10", 5),
        ("s", "f2", "2024-01-01", "2024-02-10", 1),
        ("s", "f3", "2024-01-05", "2024-02-14", 9),
        ("t", "g", None, None, 1),
    ]
    got = {
        r.source: r.source_file for r in logs.canonical_files(
            spark.createDataFrame(rows, "source string, source_file string, a string, b string, clicks long"),
            ["source"],
            "source_file",
            "a",
            "b",
            "clicks",
        ).collect()
    }
    assert got == {"s": "f3", "t": "g"}


def lcs_ratio(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
    return 200.0 * table[-1][-1] / (len(a) + len(b))


def test_fuzzy_join_misses_nothing(spark):
    rng = random.Random(1)
    names = ["".join(rng.choice("abcde ") for _ in range(rng.randint(3, 22))).strip() or "x" for _ in range(60)]
    keys = []
    for n in names:
        edited = list(n)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(edited) + 1)
            edited[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "q"])
        keys.append("".join(edited) or "y")
    left, right = spark.createDataFrame([(k,) for k in keys], "key string"), spark.createDataFrame(
        [(n,) for n in names], "name string"
    )
    want = {}
    for key in set(keys):
        best = min((-lcs_ratio(key, n), n) for n in set(names))
        if -best[0] >= 88:
            want[key] = (best[1], -best[0])
    got = {r.key: (r.name, r.ratio) for r in filters.fuzzy_matches(left, right, "key", "name").collect()}
    assert got.keys() == want.keys() and all(
        got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 1e-9 for k in want
    )


def test_person_flags(spark):
    people = spark.createDataFrame(
        [("Jan", "Novák"), (None, "Dvořáková"), ("Eva", "Ox")], "firstname string, lastname string"
    )
    log = spark.createDataFrame(
        [
            ("novak jan",),
            ("MUDr. Novák ordinace dnes ráno",),
            ("dvorakov",),
            ("ox kart",),
            ("zcela jiny dotaz",),
            (None,),
        ],
        "query string",
    )
    got = {r.key: r.match for r in filters.person_flags(log, people).collect()}
    assert got == {"novak jan": "full", "novak ordinace dnes rano": "token", "dvorakov": "fuzzy"}


def test_flags_and_funnel(spark):
    rows = [
        ("abc", "abc", 3, 0, 3),
        ("123", "123", 9, 9, 0),
        ("long enough", "long enough", 0, 0, 0),
        ("fine query", "fine query", 8, 8, 0),
        (None, None, None, None, None),
    ]
    df = filters.log_flags(
        spark.createDataFrame(
            rows, "query_key string, query string, clicks long, clicks_site1_ga4 long, clicks_site1_internal long"
        )
    )
    kept, dropped = filters.split_by(df)
    assert [r["query"] for r in kept.collect()] == ["fine query"] and dropped.count() == 4
    assert {
        r.rule: r.n_rows for r in filters.funnel(df, ["drop_shorthand", "drop_digits"]).collect()
    } == {"drop_shorthand": 1, "drop_digits": 1, "kept": 3}


def test_exclusion_and_patches(spark):
    df = spark.createDataFrame(
        [("a", "c1", 1), ("b", "c1", 2), ("c", "c2", 3), ("d", None, 4)],
        "query_key string, supercluster_id string, v int",
    )
    golden_ = spark.createDataFrame([("a", None), (None, "c2")], "query_key string, supercluster_id string")
    assert {r.query_key for r in sets.excluding(df, golden_, ["query_key", "supercluster_id"]).collect()} == {"b", "d"}
    patches = spark.createDataFrame([("b", 9, "why"), ("c", 3, "same")], "query_key string, v int, reason string")
    once = sets.patched(df, patches, "query_key", "v")
    assert {r.query_key: (r.v, r.patch_reason) for r in once.collect()} == {
        "a": (1, None), "b": (9, "[manual] why"), "c": (3, None), "d": (4, None)
    }
    twice = sets.patched(once.drop("patch_reason"), patches, "query_key", "v")
    assert {r.query_key: r.v for r in twice.collect()} == {"a": 1, "b": 9, "c": 3, "d": 4}
    with pytest.raises(sets.BrokenInvariant):
        sets.expect_disjoint(df, golden_, "query_key")
    with pytest.raises(sets.BrokenInvariant):
        sets.expect_one_value(df, "supercluster_id", "query_key")
    sets.expect_matched(df, df, "v")
    with pytest.raises(ValueError, match="missing"):
        sets.require_columns(df, ["nope"])


def test_samples(spark):
    df = spark.range(100).selectExpr("id", "id % 3 as g", "id % 25 = 0 as rare")
    assert ranking.stratified_sample(df, ["g"], 4, 1, "id").groupBy("g").count().filter("count = 4").count() == 3
    picked = ranking.top_up(df, ["g"], 5, 30, 1, "id")
    assert picked.count() == 30 == picked.distinct().count()
    core = ranking.mandatory_then_random(df, F.col("rare"), 10, 3, "id").filter("in_core")
    assert core.count() == 10 and core.filter("rare").count() == 4
    assert ranking.mandatory_then_random(df, F.col("rare"), 2, 3, "id").filter("in_core").count() == 4
    spread = ranking.diversity_first(df, "g", 4, "id", F.asc("id"))
    assert {r.g for r in spread.filter("cluster_rank = 1").collect()} == {0, 1, 2}


RATERS = [[89, 7, 2], [12, 9, 2], [5, 23, 51]]


@pytest.fixture(scope="module")
def rated(spark):
    rows = [(i, j) for i in range(3) for j in range(3) for _ in range(RATERS[i][j])]
    return spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "id long, a int, b int")


def test_published_rater_matrix(rated):
    r = mx.confusion(rated, "a", "b").select(mx.qwk_of().alias("qwk"), mx.agreement_of().alias("raw")).first()
    assert r.qwk == pytest.approx(0.780695, abs=1e-6) and r.raw == pytest.approx(0.745)


def test_metrics_at_their_edges(spark):
    one = mx.confusion(spark.createDataFrame([(1, 1), (1, 1), (None, 1)], "a int, b int"), "a", "b")
    r = one.select(mx.qwk_of().alias("q"), mx.kappa_of().alias("k"), mx.macro_f1_of().alias("f")).first()
    assert r.q is None and r.k is None and r.f == pytest.approx(1 / 3)
    scores = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.4, 1)], "s double, y int")
    assert mx.auroc(scores, "s", F.col("y") == 1).first().auroc == pytest.approx(0.625)
    assert mx.auroc(scores, "s", F.col("y") >= 0).first().auroc is None
    assert mx.spearman(
        spark.createDataFrame([(1, 10), (2, 20), (2, 15), (3, 40)], "x int, y int"), "x", "y"
    ).first().spearman == pytest.approx(0.9486833)
    assert mx.krippendorff_alpha(
        spark.createDataFrame([(1, 1), (1, 1), (2, 2), (2, 2), (3, 0)], "u int, v int"), "u", "v"
    ).first().alpha == pytest.approx(1.0)
    assert mx.eta_squared(
        spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 3.0), ("b", 3.0)], "g string, x double"), "x", "g"
    ).first().eta_squared == pytest.approx(1.0)


def test_bootstrap_interval_holds_the_value(rated):
    r = mx.bootstrap_qwk(rated, "a", "b", "id", 100).first()
    assert r.low < 0.780695 < r.high and r.n_used == 100


def test_bootstrap_of_counts(spark, rated):
    exact, fast = mx.bootstrap_qwk(
        rated, "a", "b", "id", 300
    ).first(), mx.bootstrap_qwk_counts(rated, "a", "b", 2000).first()
    assert fast.n_used == 2000
    assert all(abs(exact[c] - fast[c]) < 0.03 for c in ("low", "median", "high"))
    by = mx.bootstrap_qwk_counts(rated.withColumn("g", F.col("id") % 2), "a", "b", 50, ["g"])
    assert {r.g for r in by.collect()} == {0, 1}
    assert mx.bootstrap_qwk_counts(rated.filter("a = 0"), "a", "b", 50).first().n_used == 0


def test_ranks_over_ranges(spark):
    rng = random.Random(7)
    rows = [(g, rng.randint(0, 40)) for g in "ab" for _ in range(150)]
    got = mx.midranks(spark.createDataFrame(rows, "g string, x int"), "x", ["g"]).collect()
    for g in "ab":
        own = sorted(x for h, x in rows if h == g)
        for r in (r for r in got if r.g == g):
            assert r.r == own.index(r.x) + (own.count(r.x) + 1) / 2


def planted(spark, n=240, dim=8, noise=0.3):
    rng = np.random.default_rng(0)
    w = rng.normal(size=dim)
    w /= np.linalg.norm(w)
    rows = []
    for k in range(n):
        g = k % 3
        v = (g - 1) * 2.0 * w + noise * rng.normal(size=dim)
        rows.append(
            (
                "MU",
                k,
                v.tolist(),
                g,
                f"c{k % 17}",
                k,
                k - 2 if g == 2 and k % 2 else k,
                ("train", "train", "dev", "test")[k // 3 % 4],
            )
        )
    return spark.createDataFrame(
        rows,
        "axis string, text_id long, v array<double>, grade int, cluster string, query_key long, pair_key long, split string",
    ), w


def test_planted_direction_is_found(spark):
    rows, w = planted(spark)
    out = probes.evaluate(rows).first()
    assert out.macro_f1 > 0.8 and out.qwk > 0.8 and out.n_train == 120
    for fit in (probes.paired_direction, probes.extreme_direction):
        assert abs(np.dot(fit(rows.filter("split = 'train'")).first().w, w)) > 0.95
    assert {r.path for r in probes.paired_matches(rows.filter("split = 'train'")).collect()} >= {"anchor", "cluster"}


def test_thresholds_against_all_pairs(spark):
    rng = np.random.default_rng(4)
    grades = rng.integers(0, 3, 90)
    scores = np.round(grades + rng.normal(0, 0.8, 90), 3)
    df = spark.createDataFrame(
        [("MU", float(s), int(g)) for s, g in zip(scores, grades, strict=True)], "axis string, score double, grade int"
    )
    got = probes.tune_thresholds(df).first()
    ts = np.unique(np.round(np.quantile(scores, np.linspace(0.02, 0.98, 60)), 12))
    best = (-1, 0, 0)
    for i, a in enumerate(ts):
        for b in ts[i + 1 :]:
            p = np.where(scores >= b, 2, np.where(scores >= a, 1, 0))
            f = np.mean(
                [2 * ((p == g) & (grades == g)).sum() / max(1, (p == g).sum() + (grades == g).sum()) for g in range(3)]
            )
            if round(f, 9) > best[0]:
                best = (round(f, 9), a, b)
    assert (got.f1, got.t1, got.t2) == pytest.approx(best)
    flat = probes.tune_thresholds(
        spark.createDataFrame([("MU", 1.0, 0), ("MU", 1.0, 2)], "axis string, score double, grade int")
    ).first()
    assert (flat.t1, flat.t2) == (1.0, 1.0)


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    rows = df.select(
        vx.unit(F.col("a")).alias("u"),
        vx.cosine(F.col("a"), F.col("b")).alias("c"),
        vx.residual(F.col("a"), F.col("b")).alias("r"),
        vx.argmax(F.col("b")).alias("m"),
    ).collect()
    assert rows[0].u == pytest.approx(
        [0.6, 0.8]
    ) and rows[0].c == pytest.approx(0.96) and rows[1].c is None and rows[0].m == 0
    assert np.dot(rows[0].r, [4, 3]) == pytest.approx(0)
    assert vx.mean_vector(
        spark.createDataFrame([("k", [1.0, 3.0]), ("k", [3.0, 5.0])], "k string, v array<double>"), ["k"], "v"
    ).first().centroid == [2.0, 4.0]


def test_heads_learn(spark):
    rows, _ = planted(spark, noise=0.2)
    train, test = rows.filter("split <> 'test'"), rows.filter("split = 'test'")
    right = lambda found: found.select(F.avg((F.col("pred") == F.col("grade")).cast("double"))).first()[0]
    for fit in (heads.linear_head, heads.ordinal_head, heads.whitened_head, heads.mlp_head):
        assert right(fit(train, test)) > 0.8
    scored = rows.withColumn("score", F.col("grade") + 0.1 * F.rand(4))
    assert right(heads.score_head(scored.filter("split <> 'test'"), scored.filter("split = 'test'"))) > 0.8


def test_concatenated_head_uses_every_embedder(spark):
    """The grade lies in the second embedder's vectors alone, and texts that one of them lacks take no part."""
    rng = np.random.default_rng(12)
    rows = [(k, k % 3, "test" if k % 4 == 0 else "train", rng.normal(size=4).tolist()) for k in range(240)]
    labels = spark.createDataFrame(rows, "text_id long, grade int, split string, v array<double>")
    second = labels.filter("text_id < 200").select(
        "text_id", F.array(*((F.col("grade") == g).cast("double") + 0.1 * F.rand(g) for g in range(3))).alias("v")
    )
    found = heads.concat_head([labels.select("text_id", "v"), second], labels).collect()
    assert {r.text_id for r in found} == set(range(0, 200, 4))
    assert sum(r.pred == r.grade for r in found) > 0.9 * len(found)
    alone = heads.linear_head(labels.filter("split <> 'test'"), labels.filter("split = 'test'")).collect()
    assert sum(r.pred == r.grade for r in alone) < 0.7 * len(alone)


def test_heads_beside_each_other(spark):
    rows, _ = planted(spark, noise=0.2)
    axes = tuple(r.axis for r in rows.select("axis").distinct().collect())
    got = heads.compared(rows, axes, hidden=16, iterations=60).collect()
    dom = {r.axis: r.macro_f1 for r in probes.evaluate(rows).collect()}
    assert {r.axis for r in got} == set(axes)
    for r in got:
        assert r.f1_dom == pytest.approx(dom[r.axis]) and min(r.f1_linear, r.f1_mlp) > 0.7
        own = rows.filter(F.col("axis") == r.axis)
        linear = heads.linear_head(own.filter("split = 'train'"), own.filter("split = 'test'"), balanced=False)
        want = mx.confusion(linear, "grade", "pred").select(mx.macro_f1_of()).first()[0]
        assert r.f1_linear == pytest.approx(want)
        assert (r.mlp_minus_dom, r.mlp_minus_linear, r.linear_minus_dom) == pytest.approx(
            (r.f1_mlp - r.f1_dom, r.f1_mlp - r.f1_linear, r.f1_linear - r.f1_dom)
        )


def test_quantiles_over_ranges(spark):
    rng = random.Random(9)
    at = [0.02 + 0.96 * k / 59 for k in range(60)] + [0.0, 0.5, 1.0]
    values = {c: [rng.choice([rng.random(), rng.randint(0, 3)]) for _ in range(n)] for c, n in (("a", 1), ("b", 2), ("c", 500))}
    values[None] = [3.0, 1.0]
    rows = [(c, float(x)) for c, xs in values.items() for x in xs] + [("c", None), ("d", None)]
    got = {r.c: r.q for r in mx.quantiles(spark.createDataFrame(rows, "c string, x double"), "x", at, ["c"]).collect()}
    assert set(got) == set(values)
    alone = mx.quantiles(spark.createDataFrame([(float(x),) for x in values["c"]], "x double"), "x", at).collect()
    assert len(alone) == 1 and alone[0].q == got["c"]
    for c, xs in values.items():
        assert got[c] == pytest.approx(np.quantile(xs, at).tolist(), abs=1e-12)


def test_points_on_the_front(spark):
    rng = random.Random(3)
    points = [(k, rng.randint(0, 9) / 2, rng.randint(0, 9)) for k in range(60)]
    got = {r.k: r.on_front for r in reports.pareto(spark.createDataFrame(points, "k int, cost double, score int"), "cost", "score").collect()}
    for k, c, s in points:
        beaten = any(c2 <= c and s2 >= s and (c2 < c or s2 > s) for _, c2, s2 in points)
        assert got[k] == (not beaten)


def test_two_levels_of_merges(spark):
    rng = np.random.default_rng(4)
    rows = [(k, "x" if k < 25 else "y", rng.normal(size=6).tolist()) for k in range(40)]
    centres = spark.createDataFrame(rows, "cluster_id int, category string, centroid array<double>")
    cut = {h: linkage.merge_at(centres, "category", h) for h in (0.6, 1.0)}
    got = {r.level: r for r in reports.two_levels(cut[0.6], cut[1.0]).collect()}
    for level, h in ((1, 0.6), (2, 1.0)):
        sizes = []
        for kind in ("x", "y"):
            own = np.array([v for _, c, v in rows if c == kind])
            labels = linkage.cut_tree(len(own), linkage.upgma(own), h)
            sizes += [labels.count(k) for k in set(labels)]
        several = [n for n in sizes if n > 1]
        r = got[level]
        assert (r.n_clusters, r.n_groups, r.n_absorbed, r.n_single, r.n_after) == (
            40, len(several), sum(several), len(sizes) - len(several), len(sizes)
        )
    assert got[1].n_after >= got[2].n_after


def test_greedy_sample_against_plain_loops(spark):
    """The same choices, made one after another with nothing but dictionaries."""
    rng = random.Random(7)
    kinds = list(golden.CATEGORY_WEIGHT)
    rows = [
        (f"q{k:03d}", f"t{k}", f"s{rng.randint(0, 12)}", rng.choice(kinds), f"MU{rng.choice([0, 0, 0, 1, 2])}", f"PU{rng.choice([0, 0, 1, 2])}",
         f"ET{rng.randint(0, 2)}", rng.randint(1, 5), rng.randint(1, 5), rng.randint(1, 5))
        for k in range(160)
    ]
    picks = spark.createDataFrame(
        rows,
        "query_key string, query_text string, supercluster_id string, clinical_relevance string, mu_grade string, pu_grade string, et_grade string, mu_confidence int, pu_confidence int, et_confidence int",
    )
    targets = {"MU0": 20, "MU1": 20, "MU2": 60, "PU0": 20, "PU1": 15, "PU2": 10, "ET0": 9, "ET1": 12, "ET2": 14}
    total, buffer, cap = 60, 12, 4
    items = []
    for key, _, cluster, kind, *cells, a, b, c in rows:
        weight, sure = golden.CATEGORY_WEIGHT[kind], min(a, b, c)
        quality = weight * (1.0 if sure >= 3 else golden.LOW_CONFIDENCE)
        items.append({"key": key, "cluster": cluster, "weight": weight, "sure": sure, "quality": quality, "cells": cells})
    items.sort(key=lambda i: (-i["weight"], -i["sure"], i["key"]))
    have = {c: sum(c in i["cells"] for i in items) for c in targets}
    left, used, chosen = dict(targets), {}, []

    def take(item, phase):
        chosen.append((item["key"], phase))
        used[item["cluster"]] = used.get(item["cluster"], 0) + 1
        for c in item["cells"]:
            left[c] -= 1
        items.remove(item)

    for item in list(items):
        if len(chosen) < total and any(have[c] < targets[c] and left[c] > 0 for c in item["cells"]):
            take(item, "scarce")
    for phase, n in (("greedy", total - len(chosen)), ("buffer", buffer)):
        for _ in range(n):
            free = [i for i in items if used.get(i["cluster"], 0) < cap]
            if not free:
                break

            def worth(i):
                need = sum(left[c] / targets[c] if left[c] > 0 else -golden.OVERFILL / targets[c] for c in i["cells"])
                return need * i["quality"] + 0.01 * i["quality"]

            take(max(free, key=worth), phase)
    got = sorted(golden.greedy_sample(picks, total, buffer, targets, cap).collect(), key=lambda r: r.order)
    assert [(r.query_key, r.phase) for r in got] == chosen and {p for _, p in chosen} >= {"scarce", "greedy"}


def test_reduced_vectors_are_principal_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(80, 3)) @ rng.normal(size=(3, 10)) + 0.01 * rng.normal(size=(80, 10))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    found = clusters.reduce_dimensions(df, "vec_id").orderBy("vec_id").collect()
    name = next(c for c in found[0].asDict() if c != "vec_id")
    y = np.array([r[name] for r in found])
    y = y[:, : min(3, y.shape[1])]
    # Distances survive, as three components hold nearly all of these vectors.
    own, kept = (np.linalg.norm(a[:, None] - a[None], axis=2) for a in (x, y))
    assert np.corrcoef(own.ravel(), kept.ravel())[0, 1] > 0.95


def test_calls_that_hang_give_null_rows(spark):
    prompts = spark.createDataFrame([(1, "fast"), (2, "slow"), (3, "fails")], "id int, prompt string")

    def answer(prompt):
        if prompt == "slow":
            time.sleep(20)
        if prompt == "fails":
            raise RuntimeError("refused")
        return '{"grade": 1, "confidence": 2}', 1, 1

    began = time.time()
    got = providers.call_model(prompts, answer, "m", "axis_judge", "id", attempts=1, seconds=0.5).collect()
    found = {r.id: (r.response is None, r.error) for r in got}
    assert found[1] == (False, None) and found[2] == (True, "no answer in 0.5 s") and found[3] == (True, "refused")
    assert time.time() - began < 15


def test_tasks_keep_to_their_rules(spark):
    from sievelight.operators import tasks

    said = lambda d: lambda prompt: (json.dumps(d), 1, 1)
    groups = spark.createDataFrame([("c1", 3, "w"), ("c2", 4, "x")], "cluster_id string, size int, words string")
    card = tasks.cluster_cards(groups, said({"label": "l", "size": 99, "cluster_id": "zz"}), "m").collect()
    assert {(r.cluster_id, r.size, r.label) for r in card} == {("c1", 3, "l"), ("c2", 4, "l")}
    many = said({"picks": [{"query": f"q{k}", "mu_grade": "MU1"} for k in range(30)]})
    picks, dead = tasks.cluster_picks(groups, many, "m")
    assert picks.count() == 2 * tasks.MOST_PICKS and dead.count() == 0
    picks, dead = tasks.cluster_picks(groups, said({"picks": [], "skip_reason": "dull"}), "m")
    assert picks.count() == 0 and {(r.cluster_id, r.skip_reason) for r in dead.collect()} == {("c1", "dull"), ("c2", "dull")}

    def refuses(prompt):
        raise RuntimeError("no")

    picks, dead = tasks.cluster_picks(groups, refuses, "m", attempts=1)
    assert picks.count() == 0 and dead.count() == 2
    anchors = spark.createDataFrame([("MU", "k", "text", 1), ("MU", "j", "text", 2)], "axis string, query_key string, query_text string, grade int")
    all_ = said({"variants": [{"text": f"v{g}", "target_grade": g} for g in range(5)]})
    made = tasks.variants(anchors, (0, 1, 2), all_, "m")
    assert sorted((r.query_key, r.anchor_grade, r.target_grade) for r in made.collect()) == [("j", 2, 0), ("j", 2, 1), ("k", 1, 0), ("k", 1, 2)]
    judged = tasks.confirmed(made, said({"grade": 0, "confidence": 4}), "m").collect()
    assert sorted((r.target_grade, r.confirmed) for r in judged) == [(0, True), (0, True), (1, False), (2, False)]
    assert all(r.confirmed is False for r in tasks.confirmed(made, refuses, "m", attempts=1).collect())
    flips = tasks.edits(anchors.limit(1), said({"paraphrase": "p", "up": " ", "down": "d"}), "m").first()
    assert (flips.paraphrase, flips.up, flips.down) == ("p", None, "d")
    two = tasks.compared_generators(anchors, (0, 1, 2), {"a": all_, "b": said({"variants": [{"text": "w", "target_grade": 0}]})}).collect()
    assert {(r.query_key, r.target_grade, r.a, r.b, r.n_models) for r in two} == {
        ("k", 0, "v0", "w", 2), ("k", 2, "v2", None, 1), ("j", 0, "v0", "w", 2), ("j", 1, "v1", None, 1)
    }
    grades = tasks.grades(anchors, said({"mu_grade": "MU2", "mu_applicable": True, "confidence": 3}), "m", "reference").first()
    assert (grades.mu_grade, grades.mu_applicable, grades.pu_grade, grades.confidence) == ("MU2", True, None, 3)


def test_spreadsheets(spark, tmp_path):
    import zipfile

    from sievelight.sources import readers

    shared = "<sst><si><t>Dotaz</t></si><si><r><t>boles</t></r><r><t>t hlavy</t></r></si></sst>"
    sheet = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
        <row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>Jazyk</t></is></c><c r="D1" t="inlineStr"><is><t>Kliky</t></is></c></row>
        <row r="2"><c r="A2" t="s"><v>1</v></c><c r="D2"><v>12</v></c></row>
        <row r="3"><c r="B3" t="inlineStr"><is><t>cs</t></is></c></row></sheetData></worksheet>"""
    path = tmp_path / "site_search_log.xlsx"
    with zipfile.ZipFile(path, "w") as out:
        out.writestr("xl/sharedStrings.xml", shared)
        out.writestr("xl/worksheets/sheet1.xml", sheet)
    assert readers.sheet_rows(path.read_bytes()) == [["Dotaz", "Jazyk", None, "Kliky"], ["bolest hlavy", None, None, "12"], [None, "cs"]]
    (tmp_path / "a_search_log.csv").write_text("query,lang\nx,y\n")
    (tmp_path / "other.xlsx").write_text("")
    (tmp_path / "old_search_log.xls").write_text("binary")
    found = readers.discover(spark, str(tmp_path)).collect()
    assert sorted((r.kind, r.path.rsplit("/", 1)[1]) for r in found) == [
        ("internal", "a_search_log.csv"), ("internal", "old_search_log.xls"), ("internal", "site_search_log.xlsx")
    ]
    names = {"Dotaz": "query", "Jazyk": "lang", "Kliky": "clicks"}
    rows = readers.read_internal_xls(spark, str(path), names).collect()
    assert [(r.query, r.lang, r.clicks, r.source_file) for r in rows] == [("bolest hlavy", None, 12, "site_search_log.xlsx")]


def test_exports_and_packages(spark, tmp_path):
    from sievelight.sources import readers

    (tmp_path / "export.csv").write_text('id,title,note\n1,Golden A,"two\nlines, ""quoted"""\n2,Other,\n')
    rows = readers.read_export(spark, str(tmp_path / "export.csv"))
    assert [tuple(r) for r in rows.collect()] == [("1", "Golden A", 'two\nlines, "quoted"'), ("2", "Other", None)]
    assert [r.id for r in readers.packages_titled(rows, "gOLDEN").collect()] == ["1"]


def test_timings(spark):
    took = mx.projection_latency(64, 100)
    assert took["dim"] == 64 and took["us_per_query"] > 0
    runs = spark.createDataFrame([("a", 10, 2.0), ("a", 30, 2.0), ("b", 0, 0.0)], "e string, n long, s double")
    got = {r.e: (r.per_second, r.ms_each) for r in mx.per_second(runs, "n", "s", ["e"]).collect()}
    assert got == {"a": (10.0, 100.0), "b": (None, None)}


def test_recogniser_behind_the_filter(spark):
    df = column(spark, ["Anna Nováková", "nothing", None, ""])

    def load():
        known = {"Anna Nováková"}
        return lambda texts: [t in known for t in texts]

    assert values(df, filters.recognised(F.col("x"), load)) == [True, False, False, False]


def test_servers(spark):
    """Embeddings and answers over HTTP, from a server in this process; failures give null rows."""
    from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
    from threading import Thread

    class Server(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "input" in body:
                rows = [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in enumerate(body["input"])]
                said = {"data": rows[::-1]}
            elif "fail" in body["messages"][0]["content"]:
                self.send_error(500)
                return
            else:
                said = {"choices": [{"message": {"content": '{"grade": 2, "confidence": 5}'}}], "usage": {"prompt_tokens": 3, "completion_tokens": 4}}
            data = json.dumps(said).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    texts = spark.createDataFrame([("a", "one"), ("b", "three")], "text_id string, text string")
    got = providers.embed(texts, providers.HttpEmbedder(url, "m", 2), attempts=1).collect()
    assert {(r.text_id, r.embedding[0], r.error) for r in got} == {("a", 3.0, None), ("b", 5.0, None)}
    told = providers.HttpEmbedder(url, "m", 2, instruction="do").embed(["one"])
    assert told[0][0] == len("Instruct: do\nQuery: one")
    wrong = providers.embed(texts, providers.HttpEmbedder(url, "m", 3), attempts=1).collect()
    assert all(r.embedding is None and r.error for r in wrong)
    prompts = spark.createDataFrame([(1, "good"), (2, "fail")], "id int, prompt string")
    answers = providers.call_model(prompts, providers.HttpModel(url, "m"), "m", "axis_judge", "id", attempts=1)
    rows = {r.id: r for r in answers.collect()}
    assert (rows[1].prompt_tokens, rows[1].completion_tokens) == (3, 4) and rows[2].response is None and rows[2].error
    server.shutdown()


def test_settled_frames_prune_columns(spark):
    df = storage.settled(spark.range(100).selectExpr("id", "id * 2 AS twice", "array(id) AS a"))
    plan = df.filter("id > 5").select("twice")._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<id:bigint,twice:bigint>" in plan and df.count() == 100


def test_average_linkage(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(14, 5))
    merges = linkage.upgma(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d, group, heights = 1 - u @ u.T, {k: [k] for k in range(14)}, []
    while len(group) > 1:
        h, a, b = min(
            (np.mean([d[i, j] for i in group[p] for j in group[q]]), p, q) for p in group for q in group if p < q
        )
        heights.append(h)
        new = max(group) + 1
        group[new] = group.pop(a) + group.pop(b)
    assert [h for _, _, h, _ in merges] == pytest.approx(heights)
    assert len(set(linkage.cut_tree(14, merges, merges[4][2]))) == 9
    centres = spark.createDataFrame(
        [(k, "even" if k % 2 else "odd", v.tolist()) for k, v in enumerate(x)] + [(99, "alone", [1.0] * 5)],
        "cluster_id int, category string, centroid array<double>",
    )
    merged = linkage.merge_within(centres, "category").collect()
    assert len(merged) == 15 and {r.merged for r in merged if r.category == "alone"} == {0}


def test_nearest_centroid_ways_agree(spark, monkeypatch):
    rng = np.random.default_rng(5)
    points = [(k, rng.normal(size=6).tolist()) for k in range(40)] + [(98, [0.0] * 6), (99, None)]
    centres = [(k, rng.normal(size=6).tolist()) for k in range(30)] + [(77, points[0][1]), (78, points[0][1])]
    p = spark.createDataFrame(points, "id long, embedding array<double>")
    c = spark.createDataFrame(centres, "cluster_id int, centroid array<double>")
    found = []
    for jvm, most in ((10**6, 10**6), (0, 10**6), (0, 7)):
        monkeypatch.setattr(clusters, "JVM_CENTROID_VALUES", jvm)
        monkeypatch.setattr(clusters, "BROADCAST_CENTROIDS", most)
        rows = clusters.nearest_centroid(p, c, ["id"]).collect()
        found.append({r.id: (r.cluster_id, round(r.cosine, 9)) for r in rows if r.cosine is not None})
    assert found[0] == found[1] == found[2] and found[0][0][0] == 77 and len(found[0]) == 40


def test_density_clusters(spark):
    rng = np.random.default_rng(6)
    rows = [
        (k, (np.eye(6)[k % 3] + rng.normal(0, 0.03, 6)).tolist()) for k in range(90)
    ] + [(100 + k, rng.normal(size=6).tolist()) for k in range(6)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {r.id: r.cluster_id for r in density.density_clusters(df, "id", block=40).collect()}
    found = {got[k] for k in range(90)} - {-1}
    assert len(found) == 3 and all(len({got[k] for k in range(90) if k % 3 == g} - {-1}) == 1 for g in range(3))
    sizes = [sum(v == c for v in got.values()) for c in found]
    assert min(sizes) >= 10 and len(got) == 96
    moved = clusters.reassign_noise(
        df.withColumn("cluster_id", F.when(F.col("id") % 9 == 0, -1).otherwise(F.col("id") % 3)), "id"
    )
    assert moved.filter("cluster_id = -1").count() == 0 and moved.count() == 96


def test_components(spark):
    edges = [(1, 2), (2, 3), (5, 6), *((k, k + 1) for k in range(10, 40))]
    got = {r.node: r.component for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5} | dict.fromkeys(range(10, 41), 10)


def test_greedy_sample_meets_quotas(spark):
    rng = random.Random(2)
    cats = list(golden.CATEGORY_WEIGHT)
    rows = [
        (
            f"q{k}",
            f"t{k}",
            f"s{k % 30}",
            rng.choice(cats),
            f"MU{rng.choice([0, 0, 0, 1, 2])}",
            f"PU{rng.choice([0, 0, 1])}",
            f"ET{rng.randint(0, 2)}",
            *(rng.randint(1, 5) for _ in range(3)),
        ) for k in range(300)
    ]
    picks = spark.createDataFrame(
        rows,
        "query_key string, query_text string, supercluster_id string, clinical_relevance string, mu_grade string, pu_grade string, et_grade string, mu_confidence int, pu_confidence int, et_confidence int",
    )
    targets = {"MU0": 10, "MU1": 10, "MU2": 10, "PU0": 15, "PU1": 14, "PU2": 1, "ET0": 10, "ET1": 10, "ET2": 10}
    got = golden.greedy_sample(picks, 30, 5, targets, cap=3).collect()
    assert len(got) == 35 == len({r.query_key for r in got}) and [
        r["order"] for r in sorted(got, key=lambda r: r["order"])
    ] == list(range(35))
    by = {r[0]: r for r in rows}
    per = {}
    for r in got:
        if r.phase != "scarce":
            per[by[r.query_key][2]] = per.get(by[r.query_key][2], 0) + 1
    assert max(per.values()) <= 3
    mu = [by[r.query_key][4] for r in got if r.phase != "buffer"]
    assert abs(mu.count("MU2") - 10) <= 2
    short = {r.cell: r.shortfall for r in golden.shortfall(picks, targets).collect()}
    assert short["PU2"] == 1 and short["MU0"] == 0


def test_resolution_and_raters(spark):
    rows = [(1, 0, None), (1, 0, None), (2, 1, 2), (2, 0, 2), (3, 1, None), (3, 2, None)]
    got = {
        r.item: (r.gold, r.provenance)
        for r in golden.resolved(spark.createDataFrame(rows, "item int, v int, a int"), "item", "v", "a").collect()
    }
    assert got == {1: (0, "agreement"), 2: (2, "adjudicated"), 3: (None, "unresolved")}
    wide = spark.createDataFrame(
        [(k, 1.0, 0.0, 2.0, 1.0 if k < 3 else None, 1.0, 1.0, 0.0) for k in range(10)],
        "id int, ann_MU double, ann_PU double, ann_ET double, bob_MU double, bob_PU double, bob_ET double, gold_MU double",
    )
    assert golden.raters_of(wide, least=5) == ["ann"] and golden.raters_of(wide, least=3) == ["ann", "bob"]
    assert golden.ratings_long(wide, "id", ["ann"]).count() == 30 and golden.ratings_long(wide, "id", []).count() == 0


def test_probe_dataset_keeps_clusters_apart(spark):
    real = spark.createDataFrame(
        [("MU", f"q{k}", f"text {k}", f"s{k % 9}", k % 3) for k in range(60)],
        "axis string, query_key string, query_text string, supercluster_id string, grade int",
    )
    none = spark.createDataFrame(
        [],
        "axis string, anchor_query_key string, anchor_grade int, supercluster_id string, target_grade int, text string, verifier_confirmed boolean",
    )
    data = pairs.probe_dataset(real, none, "MU", zero_cap=10)
    assert data.count() == 30
    sets.expect_one_value(data, "supercluster_id", "split")


def test_readers(spark, tmp_path):
    (tmp_path / "site_ga4_a.csv").write_text(
        "# Report\n# 20240101-20240131\n\nDotaz,Prokliky,Zobrazení,CTR,Pozice\nHledaný dotaz,5,10,0.5,1.5\nx,1,1,1,1\n,3,3,3,3\nbad line,1\n"
    )
    (tmp_path / "site_ga4_b.csv").write_text(
        "# 20240201\nQuery,Device,Clicks,Impressions,CTR,Position\ndotaz dva,mobile,7,9,0.1,2.0\n"
    )
    rows = {r.query_key: r for r in readers.read_ga4(spark, str(tmp_path / "*ga4*.csv")).collect()}
    assert set(rows) == {"hledany dotaz", "dotaz dva"}
    assert (
        rows["hledany dotaz"].clicks, rows["hledany dotaz"].device, rows["hledany dotaz"].date_end
    ) == (5, None, "2024-01-31")
    assert (
        rows["dotaz dva"].device, rows["dotaz dva"].impressions, rows["dotaz dva"].date_start
    ) == ("mobile", 9, "2024-02-01")
    (tmp_path / "my_search_log.csv").write_text(
        "query,lang,clicks,found,last\nAhoj světe,cs,3,x,1. 2. 2024 10:00\n,cs,1,1,\nab,cs,1,1,\n"
    )
    r = readers.read_internal(spark, str(tmp_path / "my_search_log.csv")).collect()
    assert len(r) == 1 and (
        r[0].query_key, r[0].clicks, r[0].found, r[0].last_searched, r[0].last_year
    ) == ("ahoj svete", 3, None, "2024-02-01", 2024)
    assert {
        (x.kind, x.path.rsplit("/", 1)[1]) for x in readers.discover(spark, str(tmp_path)).collect()
    } == {("ga4", "site_ga4_a.csv"), ("ga4", "site_ga4_b.csv"), ("internal", "my_search_log.csv")}
    (tmp_path / "e.json").write_text(json.dumps({"data": [{"firstname": "A", "lastname": "B"}, {"lastname": "C"}]}))
    assert readers.read_employees(spark, str(tmp_path / "e.json")).count() == 2
    (tmp_path / "r.jsonl").write_text('{"id": 1, "v": "a"}\n\n{"id": 2}\n')
    assert readers.read_records(spark, str(tmp_path / "r.jsonl"), "id long, v string").count() == 2
    both = sets.union_all(
        readers.read_ga4(spark, str(tmp_path / "*ga4*.csv")),
        readers.read_internal(spark, str(tmp_path / "my_search_log.csv")),
    )
    writers.write_csv(both, str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 3


def test_providers(spark):
    texts = spark.createDataFrame(
        [("a", "one text"), ("b", "two"), ("a", "one text"), ("c", None)], "text_id string, text string"
    )
    first = providers.embed_missing(texts, None, providers.HashedEmbedder(16)).cache()
    assert first.count() == 3 and first.filter("error is not null").count() == 0
    assert providers.embed_missing(
        texts, first.filter("text_id <> 'b'"), providers.HashedEmbedder(16)
    ).collect()[0].text_id == "b"

    class Failing(providers.HashedEmbedder):
        def embed(self, values):
            if "two" in values:
                raise RuntimeError("refused")
            return super().embed(values)

    got = {r.text_id: (r.embedding is None, r.error) for r in providers.embed(texts, Failing(16), attempts=1).collect()}
    assert got == {"a": (False, None), "b": (True, "refused"), "c": (False, None)}
    prompts = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "id int, prompt string")
    answers = providers.call_model(prompts, stand_ins.grade_by_words, "m", "axis_judge", "id").cache()
    assert answers.count() == 3 and answers.select("response").distinct().count() == 2
    again = providers.call_model(prompts, None, "m", "axis_judge", "id", cache=answers.dropDuplicates(["cache_key"]))
    assert providers.usage(again).first().n_cached == 3
    assert all(
        0 <= r.grade <= 2 and 1 <= r.confidence <= 5 for r in providers.parsed(answers, "axis_judge", ["id"]).collect()
    )
    manifest = spark.createDataFrame([("t", "d1")], "task string, digest string")
    assert providers.same_inputs(
        manifest, "t", "d1"
    ) and not providers.same_inputs(manifest, "t", "d2") and providers.same_inputs(manifest, "u", "x")


def test_stream_embeds_each_key_once(spark, tmp_path):
    from sievelight.streaming.incremental import embed_stream

    schema = "text_id string, text string"
    for k, rows in enumerate([[("a", "x"), ("b", "y")], [("b", "y"), ("c", "z")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        embed_stream(stream, providers.HashedEmbedder(8), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination(60)
        assert spark.read.parquet(f"{tmp_path}/out").count() == 2 + k


def test_super_clusters(spark):
    cl = spark.createDataFrame(
        [("x", 0, 1, "L1", 5), ("x", 0, 2, "L2", 9), ("x", 1, 3, "L3", 1)],
        "category string, merged int, cluster_id int, label string, n_queries long",
    )
    members = spark.createDataFrame(
        [(1, "k", "K", 1), (2, "k", "k", 7), (2, "m", "M", 3)],
        "cluster_id int, query_key string, query string, clicks long",
    )
    got = {r.supercluster_id: r for r in clusters.super_clusters(members, cl).collect()}
    assert got["x_0001"].label == "L2" and got["x_0001"].constituents == [1, 2] and got["x_0002"].queries is None
    assert [(q.query, q.clicks) for q in got["x_0001"].queries] == [("k", 7), ("M", 3)]
    words = spark.createDataFrame(
        [(1, 5, ["a", "b"]), (2, 9, ["c", "a"])], "cluster_id int, n long, w array<string>"
    ).withColumn("g", F.lit(1))
    assert clusters.merged_words(words, ["g"], "w", "n").first().w == ["c", "a", "b"]


def test_backfill_swaps_in_what_verifies(spark):
    from sievelight.operators import backfill as bf

    rows = [
        (f"q{k}", f"Q{k}", f"s{k % 5}", "oncology-core", "MU1" if k % 4 == 0 else "MU0", "PU0", f"ET{k % 3}", 3, 3, 3)
        for k in range(60)
    ]
    picks = spark.createDataFrame(
        rows,
        "query_key string, query_text string, supercluster_id string, clinical_relevance string, mu_grade string, pu_grade string, et_grade string, mu_confidence int, pu_confidence int, et_confidence int",
    )

    def write(prompt):
        topic = prompt.rsplit(" ", 1)[1].rstrip(".")
        made = [{"query": f"New {topic} {k}"} for k in range(3)] + [{"query": "q1"}]
        return json.dumps({"generated": made}), 1, 1

    def judge(prompt):
        good = not prompt.endswith("0.")
        return json.dumps(
            {"mu_grade": "MU2" if good else "MU1", "pu_grade": "PU0", "et_grade": "ET2", "confidence": 4}
        ), 1, 1

    assert bf.short_cells(picks, {"MU2": 4, "PU0": 9, "PU2": 0}) == {"MU2": 4}
    out = bf.backfill(picks, write, judge, "stand-in", {"MU2": 4}).collect()
    new = [r for r in out if r.origin == "synthesized"]
    assert len(out) == 60 and len(new) == 4 and {r.mu_grade for r in new} == {"MU2"}
    assert all(r.query_key.startswith("new s") and not r.query_key.endswith("0") for r in new)
    gone = {r[0] for r in rows} - {r.query_key for r in out}
    assert all(rows[int(k[1:])][4] == "MU0" and rows[int(k[1:])][6] == "ET2" for k in gone)
    assert {r.origin for r in bf.backfill(picks, write, judge, "stand-in", {"MU2": 0}).collect()} == {"picked"}
