from __future__ import annotations

import random
import re

import numpy as np
import pytest

from sievelight.llm import near_dedup as nd
from sievelight.llm.common import Scratch
from sievelight.llm.components import components

import exact_join
from made_up import words

WORD = re.compile("[^\x20\x09-\x0d]+")


def shingles(text, k):
    found = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(found) >= k:
        return frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1))
    return frozenset([tuple(found)]) if found else frozenset()


def truth(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            a, b = len(sets[i]), len(sets[j])
            if not a or not b or 100 * min(a, b) < percent * max(a, b):
                continue
            common = len(sets[i] & sets[j])
            if 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = label[i], label[j]
                label = [b if x == a else x for x in label]
    least = {}
    for (doc, _), l in zip(rows, label, strict=True):
        if doc is not None:
            least[l] = min(least.get(l, doc), doc)
    return [(doc, len(s), least.get(l)) for (doc, _), s, l in zip(rows, sets, label, strict=True)]


@pytest.mark.parametrize("k", [4, 5])
def test_odd_documents(odd, odd_texts, k):
    got = nd.near_duplicates(odd, k).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(
        ((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key
    ) == sorted(truth(odd_texts, k), key=key)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_edited_copies_against_brute_force(spark):
    rng = random.Random(11)
    rows = []
    for base in range(12):
        text = [f"w{rng.randint(0, 3000)}" for _ in range(rng.choice([6, 30, 120]))]
        for _ in range(rng.choice([1, 3, 25])):
            copy = list(text)
            for _ in range(rng.randint(0, max(1, len(text) // 22))):
                copy[rng.randrange(len(copy))] = f"e{rng.randint(0, 10**6)}"
            rows.append((len(rows) * 7 % 1009 + 1, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in nd.near_duplicates(docs, 4).collect()}
    assert got == {d: (n, c) for d, n, c in truth(rows, 4)}


def test_links_that_no_centre_shows(spark, monkeypatch):
    """A chain in one bucket: the centre is linked to none of the others, which are linked in a row."""
    rng = random.Random(2)
    base = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(40):
        copy = list(base)
        for j in range(k):
            copy[j * 5] = f"x{j}"
        rows.append((k + 1, " ".join(copy)))
    rng.shuffle(rows)
    monkeypatch.setattr(nd, "band_keys", lambda sketch: np.tile(np.arange(nd.BANDS, dtype=np.int64), (len(sketch), 1)))
    monkeypatch.setattr(nd, "BLOCK", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, 4).collect()}
    assert got == {d: c for d, _, c in truth(rows, 4)}


def test_small_sets_at_the_threshold(spark):
    """Pairs that share just enough shingles, in buckets that every node shares."""
    rng = random.Random(12)
    rows = []
    for k in range(150):
        n = rng.choice([7, 8, 12, 16])
        base = [f"w{k}x{j}" for j in range(n)]
        more = n - 3
        # With one word more, more of more + 1 shingles are shared: at least 0.8 from 4 of 5 on.
        rows += [(2 * k + 1, " ".join(base)), (2 * k + 2, " ".join([*base, "end"]))]
        assert 100 * more >= 80 * (more + 1)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in nd.near_duplicates(docs, 4).collect()}
    assert got == {d: c for d, _, c in truth(rows, 4)} and sum(d != c for d, c in got.items()) == 150


def test_bound_never_rules_out_a_link():
    rng = np.random.default_rng(4)
    for _ in range(300):
        n = int(rng.choice([1, 4, 9, 40, 700, 20_000]))
        common, a, b = (rng.integers(0, 2**64, k, dtype=np.uint64) for k in (n, n // 8, n // 9))
        one, two = np.unique(np.r_[common, a]), np.unique(np.r_[common, b])
        most = np.minimum(*nd._counts_of([nd.bin_counts(one), nd.bin_counts(two)])).sum()
        assert len(np.intersect1d(one, two)) <= most <= min(len(one), len(two))
    many = np.sort(rng.integers(0, 2**64, 80_000, dtype=np.uint64) >> np.uint64(10))
    assert nd._counts_of([nd.bin_counts(many)]).sum() == 80_000


def test_exact_join_is_exact():
    rng = random.Random(14)
    rows = [(k, " ".join(rng.choice("abcd") for _ in range(rng.randint(0, 9)))) for k in range(250)]
    for k in (1, 2, 4):
        assert exact_join.components(rows, k) == {d: (n, c) for d, n, c in truth(rows, k)}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_query_against_an_exact_join(spark, sf):
    """All documents of the query, on their sets of words."""
    from sievelight.llm import queries

    sf = f"/root/testdata/{sf}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in queries.op6_near_dedup(spark, sf).collect()}
    assert got == {d: (n, c, c == d) for d, (n, c) in exact_join.components(rows, 4).items()}


def test_a_hot_bucket_moves_no_sets(spark, monkeypatch):
    """4000 nodes of a bucket: what is dealt out grows by blocks of neighbouring size classes and holds no shingles."""
    monkeypatch.setattr(nd, "BLOCK", 100)
    going = spark.range(4000).selectExpr(
        "7L bucket", "3 band", "id node", "id component", "10 + (id % 2000) n_shingles", "cast('x' as binary) counts", "array(id) bands"
    )
    dealt = nd.dealt_in_blocks(going, 80, Scratch(spark, "test"))
    assert "shingles" not in dealt.columns
    copies = dealt.groupBy("node").count().agg({"count": "max"}).first()[0]
    assert copies < 4000 / 100 and dealt.count() < 4000 * 4000 / 100 * 0.75
    largest = dealt.groupBy("bucket", "low", "i", "high", "j").count().agg({"count": "max"}).first()[0]
    assert largest <= 4 * 100
    # Every pair of sizes that can be similar enough meets in one pair of blocks.
    met = dealt.filter("node % 97 = 0").select("node", "n_shingles", "bucket", "low", "i", "high", "j")
    keys = {}
    for r in met.collect():
        keys.setdefault((r.node, r.n_shingles), set()).add(tuple(r)[2:])
    for (a, m), ka in keys.items():
        for (b, n), kb in keys.items():
            if a < b and 100 * min(m, n) >= 80 * max(m, n):
                assert len(ka & kb) >= 1


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    common, a, b = (rng.integers(0, 2**64, n, dtype=np.uint64) for n in (800, 100, 100))
    one, two = nd.sketches([np.unique(np.r_[common, a]), np.unique(np.r_[common, b])])
    assert abs((one == two).mean() - 0.8) < 0.1
    few = nd.sketches([np.array([7], np.uint64)])
    assert (few == 7).all()


def test_long_texts_are_hashed_in_parts(monkeypatch):
    rng = random.Random(3)
    text = " ".join(f"w{rng.randint(0, 10**6)}" for _ in range(3000)) + "\t" + "z" * 500
    whole = next(nd.shingle_sets([text], 4))
    monkeypatch.setattr(nd, "SLICE", 100)
    assert np.array_equal(whole, next(nd.shingle_sets([text], 4)))
    both = list(nd.shingle_sets([text, "a b", text], 4))
    assert np.array_equal(whole, both[0]) and np.array_equal(whole, both[2]) and len(both[1]) == 1


def test_components(spark):
    edges = [
        (1, 2),
        (2, 3),
        (9, 3),
        (20, 21),
        (30, 30),
        *((100, k) for k in range(101, 180)),
        *((k, k + 1) for k in range(300, 330)),
    ]
    got = {
        r.node: r.component
        for r in components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()
    }
    assert {got[k] for k in (1, 2, 3, 9)} == {1} and got[21] == 20 and 30 not in got
    assert {got[k] for k in range(100, 180)} == {100} and {got[k] for k in range(300, 331)} == {300}
    assert components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test")).count() == 0


def test_drop_keeps_columns(odd, none):
    kept = nd.drop_near_duplicates(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 5, 8, 9}
    assert not {r.doc_id for r in kept.collect()} & {6, 7, 10, 11}
    assert nd.near_duplicates(none).count() == 0 and nd.drop_near_duplicates(none).count() == 0


def test_drop_tells_rows_apart_by_more_than_ids(spark):
    base = words(21, 60).split()
    near = " ".join([*base, "more"])
    rows = [
        (None, near), (1, " ".join(base)), (None, words(22, 60)), (None, words(23, 60)), (2, words(24, 60)), (
            2, near + " "
        ), (None, words(25, 60)), (None, words(25, 60) + " more"), (3, words(26, 60)), (3, words(26, 60)), (
            None, None
        ), (None, ""), (4, words(27, 60) + " more"), (None, words(27, 60)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [tuple(r) for r in nd.drop_near_duplicates(docs).collect()]
    pair = {rows[6], rows[7]}
    assert len(pair & set(got)) == 1
    want = [rows[k] for k in (1, 2, 3, 4, 8, 10, 11, 12)]
    key = lambda r: (r[0] or 0, r[1] or "", r[1] is None)
    assert sorted((r for r in got if r not in pair), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("ids", ["none", "one", "two"])
def test_rows_with_no_id_or_the_same(spark, monkeypatch, ids):
    """Each text that is looked for meets its own copies alone, whatever the ids are."""
    rng = random.Random(3)
    rows = []
    for base in range(30):
        text = [f"w{rng.randint(0, 5000)}" for _ in range(60)]
        for k in range(8):
            own = list(text)
            own[rng.randrange(60)] = f"x{k}"
            rows.append(({"none": None, "one": 7, "two": base % 2}[ids], " ".join(own)))
    met, pick = [], nd._pick

    def counted(*args):
        out = pick(*args)
        met.append(out.count())
        return out

    monkeypatch.setattr(nd, "_pick", counted)
    got = nd.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=key) == sorted(truth(rows, 4), key=key)
    assert met and max(met) <= len(rows)
