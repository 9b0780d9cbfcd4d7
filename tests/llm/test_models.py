"""Language identification, quality scores and nearest neighbours."""

from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import language_id as li
from sievelight.llm import nearest, quality
from sievelight.llm import queries

SF = "/root/testdata/sf0.01"
SPEECH = {
    "one": "the house and the garden were quiet this morning when they walked home again",
    "two": "el perro corre por la calle mientras los vecinos miran desde sus ventanas abiertas",
    "three": "der hund schläft unter dem großen tisch und niemand möchte ihn heute wecken",
}


def speak(lang, seed, n=60):
    rng = random.Random(f"{lang}{seed}")
    return " ".join(rng.choice(SPEECH[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def spoken(spark):
    rows = [(k, speak(lang, k), lang, "clash") for k, lang in enumerate(list(SPEECH) * 60)]
    rows += [
        (1000, None, "one", ""),
        (1001, "", "two", ""),
        (1002, "123 ?!", None, ""),
        (None, speak("two", 7), "two", ""),
        (1003, speak("three", 8, 300_000), None, ""),
        (1004, speak("one", 1), None, ""),
        (1004, speak("one", 1), None, ""),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_languages(spoken):
    model = li.train(spoken)
    assert model.languages == sorted(SPEECH)
    rows = li.identify(spoken, model, ["doc_id", "lang"]).collect()
    assert len(rows) == spoken.count()
    for r in rows:
        if r.doc_id in (1000, 1001, 1002):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred == (r.lang or {1003: "three", 1004: "one"}[r.doc_id]) and 0 < r.score <= 1


def test_held_out_labels_play_no_part(spoken):
    out = zlib.crc32(b"5") % 4
    assert out in range(4)
    lied = spoken.withColumn(
        "lang", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, "lie").otherwise(F.col("lang"))
    )
    one, two = li.train(lied), li.train(spoken)
    assert np.array_equal(one.cells, two.cells) and one.languages == two.languages


def test_order_and_partitions_play_no_part(spoken):
    one, two = li.train(spoken), li.train(spoken.repartition(7).orderBy(F.rand(3)))
    assert np.array_equal(one.cells, two.cells)


def test_more_languages_than_a_word_has_bits(spark):
    """Each of 70 languages has words of its own, the rarest only a few documents."""
    rng = random.Random(8)
    lexicon = {f"l{k:02d}": ["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [
        (None if i >= 6 else 100 * n + i, " ".join(rng.choice(own) for _ in range(80)), lang if i < 6 else None, "x", "x")
        for n, (lang, own) in enumerate(lexicon.items())
        for i in range(8 if n else 30)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string, lang_pred string")
    model = li.train(docs)
    assert model.languages == sorted(lexicon) and model.cells.shape[1] == 2
    got = li.identify(docs, model, docs.columns)
    assert got.columns == [*docs.columns, "_lang_pred", "_score"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r.text.split()[0] in lexicon[r["_lang_pred"]] and (r.score, r.lang_pred) == ("x", "x")
    assert li.identify(docs, model, ["doc_id"]).columns == ["doc_id", "lang_pred", "score"]


def test_ids_at_both_ends(spark):
    rows = [(k, speak("one", k % 7), "one") for k in (-(2**63), 2**63 - 1, *range(20))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(k, abs(k) % 2, 0) for k, *_ in rows], "doc_id long, quality int, toxic int")
    assert li.identify(docs, li.train(docs), ["doc_id"]).filter("lang_pred = 'one'").count() == len(rows)
    assert quality.score(docs, quality.train(docs, labels), ["doc_id"]).count() == len(rows)


def strings_of(text):
    """The n-grams of a text, as strings, by the definition alone."""
    low = ["".join(c.lower() if len(c.lower()) == 1 else c) if c.isalpha() else " " for c in text]
    line = " " + "".join(low) + " "
    while "  " in line:
        line = line.replace("  ", " ")
    return [line[k : k + li.GRAM] for k in range(len(line) - li.GRAM + 1)]


def test_counts_against_brute_force(spoken):
    """Which n-grams belong to which language, and how many of a text's do, counted with strings and dictionaries."""
    taken = [r for r in spoken.collect() if r.lang and r.text and r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 != 2]
    occur = {lang: Counter(g for r in taken if r.lang == lang for g in strings_of(r.text)) for lang in SPEECH}
    rate = {lang: {g: n / sum(c.values()) for g, n in c.items() if n >= li.LEAST_COUNT} for lang, c in occur.items()}
    own = {
        lang: {g for g, x in some.items() if x >= li.LEAST_SHARE * max(r.get(g, 0) for r in rate.values())}
        for lang, some in rate.items()
    }
    model = li.train(spoken)
    texts = [speak("one", 500), speak("two", 501, 7), "Ab1cD éß東  京!", "", "x", "ǅ İstanbul"]
    found, total, letters = model.counts(texts)
    for k, text in enumerate(texts):
        held = strings_of(text)
        assert total[k] == len(held) and letters[k] == sum(c.isalpha() for c in text)
        for j, lang in enumerate(model.languages):
            hits = sum(g in own[lang] for g in held)
            # A Bloom filter misses nothing; what it finds beyond is as rare as its rate says.
            assert hits <= found[k, j] <= hits + 5 + 4 * model.false_positive[j] * len(held)


def test_slices_don_t_change_counts(spoken, monkeypatch):
    model = li.train(spoken)
    texts = [speak("one", 3, 500), "", speak("two", 4, 3), "ab"]
    whole = model.counts(texts)
    monkeypatch.setattr(li, "SLICE", 50)
    parts = model.counts(texts)
    assert all(np.array_equal(a, b) for a, b in zip(whole, parts, strict=True))
    for size in (1, 2, 3, 7):
        monkeypatch.setattr(li, "SLICE", size)
        for text in ("a", "ab1", "  ab  cd--e", "...", "abc def ghi", "a" * 21):
            hashes, letters = zip(*li.long_grams(text), strict=True)
            once = li.grams([text])
            assert np.array_equal(np.concatenate(hashes), once[0]) and sum(letters) == once[2][0]


def test_filters_hold_every_gram_and_few_others():
    model = li.build(
        {
            k: (*np.unique(li.grams([speak(k, s) for s in range(20)])[0], return_counts=True), 20 * 300)
            for k in SPEECH
        }
    )
    rng = np.random.default_rng(1)
    strange = li.lookup(model.cells, rng.integers(0, 2**64, 20_000, dtype=np.uint64))
    for k, rate in enumerate(model.false_positive):
        assert 0 < rate < 0.05 and abs(((strange[:, 0] >> np.uint64(k)) & np.uint64(1)).mean() - rate) < 0.005
    known = li.grams([speak("one", 0)])[0]
    assert ((li.lookup(model.cells, known)[:, 0] & np.uint64(1)) == 1).mean() > 0.9
    assert li.build({}).predict(["abc"])[0] == ["und"]


def test_language_accuracy_on_held_out_documents(spark):
    got = queries.op2_language_id(spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).filter("held_out")
    assert got.filter("lang_pred = lang").count() >= 0.97 * got.count() > 0


def test_quality_on_held_out_documents(spark):
    got = queries.op7_quality(spark, SF).join(
        spark.read.parquet(f"{SF}/labels.parquet"), "doc_id"
    ).filter("held_out").toPandas()
    good, bad = got.score[got.quality == 1].to_numpy(), got.score[got.quality == 0].to_numpy()
    assert (good[:, None] > bad[None, :]).mean() > 0.9
    assert (got.predicted == got.quality).mean() > 0.9


def test_quality_model_is_the_same_in_any_order(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    repeated = docs.unionByName(docs.filter("doc_id % 5 = 0").withColumn("text", F.concat("text", F.lit(" again"))))
    one = quality.train(repeated, labels)
    two = quality.train(repeated.repartition(9).orderBy(F.rand(1)), labels.orderBy(F.rand(2)))
    assert (one.good, one.bad) == (two.good, two.bad) and len(one.good) > 1000
    assert (one.slope, one.intercept) == pytest.approx((two.slope, two.intercept), rel=1e-9)


def test_quality_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 5000)
    docs = spark.createDataFrame(
        [(k, speak("one", k, 100), "c") for k in range(80)] + [(500, speak("one", 1, 10_000), "c")], "doc_id long, text string, score string"
    )
    labels = spark.createDataFrame([(k, k % 2, 0) for k in [*range(80), 500]], "doc_id long, quality int, toxic int")
    model = quality.train(docs, labels)
    assert 0 < len(model.good) <= 5000 and 0 < len(model.bad) <= 5000
    got = quality.score(docs, model, ["score", "doc_id"])
    assert got.columns == ["score", "doc_id", "_score", "predicted"]
    assert {(r.score, 0 <= r["_score"] <= 1) for r in got.collect()} == {("c", True)}


def test_scores_against_sizes_computed_anew(spark):
    """Differences of compressed sizes, without the operator's compressors, and the curve over them."""
    import zstandard

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    sizes = []
    for raw in (model.good, model.bad):
        sizes.append(
            zstandard.ZstdCompressor(
                level=quality.LEVEL,
                dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
                write_content_size=False, write_checksum=False, write_dict_id=False,
            )
        )
    rows = quality.score(docs, model, ["text"]).filter("length(text) < 4000").limit(60).collect()
    for r in rows:
        data = r.text.encode()
        cuts = range(0, len(data), quality.BLOCK_BYTES)
        good, bad = (sum(len(c.compress(data[k : k + quality.BLOCK_BYTES])) for k in cuts) for c in sizes)
        x = (bad - good) / (bad + good) if data else 0.0
        assert r.score == pytest.approx(1 / (1 + math.exp(-(model.slope * x + model.intercept))), abs=1e-6)


def test_quality_of_odd_texts(spark, odd, none):
    labels = spark.createDataFrame(
        [(4, 1, 0), (9, 1, 0), (12, 0, 0), (15, 0, 0), (9, 0, 0), (None, 1, 0), (5, None, 0)],
        "doc_id long, quality int, toxic int",
    )
    model = quality.train(odd, labels)
    rows = quality.score(odd, model, ["doc_id"]).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    empty = {r.score for r in rows if r.doc_id in (1, 2)}
    assert len(empty) == 1
    bare = quality.train(none, labels.limit(0))
    assert {r.score for r in quality.score(odd, bare, ["doc_id"]).collect()} == {0.5}
    assert quality.score(none, model, ["doc_id"]).count() == 0


def test_language_of_empty_table(none, odd):
    model = li.train(none)
    assert model.languages == [] and li.identify(none, model, ["doc_id"]).count() == 0
    assert {r.lang_pred for r in li.identify(odd, model, ["doc_id"]).collect()} == {"und"}


def brute(ids, x, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for i, q in enumerate(ids):
        if q % 50 == 0:
            s = np.einsum("j,ij->i", u[i], u)
            order = sorted((round(-s[j], 12), ids[j]) for j in range(len(ids)) if j != i)
            out[q] = [j for _, j in order[:k]]
    return out


def test_recall_against_brute_force(spark):
    rows = spark.read.parquet(f"{SF.replace('0.01', '0.1')}/embeddings.parquet").select("vec_id", "embedding").collect()
    want = brute([r.vec_id for r in rows], np.array([r.embedding for r in rows], float), 5)
    got = {}
    for r in queries.op4_nearest(spark, SF.replace("0.01", "0.1")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.score, r.vec_id))
    hits = sum(len({v for _, v in got[q]} & set(w)) for q, w in want.items())
    assert set(got) == set(want) and hits >= 0.9 * sum(map(len, want.values()))
    assert all(a[0] >= b[0] for found in got.values() for a, b in zip(found, found[1:], strict=False))


def test_share_falls_with_structure(spark, monkeypatch):
    """Vectors around 40 centres: a small part of the table meets nearly all neighbours, in blocks of either kind."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(0, 40, 3000)] + 0.3 * rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>")
    budgets = []
    measured = nearest.measured_budget
    monkeypatch.setattr(nearest, "measured_budget", lambda *a: budgets.append(measured(*a)) or budgets[-1])
    monkeypatch.setattr(nearest, "BLOCK_ENTRIES", 700)
    monkeypatch.setattr(nearest, "BLOCK_QUERIES", 25)
    want = brute(list(range(3000)), x, 5)
    for sparse in (0.0, 1.0):
        monkeypatch.setattr(nearest, "SPARSE", sparse)
        got = {}
        for r in nearest.search(df, F.col("id") % 50 == 0).collect():
            got.setdefault(r.query_id, set()).add(r.vec_id)
        assert sum(len(got[q] & set(w)) for q, w in want.items()) >= 0.9 * 5 * len(want)
    assert len(budgets) == 2 and budgets[0] < 0.25 * 3000


def test_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(k, rng.normal(size=8).tolist()) for k in range(100)]
    same = [1.0, 2.0, 0.0, 0.0, 1.0, 0.0, 0.0, 3.0]
    rows += [(k, same) for k in range(100, 140)] + [
        (200, None),
        (250, [0.0] * 8),
        (300, [float("nan")] * 8),
        (350, [None, *same[1:]]),
        (400, [float("inf"), *same[1:]]),
        (None, same),
        (450, [1.0, 2.0]),
    ]
    df = spark.createDataFrame(
        [(*r, "x", "x") for r in rows], "vec_id long, embedding array<double>, cell string, part string"
    )
    got = nearest.search(df, F.col("id") % 50 == 0, share=1.0).orderBy("query_id", "rank").collect()
    good = [(k, v) for k, v in rows if k is not None and k < 140]
    want = brute([k for k, _ in good], np.array([v for _, v in good]), 5)
    assert {q: [r.vec_id for r in got if r.query_id == q] for q in want} == want
    assert [r.rank for r in got] == [1, 2, 3, 4, 5] * len(want)
    assert [r.vec_id for r in got if r.query_id == 100] == [101, 102, 103, 104, 105]
    few = nearest.search(df.filter("vec_id in (0, 1, 2)"), F.col("id") % 50 == 0).collect()
    assert sorted(r.rank for r in few) == [1, 2]
    assert nearest.search(df.limit(0), F.col("id") % 50 == 0).count() == 0


def test_traversal_visits_by_rising_distance():
    rng = np.random.default_rng(2)
    one, two = rng.random(6), rng.random(7)
    cells = nearest.traverse(one, two, np.ones(42, np.int64), 42)
    some = rng.integers(0, 3, 42)
    want = [c for c in sorted(range(42), key=lambda c: one[c // 7] + two[c % 7]) if some[c]]
    assert nearest.traverse(one, two, some, 10**9) == want
    sums = [one[c // 7] + two[c % 7] for c in cells]
    assert len(set(cells)) == 42 and sums == sorted(sums)
    assert len(nearest.traverse(one, two, np.ones(42, np.int64), 5)) == 5


def test_vectors_at_the_ends_of_double(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(60, 4))
    scale = [1e-170, 1e200, 1.0, 1e-308, 1e-320][:5]
    rows = [(k, (v * scale[k % 5] if k % 5 != 4 else v).tolist()) for k, v in enumerate(x)]
    rows.append((100, [5e-324, 0.0, 0.0, 0.0]))
    found = nearest.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("id") % 10 == 0, share=1.0).collect()
    u = {k: np.array(v) / np.abs(v).max() for k, v in rows}
    u = {k: v / np.linalg.norm(v) for k, v in u.items()}
    asked = [k for k, _ in rows if k % 10 == 0]
    assert len(found) == 5 * len(asked)
    for q in asked:
        want = sorted((-float(u[q] @ v), k) for k, v in u.items() if k != q)[:5]
        own = sorted((r.rank, r.vec_id, r.score) for r in found if r.query_id == q)
        assert [s for _, _, s in own] == pytest.approx([-w for w, _ in want], abs=1e-6)
