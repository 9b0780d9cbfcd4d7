from __future__ import annotations

import corpus_pipeline
import pytest

from sievelight.llm import packing, secrets

from made_up import words
from test_near_dedup import truth as near_truth
from test_exact_dedup import truth as exact_truth
from test_scans import base_spans

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    base = words(7, 150).split()
    texts = [words(k, 80) for k in range(30)] + [
        " ".join(base),
        " ".join([*base[:70], "new", *base[71:]]),
        words(3, 80) + " ",
        None,
        "",
        "12 34",
        "password=hunter2222 " + words(99, 50),
    ]
    return spark.createDataFrame([(k + 1, t, "en", "s", len(t or "")) for k, t in enumerate(texts)], DOCUMENTS)


def stage(name):
    return dict(corpus_pipeline.STAGES)[name]


def pairs_of(df):
    return sorted((r.doc_id, r.text) for r in df.collect())


def test_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "secrets", "packing"]


def test_language_stage_rejects_what_has_no_letters(spark, docs):
    kept = stage("language_id")(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {34, 35, 36}


def test_dedup_stages_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    exact = {k for k, _ in exact_truth(rows).values()}
    assert {r.doc_id for r in stage("exact_dedup")(spark, docs, "").collect()} == exact
    near = {c if c is not None else d for d, _, c in near_truth(rows, 5)}
    kept = stage("near_dedup")(spark, docs, "")
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == near


def test_secret_stage_redacts_and_keeps_all(spark, docs):
    out = stage("secrets")(spark, docs, "")
    assert out.columns == docs.columns and out.count() == docs.count()
    assert not any(base_spans(t) for _, t in pairs_of(out))
    changed = [r for r in out.collect() if "[secret]" in (r.text or "")]
    assert [r.doc_id for r in changed] == [37] and changed[0].n_chars == len(changed[0].text)
    assert secrets.RULES[:3] == secrets.BASE


def test_run_is_the_stages_one_after_another(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(tuple(r)[:5] for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    step = docs
    for _, f in corpus_pipeline.STAGES[:-1]:
        step = f(spark, step, str(tmp_path))
    want = sorted(tuple(r)[:5] for r in packing.pack_documents(step, corpus_pipeline.VOCABULARY).collect())
    assert got == want and {r[0] for r in got} == {*range(1, 32), 33, 37} - {4}


def test_empty_table(spark, docs):
    step = docs.limit(0)
    for _, f in corpus_pipeline.STAGES:
        step = f(spark, step, "")
    assert step.count() == 0


def test_null_texts_pass_the_dedup_and_secret_stages(spark, docs):
    step = docs.filter("text is null")
    for name in ("exact_dedup", "near_dedup", "secrets"):
        step = stage(name)(spark, step, "")
    assert [tuple(r) for r in step.collect()] == [(34, None, "en", "s", None)] or step.first().text is None
