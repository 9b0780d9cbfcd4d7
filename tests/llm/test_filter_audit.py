"""The filter audit against applying every order of the filters one by one."""

from __future__ import annotations

import random
import re
from itertools import permutations

from made_up import words
from sievelight.llm import filter_audit as fa
from sievelight.llm import queries

WORDS = re.compile("[^\x20\x09-\x0d]+")


def fails(row, docs):
    doc, text = row[0], row[1] or ""
    w = WORDS.findall(text)
    out = "A" * (len(w) < 50) + "B" * (100 * len(set(w)) < 65 * len(w))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 5 * len(text)) + "D" * bool(re.search("[#$%&*|]", text))
    copied = doc is not None and any(d is not None and d < doc and (t or "") == text for d, t, _ in docs)
    return out + "E" * copied


def brute(docs, labels):
    """All rows, by removing documents filter by filter."""
    good, toxic = ({d for d, *x in labels if x[k] == 1 and d is not None} for k in range(2))
    failed = [(source or "", doc, fails((doc, text), docs)) for doc, text, source in docs]
    out = []
    for part in {p for p, _, _ in failed}:
        own = [(d, f) for p, d, f in failed if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        rows = []
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(d, f) for d, f in left if x in f]
                left = [(d, f) for d, f in left if x not in f]
                shapley[x] += len(gone)
                rows.append((
                    part, order, step, len(left), len(gone), sum(x in f for _, f in own) - len(gone), sum(f == x for _, f in own),
                    sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone), x,
                ))
        out += [(*r[:-1], shapley[r[-1]]) for r in rows]
    return sorted(out)


def audited(spark, docs, labels):
    docs = spark.createDataFrame([(*d, "clash") for d in docs], "doc_id long, text string, source string, mask string").repartition(3)
    labels = spark.createDataFrame([(*x, "clash") for x in labels], "doc_id long, quality int, toxic int, good string")
    return sorted(tuple(r) for r in fa.filter_audit(docs, labels).collect())


def test_odd_rows(spark, odd_texts):
    rng = random.Random(1)
    docs = [(d, t, rng.choice(["a", "b", None, ""])) for d, t in odd_texts]
    long = words(1, 80)
    docs += [(100 + k, rng.choice([long, long.upper(), f"{long} $", "x " * 90, words(k, 60)]), "a") for k in range(60)]
    docs += [(300, long, "b"), (300, long, "b"), (None, long, "b"), (None, long, None), (99, long, "c"), (301, " \x85 \xa0 ", "c")]
    labels = [(d, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for d, _, _ in docs if rng.random() < 0.8]
    assert audited(spark, docs, labels) == brute(docs, labels)


def test_empty_tables(spark):
    assert audited(spark, [], [(1, 1, 1)]) == []
    docs = [(1, "a", "s"), (2, "a", "s")]
    assert audited(spark, docs, []) == brute(docs, [])


def test_polynomial():
    counts = {0: 7, 1: 2, 3: 5, 7: 1, 6: 4}
    p = fa.removal_polynomial(counts)
    for ones in range(8):
        assert fa.at_corner(p, ones) == sum(n for m, n in counts.items() if m & ones)
    values = [fa.diagonal_integral(p, k) for k in range(3)]
    assert sum(values) == 12 and values[0] == fa.Fraction(29, 6)


def test_any_number_of_filters(spark):
    masks = spark.createDataFrame([("p", m, 0, 0) for m in (0, 1, 3, 3)], "part string, mask int, good int, toxic int")
    rows = {(r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.shapley) for r in fa.audit(masks, "XY").collect()}
    assert rows == {("XY", 1): (1, 3, 0, 4), ("XY", 2): (1, 0, 2, 2), ("YX", 1): (2, 2, 0, 2), ("YX", 2): (1, 1, 2, 4)}


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert sorted(tuple(r) for r in queries.op12_filter_audit(spark, sf).collect()) == brute(docs, labels)
