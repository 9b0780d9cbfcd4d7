"""The fuzzy name join where names have much in common, and where lengths differ."""

from __future__ import annotations

import random
import threading
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from sievelight.operators import filters


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def test_names_with_common_parts_form_no_pairs(spark):
    """8000 keys that share their first letters with all of 2000 names; by pairs this takes minutes."""
    people = spark.range(2000).select(
        F.lit("").alias("firstname"), F.format_string("Supplier#%09d", F.col("id") * 7).alias("lastname")
    )
    log = spark.range(8000).select(F.format_string("Suppliers#%09d", F.col("id") * 11).alias("query"))
    without_one = lambda t: {t[:k] + t[k + 1 :] for k in range(9)}
    known = set().union(*(without_one(f"{k * 7:09d}") for k in range(2000)))
    want = {f"suppliers#{k * 11:09d}" for k in range(8000) if known & without_one(f"{k * 11:09d}")}
    assert 0 < len(want) < 8000
    stop = threading.Timer(120, spark.sparkContext.cancelAllJobs)
    stop.start()
    try:
        got = filters.person_flags(log, people).collect()
    finally:
        stop.cancel()
    assert len(got) == len(want) and {(r.key, r.match) for r in got} == {(k, "fuzzy") for k in want}


@pytest.mark.parametrize("cutoff", [88.0, 75.0, 100.0])
def test_keys_and_matches_of_all_lengths(spark, cutoff):
    rng = random.Random(5)
    letters = "ab ž𝒳"
    names = sorted({"", *("".join(rng.choice(letters) for _ in range(rng.randint(1, 34))) for _ in range(80))})
    keys = {"", "a"}
    for n in names:
        edited = list(n)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(edited) + 1)
            edited[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "q"])
        keys.add("".join(edited))
    best = {k: min((-ratio(k, n), n) for n in names) for k in keys}
    want = {k: (n, -r) for k, (r, n) in best.items() if -r >= cutoff}
    left = spark.createDataFrame([(k,) for k in sorted(keys)] + [(None,)], "key string")
    right = spark.createDataFrame([(n,) for n in names] + [(None,)], "name string")
    got = {r.key: (r.name, r.ratio) for r in filters.fuzzy_matches(left, right, "key", "name", cutoff).collect()}
    assert got == want
    found = [r.key for r in filters.fuzzy_keys(left, right, "key", "name", cutoff).collect()]
    assert sorted(found) == sorted(want)


def test_forms_are_all_and_come_once(spark):
    texts = ["abab", "aabbaa", "xxxxxxx", "abcabcabc", "a", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    lost = spark.createDataFrame(
        [(m, m - k, True) for m in sorted({len(t) for t in texts}) for k in range(4) if k <= m],
        "m int, least int, by_form boolean",
    )
    got = sorted((r.t, r.form) for r in filters._forms(df, "t", "m", lost).collect())
    want = sorted(
        {(t, "".join(c)) for t in texts for k in range(4) if k <= len(t) for c in combinations(t, len(t) - k)}
    )
    assert got == want
