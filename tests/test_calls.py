"""Calls at a time, those that fail or hang, and the log that outlives a task."""

from __future__ import annotations

import os
import threading
import time
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pytest

from sievelight.sources import calls, providers


def test_calls_in_flight_are_bounded_and_results_come_as_they_end():
    lock, now, most = threading.Lock(), 0, 0

    def call(k):
        nonlocal now, most
        with lock:
            now += 1
            most = max(most, now)
        time.sleep(0.2 if k == 0 else 0.01)
        with lock:
            now -= 1
        return k * 10

    taken = []

    def jobs():
        for k in range(40):
            taken.append(k)
            yield k, lambda k=k: call(k)

    found = calls.as_completed(jobs(), in_flight=4)
    first = next(found)
    assert first[0] != 0 and len(taken) <= 6  # jobs are taken as there is room
    rest = [first, *found]
    assert sorted((k, r) for k, r, _ in rest) == [(k, k * 10) for k in range(40)] and 1 < most <= 4
    assert [k for k, *_ in rest].index(0) > 3


def test_failing_calls_are_made_again_while_others_go_on():
    tries = Counter()

    def call(k):
        tries[k] += 1
        if k == 1 and tries[k] < 3 or k == 2:
            raise RuntimeError(f"no {k}")
        return k

    found = {k: (r, str(e) if e else None) for k, r, e in calls.as_completed(iter([(k, lambda k=k: call(k)) for k in range(6)]), 2, 3, wait=0.05)}
    assert found[2] == (None, "no 2") and all(found[k] == (k, None) for k in (0, 1, 3, 4, 5))
    assert tries == Counter({0: 1, 1: 3, 2: 3, 3: 1, 4: 1, 5: 1})
    assert list(calls.as_completed(iter([]))) == []


def test_a_server_that_is_gone_does_not_fill_the_worker():
    stop = threading.Event()
    before = threading.active_count()
    began = time.monotonic()
    found = list(calls.as_completed(iter([(k, stop.wait) for k in range(200)]), 3, 1, seconds=0.05))
    kinds = Counter(type(e) for *_, e in found)
    assert len(found) == 200 and kinds[TimeoutError] <= 9 and kinds[calls.TooManyHang] >= 191
    assert threading.active_count() - before <= 9 and time.monotonic() - began < 5
    stop.set()


def counted(folder, dies=None):
    """A model that notes each call in a folder, and whose worker dies at the call that finds ``dies`` others."""

    def answer(prompt):
        if dies is not None and len(os.listdir(folder)) >= dies:
            os._exit(1)
        Path(folder, f"{prompt}-{time.monotonic_ns()}").touch()
        return f'{{"grade": {int(prompt) % 3}, "confidence": 1}}', 1, 2

    return answer


def test_a_lost_task_loses_at_most_what_is_not_logged(spark, tmp_path):
    log, first, second = (tmp_path / n for n in ("log", "first", "second"))
    first.mkdir()
    second.mkdir()
    prompts = spark.range(200).selectExpr("id", "cast(id % 150 as string) as prompt")
    ask = lambda model, **options: providers.call_model(
        prompts, model, "m", "axis_judge", "id", concurrency=1, in_flight=4, log=str(log), log_every=10, **options
    )
    with pytest.raises(Exception):
        ask(counted(first, dies=93)).collect()
    made = len(os.listdir(first))
    assert made >= 93
    held = providers.logged(spark, str(log))
    kept = held.count()
    assert kept % 10 == 0 and kept >= made - 10 - 2 * 4
    rows = ask(counted(second)).collect()
    assert len(rows) == 200 and all(r.error is None and f'"grade": {int(r.id) % 150 % 3}' in r.response for r in rows)
    assert len(os.listdir(second)) == 150 - kept and sum(r.cached for r in rows) >= kept
    third = tmp_path / "third"
    third.mkdir()
    assert ask(counted(third)).filter("cached").count() == 200 and not os.listdir(third)


def test_a_task_goes_on_with_what_the_one_before_it_logged(tmp_path):
    schema = pa.schema(providers._LOGGED)
    one = calls.Log(f"file://{tmp_path}", "r", 3, schema, every=2)
    for k in range(5):
        one.add({"cache_key": str(k), "response": None if k == 1 else "x", "prompt_tokens": k, "completion_tokens": 0})
    other = calls.Log(str(tmp_path), "r", 3, schema)
    assert sorted(r["cache_key"] for r in other.held()) == ["0", "1", "2", "3"]  # the fifth wasn't written
    one.write()
    assert len(list(other.held())) == 5 and not list(calls.Log(str(tmp_path), "r", 4, schema).held())
    (tmp_path / "run=r" / "part=3" / "_half.parquet").write_bytes(b"PAR1")
    assert len(list(other.held())) == 5


def test_no_log_yet(spark, tmp_path):
    assert providers.logged(spark, str(tmp_path)) is None and providers.logged(spark, str(tmp_path / "none")) is None


def test_embedding_batches_at_a_time(spark):
    class Odd(providers.HashedEmbedder):
        def embed(self, texts):
            if any("bad" in t for t in texts):
                raise ValueError("bad text")
            return super().embed(texts)

    texts = spark.range(60).selectExpr("id as text_id", "if(id = 17, 'bad', concat('t', id)) as text").coalesce(1)
    got = {r.text_id: r for r in providers.embed(texts, Odd(8), batch=10, attempts=1, in_flight=3).collect()}
    assert len(got) == 60 and got[17].embedding is None and got[17].error == "bad text"
    assert all(r.error is None and len(r.embedding) == 8 for k, r in got.items() if k != 17)
