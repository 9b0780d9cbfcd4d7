"""States of a table under several writers and readers."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

import pytest

from sievelight.sources.snapshots import SnapshotTable, Taken


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_states(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    assert table.read() is None and table.versions() == []
    make = lambda *r: spark.createDataFrame(list(r), "k string, n int")
    assert table.replace(make(("a", 1), ("b", 2), (None, 3))) == 1
    assert table.append(make(("c", 4))) == 2
    held = table.read()
    assert table.upsert(make(("b", 20), (None, 30), ("d", 5)), ["k"]) == 3
    assert rows(table.read()) == rows(make(("a", 1), ("b", 20), (None, 30), ("c", 4), ("d", 5)))
    assert rows(held) == rows(table.read(2)) == rows(make(("a", 1), ("b", 2), (None, 3), ("c", 4)))
    assert table.replace(make(("z", 0))) == 4 and rows(table.read()) == [("z", 0)]
    table.clean(2)
    assert table.versions() == [3, 4] and len(rows(table.read(3))) == 5
    table.clean(1)
    assert len([p for p in (tmp_path / "t").iterdir() if p.name.startswith("part-")]) == 1


def test_a_number_is_taken_once(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    table._commit(1, ["part-a"])
    with pytest.raises(Taken):
        table._commit(1, ["part-b"])
    assert table._manifest(1) == ["part-a"]


def test_writers_at_once_lose_nothing_and_readers_see_whole_states(spark, tmp_path):
    path = str(tmp_path / "t")
    SnapshotTable(spark, path).replace(spark.range(10).selectExpr("id", "0 as by"))

    def write(k):
        table = SnapshotTable(spark, path)
        if k % 2:
            return table.append(spark.range(100 * k, 100 * k + 10).selectExpr("id", f"{k} as by"))
        return table.upsert(spark.range(k, k + 2).selectExpr("id", f"{k} as by"), ["id"])

    def look(_):
        return SnapshotTable(spark, path).read().count()

    with ThreadPoolExecutor(6) as pool:
        writes = [pool.submit(write, k) for k in range(1, 9)]
        sizes = [f.result() for f in [pool.submit(look, k) for k in range(6)]]
        versions = [f.result() for f in writes]
    assert sorted(versions) == list(range(2, 10)) and all((n - 10) % 10 == 0 for n in sizes)
    found = {r.id: r.by for r in SnapshotTable(spark, path).read().collect()}
    want = {100 * k + j: k for k in (1, 3, 5, 7) for j in range(10)}
    assert all(found[i] == by for i, by in want.items()) and len(found) == 50
    assert all(found[k] == k and found[k + 1] == k for k in (2, 4, 6, 8))


def test_updated_table_goes_back_to_any_state(spark, tmp_path):
    table = SnapshotTable(spark, str(tmp_path / "t"))
    for k in range(4):
        table.append(spark.range(k, k + 1))
    assert [table.read(v).count() for v in table.versions()] == [1, 2, 3, 4]
