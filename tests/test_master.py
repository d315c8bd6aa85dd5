"""The master table: partial rewrites, versions, crashes and compaction."""

import pytest

from quillspark.operators import upsert


def rows(spark, *some):
    return spark.createDataFrame(some, "email string, n int, ord int")


def table(spark, path, version=None):
    return sorted(map(tuple, upsert.read_master(spark, path, version).collect()), key=str)


def folders(spark, path):
    return upsert._folders(spark, path, upsert.current_version(spark, path))


def test_only_touched_parts_are_rewritten(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "master")
    assert upsert.current_version(spark, path) is None
    upsert.upsert_path(spark, path, rows(spark, *[(f"k{i}", i, 1) for i in range(40)]), "email", "ord", parts=8)
    _, before = folders(spark, path)
    upsert.upsert_path(spark, path, rows(spark, ("k3", 30, 1), ("k3", 31, 2), ("new", 7, 1), (None, 1, 1)), "email", "ord")
    upsert.upsert_path(spark, path, rows(spark, (None, 2, 1)), "email", "ord")
    parts, after = folders(spark, path)
    changed = {p for p in after if after[p] != before.get(p)}
    assert parts == 8 and len(changed) <= 3 and len(before) > 5
    want = {f"k{i}": i for i in range(40)} | {"k3": 31, "new": 7, None: 2}
    assert table(spark, path) == sorted(want.items(), key=str)
    assert table(spark, path, 1) == sorted(((f"k{i}", i) for i in range(40)), key=str)

    def dies(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr(upsert, "_commit", dies)
    with pytest.raises(RuntimeError):
        upsert.upsert_path(spark, path, rows(spark, ("k1", 99, 1)), "email", "ord")
    monkeypatch.undo()
    assert table(spark, path) == sorted(want.items(), key=str) and upsert.current_version(spark, path) == 3
    with pytest.raises(Exception, match="(?i)exists"):
        upsert._commit(spark, path, 3, parts, after)
    upsert.upsert_path(spark, path, rows(spark), "email", "ord")
    assert upsert.current_version(spark, path) == 3
    upsert.compact(spark, path, "email", parts=3)
    parts, now = folders(spark, path)
    assert parts == 3 and len(now) <= 3 and table(spark, path) == sorted(want.items(), key=str)
