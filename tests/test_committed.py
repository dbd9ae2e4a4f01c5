import os

import pytest

from pointloom.sinks import committed
from pointloom.sinks.committed import CommittedTable, Conflict


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def data(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}


def test_an_upsert_of_one_key_touches_one_bucket(spark, tmp_path):
    path = str(tmp_path / "t")
    table = CommittedTable(spark, path, ["k"], 8)
    assert table.upsert(spark.range(100).selectExpr("id AS k", "0 AS v")) == 1
    before, old = data(path), table.manifest()["folders"]
    assert len(old) == 8
    assert table.upsert(spark.createDataFrame([(7, 1), (7, 2)], "k long, v int")) == 2
    after, new = data(path), table.manifest()["folders"]
    changed = [b for b in new if new[b] != old[b]]
    assert len(changed) == 1 and before.items() <= after.items() and len({f.split("/_bucket")[0] for f in set(after) - set(before)}) == 1
    assert rows(table.read().filter("v > 0")) == [(7, 1), (7, 2)] and table.read().count() == 101
    assert table.read(1).count() == 100


def test_null_keys_new_columns_deletion_and_empty_batches(spark, tmp_path):
    table = CommittedTable(spark, str(tmp_path / "t"), ["k", "j"], 4)
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.delete(spark.createDataFrame([("a", 1)], "k string, j int")) == 0
    table.upsert(spark.createDataFrame([], "k string, j int, v int"))
    assert table.read().count() == 0 and table.read().columns == ["k", "j", "v"]
    table.upsert(spark.createDataFrame([("a", 1, 1), (None, 1, 2), ("b", None, 3)], "k string, j int, v int"))
    table.upsert(spark.createDataFrame([(None, 1, 5, "x")], "k string, j int, v int, w string"))
    assert rows(table.read()) == rows(spark.createDataFrame([("a", 1, 1, None), (None, 1, 5, "x"), ("b", None, 3, None)], "k string, j int, v int, w string"))
    table.delete(spark.createDataFrame([("b", None), ("c", 1)], "k string, j int"))
    assert rows(table.read().select("k")) == rows(spark.createDataFrame([("a",), (None,)], "k string"))
    with pytest.raises(ValueError):
        CommittedTable(spark, str(tmp_path / "t"), ["k"])


def test_a_batch_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    table = CommittedTable(spark, str(tmp_path / "t"), ["k"], 2)
    table.upsert(spark.createDataFrame([(1, 1)], "k long, v int"), "w", 0)
    with monkeypatch.context() as m:
        m.setattr(committed.CommittedTable, "_publish", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            table.upsert(spark.createDataFrame([(1, 2)], "k long, v int"), "w", 1)
    assert rows(table.read()) == [(1, 1)] and table.versions() == [1]
    assert table.upsert(spark.createDataFrame([(1, 3)], "k long, v int"), "w", 1) == 2
    assert table.upsert(spark.createDataFrame([(1, 4)], "k long, v int"), "w", 1) == 2  # the same batch again
    assert rows(table.read()) == [(1, 3)]
    live = {f for v in table.versions() for f in table.manifest(v)["folders"].values()}
    assert set(os.listdir(tmp_path / "t" / "data")) == live  # what the dead batch wrote is swept


def test_of_two_writers_one_repeats(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    a, b = (CommittedTable(spark, path, ["k"], 2, kept=3) for _ in range(2))
    a.upsert(spark.createDataFrame([(1, 1)], "k long, v int"))
    seen = b.manifest()
    a.upsert(spark.createDataFrame([(2, 2)], "k long, v int"))
    with monkeypatch.context() as m:
        m.setattr(b, "manifest", lambda version=None: seen)
        with pytest.raises(Conflict):
            b.upsert(spark.createDataFrame([(3, 3)], "k long, v int"))
    b.upsert(spark.createDataFrame([(3, 3)], "k long, v int"))
    assert rows(b.read()) == [(1, 1), (2, 2), (3, 3)]
