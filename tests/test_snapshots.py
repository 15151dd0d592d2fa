"""Snapshots of a catalog: whole, older, damaged, missing, out of reach."""

import shutil

import pytest

from tonearm.sources import tables


def saved(spark, path):
    state, found = tables.load_snapshot(spark, path, "a int")
    return state, sorted(r.a for r in found.collect())


def numbers(spark, *own):
    return spark.createDataFrame([(x,) for x in own], "a int")


def broken(path, name):
    for f in (path / name.split("-")[1]).glob("part-*"):
        f.write_bytes(b"nothing")
        (f.parent / f".{f.name}.crc").unlink(missing_ok=True)


def test_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "c")
    assert saved(spark, path) == ("missing", [])
    for k in range(4):
        tables.save_snapshot(tables.load_snapshot(spark, path, "a int")[1].unionByName(numbers(spark, k)), path)
        assert saved(spark, path) == ("whole", list(range(k + 1)))
    named = tables.snapshots(spark, path)
    assert [int(n.split("-")[0]) for n in named] == [3, 4]
    assert {x.name for x in (tmp_path / "c").iterdir()} == {"manifest", *(n.split("-")[1] for n in named)}


def test_a_write_that_stops_half_way(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "c")
    tables.save_snapshot(numbers(spark, 1), path)
    with pytest.raises(Exception, match="DIVIDE_BY_ZERO|zero"):
        tables.save_snapshot(spark.range(3).selectExpr("cast(id as int) % raise_error('by zero') as a"), path)
    numbers(spark, 7).write.parquet(f"{path}/unnamed")
    assert saved(spark, path) == ("whole", [1])


def test_damaged_ones(spark, tmp_path):
    path = tmp_path / "c"
    tables.save_snapshot(numbers(spark, 1), str(path))
    tables.save_snapshot(numbers(spark, 2), str(path))
    first, last = tables.snapshots(spark, str(path))
    broken(path, last)
    assert saved(spark, str(path)) == ("older", [1])
    shutil.rmtree(path / first.split("-")[1])
    assert saved(spark, str(path)) == ("damaged", [])
    tables.save_snapshot(numbers(spark, 3), str(path))
    assert saved(spark, str(path)) == ("whole", [3])


def test_out_of_reach(spark):
    with pytest.raises(Exception):  # noqa: B017
        tables.load_snapshot(spark, "hdfs://nowhere.invalid:1/c", "a int")
