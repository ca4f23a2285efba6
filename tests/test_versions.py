"""Versions of keyed tables: snapshots, failed writes, two writers."""

import pytest
from pyspark.sql import functions as F

from quillspar.sources import versions

TABLES = {"pages": versions.Table("page_id long, title string", ("page_id",), ("page_id",))}


@pytest.fixture
def store(spark, tmp_path):
    return versions.Store(spark, str(tmp_path / "store"), TABLES, 4)


def rows(store, at=None):
    return sorted(map(tuple, store.read("pages", at or store.snapshot()).collect()))


def frame(spark, *pairs):
    return spark.createDataFrame(list(pairs), "page_id long, title string")


def test_upserts_replace_by_key_and_old_versions_stay(spark, store):
    assert store.snapshot().version == 0 and rows(store) == []
    first = versions.upsert(store, "pages", frame(spark, (1, "a"), (2, "b"), (None, "n")))
    second = versions.upsert(store, "pages", frame(spark, (2, "c"), (3, "d"), (3, "e")))
    third = versions.upsert(store, "pages", frame(spark, (None, "m")))
    held = [sorted(((r.page_id, r.title) for r in store.read("pages", at).collect()), key=str) for at in (first, second, third)]
    assert held == [[(1, "a"), (2, "b"), (None, "n")], [(1, "a"), (2, "c"), (3, "d"), (None, "n")], [(1, "a"), (2, "c"), (3, "d"), (None, "m")]]
    assert store.versions() == [1, 2, 3] and store.snapshot(1).folders == first.folders


def test_only_touched_buckets_are_written(spark, store):
    versions.upsert(store, "pages", spark.range(100).select(F.col("id").alias("page_id"), F.lit("x").alias("title")))
    before = store.snapshot().folders["pages"]
    after = versions.upsert(store, "pages", frame(spark, (5, "y"))).folders["pages"]
    assert sum(before[b] != after[b] for b in before) == 1 and len(rows(store)) == 100


def test_a_failed_write_leaves_the_old_version(spark, store):
    versions.upsert(store, "pages", frame(spark, (1, "a")))
    broken = frame(spark, (1, "b")).withColumn("title", F.raise_error(F.lit("no")).cast("string"))
    with pytest.raises(Exception, match="no"):
        versions.upsert(store, "pages", broken)
    assert store.versions() == [1] and rows(store) == [(1, "a")]


def test_of_two_writers_one_wins(spark, store):
    base = store.snapshot()
    store.commit(base, {"pages": versions.Change(rows=frame(spark, (1, "a")))})
    with pytest.raises(versions.Conflict):
        store.commit(base, {"pages": versions.Change(rows=frame(spark, (1, "b")))})
    assert rows(store) == [(1, "a")] and store.versions() == [1]
    versions.upsert(store, "pages", frame(spark, (1, "b")))
    assert rows(store) == [(1, "b")]


def test_rows_go_and_versions_are_trimmed(spark, store):
    versions.upsert(store, "pages", frame(spark, (1, "a"), (2, "b")))
    store.commit(store.snapshot(), {"pages": versions.Change(gone=frame(spark, (1, "x")).select("page_id"))})
    store.commit(store.snapshot(), {"pages": versions.Change(gone=frame(spark, (2, "x")).select("page_id"))})
    assert rows(store) == [] and rows(store, store.snapshot(2)) == [(2, "b")]
    versions.upsert(store, "pages", frame(spark, (7, "z")))
    store.trim(1)
    assert store.versions() == [4] and rows(store) == [(7, "z")]
