"""Commits of several tables: whole or not at all, first come first served, and pinned readers."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from cliloom.sources.snapshots import Conflict, ReadOnly, Snapshots
from cliloom.store import PARSED, RAW, Catalog

from .test_store import parsed_row, raw_row


def n(spark, k):
    return spark.range(k)


def test_a_commit_is_one_change_of_all_tables(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    with pytest.raises(FileNotFoundError):
        store.newest()
    one = store.commit({"a": n(spark, 1), "b": n(spark, 2)})
    two = store.commit({"a": n(spark, 10)}, one)
    assert store.versions() == [0, 1]
    assert [two.read(t).count() for t in "ab"] == [10, 2]
    assert [store.at(0).read(t).count() for t in "ab"] == [1, 2]
    assert two.folders["b"] == one.folders["b"]  # what doesn't change isn't written again
    with pytest.raises(KeyError):
        two.read("c")


def test_a_write_that_fails_half_way_changes_nothing(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    one = store.commit({"a": n(spark, 1), "b": n(spark, 2)})
    broken = spark.range(4).select(F.raise_error(F.lit("lost")).cast("long").alias("id"))
    with pytest.raises(PySparkException):
        store.commit({"a": n(spark, 10), "b": broken}, one)  # `a` is written, `b` isn't
    assert store.versions() == [0] and [store.newest().read(t).count() for t in "ab"] == [1, 2]
    assert len(store.vacuum(older_than=0)) >= 1 and store.newest().read("a").count() == 1
    assert store.commit({"a": n(spark, 3)}, one).version == 1


def test_of_two_writers_the_second_is_refused(spark, tmp_path):
    store, other = (Snapshots(spark, str(tmp_path / "s")) for _ in range(2))
    one = store.commit({"a": n(spark, 1)})
    with pytest.raises(Conflict):
        store.commit({"a": n(spark, 9)})  # there is a store already
    other.commit({"a": n(spark, 2)}, one)
    with pytest.raises(Conflict):
        store.commit({"a": n(spark, 3)}, one)
    assert store.newest().read("a").count() == 2
    # Both past the first look: the rename decides.
    store.versions = lambda: [1]
    with pytest.raises(Conflict):
        store._put(1, "{}")
    assert other.newest().read("a").count() == 2 and not [p for p in (tmp_path / "s" / "snapshots").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_reading_only_and_vacuum(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"))
    now = store.commit({"a": n(spark, 1), "b": n(spark, 1)})
    for k in range(2, 5):
        now = store.commit({"a": n(spark, k)}, now)
    reader = Snapshots(spark, str(tmp_path / "s"), read_only=True)
    for change in (lambda: reader.commit({"a": n(spark, 1)}, now), reader.vacuum):
        with pytest.raises(ReadOnly):
            change()
    assert store.vacuum() == []  # all are young
    assert len(store.vacuum(keep=2, older_than=0)) == 2
    assert store.versions() == [2, 3] and [store.at(v).read("a").count() for v in (2, 3)] == [3, 4] and store.newest().read("b").count() == 1


def test_a_pinned_catalog_stays_as_it_was(spark, tmp_path, monkeypatch):
    c = Catalog(spark, str(tmp_path / "c")).create()
    rows = [parsed_row(f"arch/latest/1/p{i}.1.gz", f"p{i}") for i in range(3)]
    c.add_pages(spark.createDataFrame([raw_row(r[0]) for r in rows], RAW), spark.createDataFrame(rows, PARSED))
    old = c.pinned()
    c.delete(spark.createDataFrame([(rows[0][0],)], "source string"))
    assert (old.parsed.count(), c.parsed.count(), c.mappings.count(), old.mappings.count()) == (3, 2, 2, 3)
    with pytest.raises(ReadOnly):
        old.reconcile()
    with pytest.raises(ReadOnly):
        Catalog(spark, c.path, read_only=True).log_event("x", {})
    assert Catalog(spark, c.path, version=1).parsed.count() == 3
    # Two catalogs begin at one snapshot.
    late = Catalog(spark, c.path)
    begun = late._now()
    c.reconcile()
    monkeypatch.setattr(late, "_now", lambda: begun)
    with pytest.raises(Conflict):
        late.delete(spark.createDataFrame([(rows[1][0],)], "source string"))
    assert c.parsed.count() == 2
    pairs = spark.createDataFrame([("p-alias", rows[1][0]), ("lost", "arch/latest/1/none.1.gz")], "src string, dst string")
    assert c.map_extracted(pairs) == 3
    c.drop_all(confirm=True)
    assert c.parsed.isEmpty() and c.mappings.isEmpty() and old.parsed.count() == 3
