"""Places among equal contents against SQL, with one content in most rows and in several ranges."""

import duckdb
import pytest

from cliloom.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("coalesce", ["true", "false"])
def test_places_of_copies(spark, tmp_path, coalesce):
    rows = [(i * 37 % 1009, "hot" if i % 3 else f"text {i % 50}") for i in range(600)] + [(5, "twice"), (5, "twice"), (None, "hot"), (None, "lone"), (3, None), (1, None), (2000, ""), (1999, "")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", coalesce)
    try:
        got = QUERIES["win_first_canonical"](spark, str(tmp_path))
        got = [tuple(r) for r in got.select("doc_id", "canonical", "place", "is_first").collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(f"SELECT doc_id, canonical, place, is_first FROM ({ORACLES['win_first_canonical']})").fetchall()
    assert sorted(got, key=str) == sorted(want, key=str)
    hot = next(r[1] for r in got if r[0] == 37)
    assert sorted(r[2] for r in got if r[1] == hot) == list(range(1, 402))
