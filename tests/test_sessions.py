"""Sessions as a stream against a plain loop: joining, expiry, late rows, and state that shrinks."""

from datetime import UTC, datetime, timedelta

from hypothesis import given
from hypothesis import strategies as st

from cliloom.streaming import sessions as N

START = datetime(2024, 1, 1, tzinfo=UTC)


@given(st.lists(st.tuples(st.integers(0, 200), st.integers(0, 3)), max_size=30))
def test_joining_doesnt_depend_on_the_order(rows):
    spans = [(a, a + n, 1) for a, n in rows]
    whole, step = N.joined(spans, 10), []
    for s in spans:
        step = N.joined([*step, s], 10)
    assert step == whole and sum(s[2] for s in whole) == len(rows)
    assert all(b[0] - a[1] >= 10 for a, b in zip(whole, whole[1:], strict=False))


def run(spark, tmp_path, batches, **more):
    """One file and one trigger for each batch of (minute, ip); the rows, and the state's size after each."""
    N.with_state(spark)
    out, folder = [], tmp_path / "in"
    folder.mkdir()
    stream = spark.readStream.schema("ts timestamp, ip string").parquet(str(folder))
    query = N.sessions(stream, **more).writeStream.foreachBatch(lambda df, n: out.extend(df.collect())).option("checkpointLocation", str(tmp_path / "state")).outputMode("append")
    sizes = []
    for i, rows in enumerate(batches):
        spark.createDataFrame([(START + timedelta(minutes=m), ip) for m, ip in rows], "ts timestamp, ip string").coalesce(1).write.parquet(str(tmp_path / f"w{i}"))
        for f in (tmp_path / f"w{i}").glob("part-*"):
            f.rename(folder / f"{i}.parquet")
        q = query.trigger(availableNow=True).start()
        q.awaitTermination()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    at = lambda x: round((x.replace(tzinfo=UTC) - START).total_seconds() / 60)
    return sorted((r["kind"], r["ip"], at(r["start"]), at(r["end"]), r["hits"]) for r in out), sizes


def test_sessions_close_and_late_rows_are_told(spark, tmp_path):
    batches = [[(0, "a"), (5, "a"), (3, "b"), (30, "a")], [(12, "a"), (100, "b")], [(20, "a"), (101, "b"), (140, "c")], [(300, "d")]]
    rows, sizes = run(spark, tmp_path, batches)
    assert rows == sorted([("session", "a", 0, 12, 3), ("session", "a", 30, 30, 1), ("session", "b", 3, 3, 1), ("late", "a", 20, 20, 1), ("session", "b", 100, 101, 2), ("session", "c", 140, 140, 1)])
    assert max(sizes) > sizes[-1] > 0
