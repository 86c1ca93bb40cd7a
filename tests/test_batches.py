"""Batch jobs: stages that are repeated or end early, partial replies, retries and cancelling."""

import pytest
from pyspark.sql import functions as F

from cliloom.operators.batches import BatchJob, FolderService


def answer(custom_id, body):
    """Bodies say what happens to them."""
    return {"status": F.when(body == "busy", 503).otherwise(200), "body": F.when(body == "busy", None).otherwise(F.upper(body)), "message": F.when(body == "error", "no"), "present": body != "lost"}


@pytest.fixture
def wanted(spark):
    bodies = ["a", "b", "lost", "busy", "c", "d", "e", "f"]
    return spark.createDataFrame([(f"i{k // 2}", k % 2, b) for k, b in enumerate(bodies)], "item string, chunk int, body string")


def states(job):
    return {r["custom_id"]: (r["state"], r["reply"], r["error"]) for r in job.requests().collect()}


def test_stages(spark, tmp_path, wanted):
    service = FolderService(spark, str(tmp_path / "inbox"), answer)
    job = BatchJob(spark, str(tmp_path / "job"), service, size=3)
    assert job.prepare(wanted) == 8 and job.prepare(wanted) == 0
    assert 2 <= job.batches().count() <= 3
    n = job.submit()
    assert n == job.batches().count() and job.submit() == 0
    assert job.collect() == {"running": n, "done": 0, "failed": 0}
    service.serve()
    assert job.collect() == {"running": 0, "done": n, "failed": 0} and job.collect() == {"running": 0, "done": 0, "failed": 0}
    got = states(job)
    assert got["i0:0"] == ("done", "A", None) and got["i1:0"] == ("failed", None, "missing") and got["i1:1"] == ("failed", None, "status 503")
    assert {r["item"]: (r["outcome"], r["chunks"], r["done"]) for r in job.outcomes().collect()} == {"i0": ("success", 2, 2), "i1": ("failed", 2, 0), "i2": ("success", 2, 2), "i3": ("success", 2, 2)}
    service.answer = lambda i, b: answer(i, F.lit("late"))
    assert job.retry(tries=2) == 2
    job.submit()
    service.serve()
    job.collect()
    assert states(job)["i1:0"] == ("done", "LATE", None) and job.retry() == 0
    # another job on the same folder goes on from there
    again = BatchJob(spark, str(tmp_path / "job"), service)
    assert again.prepare(wanted) == 0 and states(again)["i0:0"] == ("done", "A", None)


def test_a_stage_that_ends_early_is_repeated(spark, tmp_path, wanted):
    service = FolderService(spark, str(tmp_path / "inbox"), answer)
    job = BatchJob(spark, str(tmp_path / "job"), service, size=2)
    job.prepare(wanted)
    take, calls = service.submit, []

    def once(name, folder):
        calls.append(name)
        if len(calls) == 2:
            raise ConnectionError("lost")
        return take(name, folder)

    service.submit = once
    with pytest.raises(ConnectionError):
        job.submit()
    assert {s for s, *_ in states(job).values()} == {"planned"}
    service.submit = take
    job.submit()
    assert len(service.handed) == job.batches().count()  # none twice
    service.serve()
    known = dict(service.__dict__)
    service.poll = lambda remote: (_ for _ in ()).throw(ConnectionError("lost"))
    with pytest.raises(ConnectionError):
        job.collect()
    del service.__dict__["poll"]
    assert known and job.collect()["done"] == job.batches().count()


def test_a_failed_batch_fails_only_what_has_no_reply(spark, tmp_path):
    rows = spark.createDataFrame([("x", k, "lost" if k % 2 else f"b{k}") for k in range(6)], "item string, chunk int, body string")
    service = FolderService(spark, str(tmp_path / "inbox"), answer, failing=lambda name: True)
    job = BatchJob(spark, str(tmp_path / "job"), service)
    job.prepare(rows)
    job.submit()
    service.serve()
    assert job.collect() == {"running": 0, "done": 0, "failed": 1}
    assert {k: v[0] + str(v[2]) for k, v in states(job).items()} == {f"x:{k}": "failedbatch failed" if k % 2 else "doneNone" for k in range(6)}


def test_cancelling_keeps_what_has_ended(spark, tmp_path, wanted):
    service = FolderService(spark, str(tmp_path / "inbox"), answer)
    job = BatchJob(spark, str(tmp_path / "job"), service, size=1)
    job.prepare(wanted.where("body not in ('lost', 'busy')"))
    job.submit()
    first = sorted(service.handed)[0]
    service.serve([first])
    ended = {r["custom_id"] for r in job.requests().where(F.col("batch") == first).collect()}
    assert job.cancel() == 6 - len(ended)
    assert {k for k, v in states(job).items() if v[0] == "done"} == ended
    assert {v[2] for v in states(job).values() if v[0] == "failed"} == {"cancelled"}
    assert len(service.cancelled) == len(service.handed) - 1 and job.cancel() == 0
