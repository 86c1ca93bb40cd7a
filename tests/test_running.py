"""Extractions that are cancelled and taken up again, and layouts of mappings."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from cliloom.operators import extract as X
from cliloom.operators import layout as Y
from cliloom.operators import running as R


def pages(spark, n=24):
    text = "# NAME\ntool - x\n# SYNOPSIS\ntool command\n# OPTIONS\n-a, --all everything&nbsp;here\n-b other"
    return spark.createDataFrame([(f"d/r/1/p{i}.1.gz", text) for i in range(n)], "source string, text string")


def test_a_cancelled_run_keeps_its_finished_parts(spark, tmp_path, monkeypatch):
    df, path, registry = pages(spark), str(tmp_path / "run"), R.Registry()
    real, reached = X.ask, threading.Event()

    def slow(chunks, model):
        if registry.running()[0].done == 2:
            reached.set()
            wait = F.udf(lambda x: time.sleep(60) or x, "string")
            chunks = chunks.withColumn("text", wait("text"))
        return real(chunks, model)

    monkeypatch.setattr(X, "ask", slow)
    ended = []

    def work():
        try:
            R.run_extraction(df, "reader", path, "one", parts=4, registry=registry)
        except R.Interrupted as e:
            ended.append(e)

    t = threading.Thread(target=work)
    t.start()
    assert reached.wait(120)
    with pytest.raises(ValueError, match="running"):
        R.run_extraction(df, "reader", path, "one", parts=4, registry=registry)
    time.sleep(2)  # a job is at work by then
    assert [r.tag for r in registry.running()] == ["one"] and registry.cancel(spark) == ["one"]
    t.join(60)
    assert not t.is_alive() and len(ended) == 1 and registry.running() == [] and registry.cancel(spark) == []
    assert R.missing_parts(spark, path, 4) == [2, 3]
    monkeypatch.setattr(X, "ask", real)
    before = R.extracted(spark, path)[0].count()
    assert 0 < before < 24
    assert R.run_extraction(df, "reader", path, "two", parts=4, registry=registry) == 2
    outcomes, options = R.extracted(spark, path)
    whole, all_options = X.extract(df, "reader")
    assert sorted(map(str, outcomes.collect())) == sorted(map(str, whole.collect())) and options.count() == all_options.count() == 48
    assert R.run_extraction(df, "reader", path, "three", parts=4, registry=registry) == 0


def test_whole_pages_are_prepared_and_assembled(spark):
    outcomes, options = X.extract(pages(spark, 1), "reader")
    assert outcomes.first()["nested"] and {r["text"] for r in options.collect()} == {"-a, --all everything here", "-b other"}
    reply = '{"options": [], "subcommands": ["p0-add", "rm"]}'
    replies = spark.createDataFrame([("d/r/1/p0.1.gz", k, 2, reply.replace("rm", f"rm{k}"), 1, None) for k in (1, 0)], X._REPLY)
    assert X.assemble(replies, pages(spark, 1))[0].first()["subcommands"] == ["add", "rm0", "rm1"]


def test_layouts_give_the_same_rows_and_read_less(spark, tmp_path):
    maps = spark.range(200_000).select(F.concat(F.lit("n"), F.lpad((F.col("id") * 7919 % 100_000).cast("string"), 6, "0")).alias("src"), F.concat(F.lit("d/"), F.col("id") % 50_000).alias("dst"), F.lit(10).alias("score"))
    maps.repartition(4).write.parquet(str(tmp_path / "plain"))
    plain = spark.read.parquet(str(tmp_path / "plain"))
    laid = Y.laid_out(plain, str(tmp_path / "laid"), files=4, group=200_000)
    shapes = Y.lookups("n000017", ["n000017", "n099999", "none"], "n00001", "d/77")
    for shape in shapes.values():
        assert sorted(map(tuple, plain.where(shape).collect())) == sorted(map(tuple, laid.where(shape).collect()))
    got = {(r["shape"], r["layout"]): r for r in Y.compare_layouts(plain, laid, shapes, times=2).collect()}
    assert got["point", "plain"]["n"] == got["point", "laid_out"]["n"] == 2 and got["by_page", "plain"]["n"] == 4
    for shape in ("point", "in_list", "prefix"):
        assert got[shape, "laid_out"]["rows"] < got[shape, "plain"]["rows"] / 2
    speed = {r["shape"]: r for r in Y.speedups(spark.createDataFrame(list(got.values()))).collect()}
    assert set(speed) == set(shapes) and all(r["speedup"] > 0 for r in speed.values())
    one, many = Y.single_and_shared(maps.unionByName(spark.createDataFrame([("lone", "x", 1)], "src string, dst string, score int")), 5)
    assert [r["src"] for r in one.collect()] == ["lone"] and many.count() == 5
    assert plain.where(Y.in_list("src", [])).count() == 0
