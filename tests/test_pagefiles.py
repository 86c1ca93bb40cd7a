"""Page files: equal bytes, one commit, nothing of what fails."""

import gzip
import os
import time

import pytest
from pyspark.sql import functions as F

from cliloom.sources import pagefiles as P

ROWS = [("ubuntu/26.04/1/tar.1.gz", "tar text\nü", ["gtar", "tar"]), ("arch/latest/1/a b+c%.1", "", None), ("d/e/1/long.1.gz", "x\n" * 100_000, []), ("d/e/1/alias-only.1.gz", None, ["other"])]


def tree(path):
    """Contents by place, without the attempts' names."""
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            parts = os.path.relpath(os.path.join(folder, n), path).split("/")
            with open(os.path.join(folder, n), "rb") as f:
                out["/".join([parts[0], *parts[2 if len(parts) > 2 else 1 :]])] = f.read()
    return out


def visible(path):
    return {k: v for k, v in tree(path).items() if not k.startswith("_")}


def write(spark, rows, path, parts=3):
    P.register(spark)
    df = rows if hasattr(rows, "write") else spark.createDataFrame(rows, P.SCHEMA)
    df.repartition(parts).write.format("cliloom_pages").mode("append").save(path)


def test_two_runs_give_equal_bytes(spark, tmp_path):
    a, b = str(tmp_path / "a"), str(tmp_path / "b")
    write(spark, ROWS, a)
    write(spark, ROWS, a)  # there already
    write(spark, ROWS[::-1], b, parts=1)
    assert tree(a) == tree(b) and len(os.listdir(a)) == 1 and len(tree(a)) == 4
    assert [gzip.decompress(v).decode() for k, v in tree(a).items() if k.endswith("tar.1.gz")] == ["tar text\nü"]
    rows = {r["source"]: (r["text"], r["length"]) for r in P.read_pages(spark, a).collect()}
    assert rows == {"ubuntu/26.04/1/tar.1": ("tar text\nü", 10), "d/e/1/long.1": ("x\n" * 100_000, 200_000), "arch/latest/1/a b+c%.1": ("", 0)}
    assert {tuple(r) for r in P.read_aliases(spark, a).collect()} == {("gtar", "ubuntu/26.04/1/tar.1"), ("tar", "ubuntu/26.04/1/tar.1"), ("other", "d/e/1/alias-only.1")}
    write(spark, [("z/z/1/more.1.gz", "more", None)], a)
    assert P.read_pages(spark, a).where("source = 'z/z/1/more.1'").count() == 1 and len(os.listdir(a)) == 2


@pytest.mark.parametrize("bad", [[("../out", "x", None)], [("a", "x", None), ("a.gz", "y", None)], [("a//b", "x", None)]])
def test_what_fails_leaves_nothing(spark, tmp_path, bad):
    path = str(tmp_path / "p")
    write(spark, ROWS, path)
    before = tree(path)
    with pytest.raises(Exception, match="file's name|twice"):
        write(spark, [*ROWS[:1], *bad], path, parts=2)
    assert visible(path) == before
    rows = spark.createDataFrame([(f"p/{i}", f"text {i}", None) for i in range(20)], P.SCHEMA)
    broken = rows.repartition(4).withColumn("text", F.when(F.col("source") == "p/17", F.raise_error(F.lit("lost")).cast("string")).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        broken.write.format("cliloom_pages").mode("append").save(path)
    assert visible(path) == before
    time.sleep(1)  # for tasks that are at work yet
    P.vacuum(path, 0)
    assert tree(path) == before and len(os.listdir(path)) == 1 and P.vacuum(path, 0) == []


def test_other_schemas_and_overwriting(spark, tmp_path):
    P.register(spark)
    for df, mode in ((spark.range(1), "append"), (spark.createDataFrame(ROWS, P.SCHEMA), "overwrite")):
        with pytest.raises(Exception, match="pages are|only added"):
            df.write.format("cliloom_pages").mode(mode).save(str(tmp_path / "x"))
    write(spark, spark.createDataFrame([], P.SCHEMA), str(tmp_path / "none"))
    assert not os.path.exists(tmp_path / "none") or not os.listdir(tmp_path / "none")
