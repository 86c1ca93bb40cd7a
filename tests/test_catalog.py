"""Lookups, suggestions, checks and changes on a small catalog."""

import pytest
from pyspark.sql import functions as F

from cliloom.operators import catalog as C

PAGES = [
    ("ubuntu/26.04/1/grep.1.gz", "grep", "1"), ("ubuntu/26.04/1/egrep.1.gz", "egrep", "1"), ("ubuntu/26.04/1/printf.1.gz", "printf", "1"), ("ubuntu/26.04/3/printf.3.gz", "printf", "3"),
    ("ubuntu/26.04/5/systemd.exec.5.gz", "systemd.exec", "5"), ("ubuntu/26.04/1/tar.1.gz", "tar", "1"), ("arch/latest/1/tar.1.gz", "tar", "1"), ("ubuntu/26.04/1/git.1.gz", "git", "1"),
    ("ubuntu/26.04/1/git-commit.1.gz", "git-commit", "1"), ("ubuntu/26.04/1/git-push.1.gz", "git-push", "1"), ("arch/latest/1/aonly.1.gz", "aonly", "1"), ("ubuntu/26.04/1/pg_autoctl activate.1.gz", "pg_autoctl activate", "1"),
]
MAPS = [(n, s, 10) for s, n, _ in PAGES] + [("grep", "ubuntu/26.04/1/egrep.1.gz", 1), ("git stash", "ubuntu/26.04/1/git.1.gz", 1)]


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(PAGES, "source string, name string, section string")
    return df.withColumn("distro", F.split_part("source", F.lit("/"), F.lit(1))).withColumn("release", F.split_part("source", F.lit("/"), F.lit(2))).cache()


@pytest.fixture(scope="module")
def maps(spark):
    return spark.createDataFrame(MAPS, "src string, dst string, score int").cache()


def found(spark, pages, maps, name, distro=None, release=None):
    rows = C.find_pages(spark.createDataFrame([(1, name)], "query_id int, name string"), pages, maps, distro, release).orderBy("rank").collect()
    return [r.source for r in rows if r.source], [r.error for r in rows if r.error]


def test_lookups(spark, pages, maps):
    names = ["grep", "printf", "printf.3", "printf.9", "systemd.exec", "systemd.exec.5", "ubuntu/26.04/1/tar.1.gz", "nosuchprogram", "nosuchprogram.1", "."]
    df = spark.createDataFrame(list(enumerate(names)), "query_id int, name string")
    got = {}
    for r in C.find_pages(df, pages, maps).orderBy("query_id", "rank").collect():
        got.setdefault(names[r.query_id], []).append(r.error or r.source.split("/")[-1])
    assert got == {
        "grep": ["grep.1.gz", "egrep.1.gz"], "printf": ["printf.1.gz", "printf.3.gz"], "printf.3": ["printf.3.gz", "printf.1.gz"], "printf.9": ["printf.9"], "systemd.exec": ["systemd.exec.5.gz"], "systemd.exec.5": ["systemd.exec.5.gz"],
        "ubuntu/26.04/1/tar.1.gz": ["tar.1.gz"], "nosuchprogram": ["nosuchprogram"], "nosuchprogram.1": ["nosuchprogram"], ".": ["."],
    }


def test_scope(spark, pages, maps):
    assert found(spark, pages, maps, "tar", "arch", "latest") == (["arch/latest/1/tar.1.gz"], [])
    assert found(spark, pages, maps, "aonly", "ubuntu", "26.04") == ([], ["aonly"])
    assert len(found(spark, pages, maps, "tar", "arch")[0]) == 2  # half a scope is none


def test_suggestions(spark, pages, maps):
    rows = C.suggestions(pages.where("name = 'printf'"), maps).collect()
    assert {(r.source[-11:], r.other[-11:]) for r in rows} == {("printf.1.gz", "printf.3.gz"), ("printf.3.gz", "printf.1.gz")}


def test_anchor(spark, pages, maps):
    order = C.preference(C.distro_releases(pages), "ubuntu")
    q = spark.createDataFrame([(1, 0, "aonly"), (1, 1, "tar"), (2, 0, "tar"), (2, 1, "aonly")], "query_id int, pos int, name string")
    hits = q.join(maps.select(F.col("src").alias("name"), F.col("dst").alias("source")), "name").join(pages.select("source", "distro", "release"), "source")
    rows = {(r.query_id, r.name, r.distro) for r in C.anchored(hits, order).collect()}
    assert rows == {(1, "aonly", "arch"), (1, "tar", "arch"), (2, "tar", "ubuntu")}


def test_reconcile(spark, pages, maps):
    parents = spark.createDataFrame([("git", "ubuntu", "26.04", ["commit", "push", "stash"])], "name string, distro string, release string, subcommands array<string>")
    out = {(r.src, r.dst.split("/")[-1], r.score) for r in C.reconcile_subcommands(pages, maps, parents).where("src like '% %'").collect()}
    assert out == {("git commit", "git-commit.1.gz", 1), ("git push", "git-push.1.gz", 1), ("pg_autoctl activate", "pg_autoctl activate.1.gz", 10)}


def test_checks(spark, pages, maps):
    parents = spark.createDataFrame([("git", "ubuntu", "26.04", ["commit"])], "name string, distro string, release string, subcommands array<string>")
    bad_pages = pages.unionByName(pages.where("name = 'tar'").withColumn("source", F.concat(F.lit("9/"), "source")))
    bad_maps = maps.unionByName(spark.createDataFrame([("x", "gone", 1), ("hg log", "ubuntu/26.04/1/tar.1.gz", 1)], "src string, dst string, score int"))
    opts = spark.createDataFrame([("s", ["-a"], [], "FILE"), ("s", [], [], "FILE")], "source string, short array<string>, long array<string>, positional string")
    issues = C.check_all(bad_pages, bad_maps, parents, opts)
    counts = {r.code: r["count"] for r in issues.groupBy("code").count().collect()}
    assert counts == {"malformed_source": 2, "shadowed": 2, "orphan": 1, "parent_missing": 1, "not_declared": 1, "unreachable": 2, "positional_flag": 1}
    assert C.has_errors(issues)
    assert not C.has_errors(issues.where("severity = 'warning'"))


def test_changes(spark, pages, maps):
    new = pages.where("name = 'tar'").withColumn("source", F.concat("source", F.lit("x")))
    assert C.duplicates_on_insert(pages, new).count() == 2
    assert C.duplicates_on_insert(pages, new.withColumn("section", F.lit("2"))).count() == 0
    p, _, m = C.delete_pages(pages.where("name = 'grep'"), pages, pages, maps)
    assert p.count() == len(PAGES) - 1
    assert m.where("src = 'grep'").count() == 1
    with pytest.raises(ValueError):
        C.add_mappings(maps, maps.limit(1))
    up = C.upgrade_aliases(maps, spark.createDataFrame([("grep", "ubuntu/26.04/1/egrep.1.gz"), ("new", "ubuntu/26.04/1/tar.1.gz")], "src string, dst string"))
    assert {(r.src, r.score) for r in up.where("src in ('grep', 'new')").collect()} == {("grep", 10), ("new", 10)}
    page = spark.createDataFrame([("ubuntu/26.04/1/egrep.1.gz",)], "source string")
    assert [r.src for r in C.lost_on_reimport(maps, page, spark.createDataFrame([("egrep", "ubuntu/26.04/1/egrep.1.gz")], "src string, dst string")).collect()] == ["grep"]


def test_prefix_reaches_the_scan(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/p")
    plan = C.with_prefix(spark.read.parquet(f"{tmp_path}/p"), "source", "ubuntu/").select("source")._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(source,ubuntu/)" in plan
    assert "ReadSchema: struct<source:string>" in plan
