"""The catalog in a folder and its command line."""

import pytest
from pyspark.sql import functions as F

from cliloom.__main__ import main
from cliloom.operators import metadata as M
from cliloom.store import PARSED, RAW, Catalog, Duplicate


def raw_row(source):
    return (source, "text of " + source, None, "markdown-3", None, "h" + source)


def option(text, *flags, positional=None, has_arg=False):
    return (text, [f for f in flags if not f.startswith("--")], [f for f in flags if f.startswith("--")], has_arg, [], positional, None, False, [])


def parsed_row(source, name, section="1", options=(), subcommands=(), aliases=None):
    return (source, name, section, f"about {name}", aliases or [(name, 10)], False, list(subcommands), False, [], list(options), "llm", "m", False)


@pytest.fixture
def store(spark, tmp_path):
    c = Catalog(spark, str(tmp_path / "c")).create()
    rows = [parsed_row("ubuntu/26.04/1/git.1.gz", "git", subcommands=["commit"]), parsed_row("ubuntu/26.04/1/git-commit.1.gz", "git-commit", options=[option("all of it", "-a", "--all"), option("files", positional="FILE")]), parsed_row("arch/latest/1/aonly.1.gz", "aonly"), parsed_row("arch/latest/1/git.1.gz", "git", aliases=[("git", 10), ("alias", 1)])]
    c.add_pages(spark.createDataFrame([raw_row(r[0]) for r in rows], RAW), spark.createDataFrame(rows, PARSED))
    return c


def test_catalog(spark, store):
    assert store.reconcile() == 1
    assert {(r.src, r.score) for r in store.mappings.where("dst = 'ubuntu/26.04/1/git-commit.1.gz'").collect()} == {("git-commit", 10), ("git commit", 1)}
    won, others = store.page("git", "ubuntu", "26.04")
    assert won.first().source == "ubuntu/26.04/1/git.1.gz"
    spans = store.explain_preferring(spark.createDataFrame([(1, "git commit -a x | aonly"), (2, "aonly; git"), (3, "nothing here")], "query_id long, cmd string"))
    got = {(r.query_id, r.match): (r.kind, r.source) for r in spans.where("group_no > 0 or error is not null").collect()}
    assert got[1, "git commit"] == ("synopsis", "ubuntu/26.04/1/git-commit.1.gz")
    assert got[1, "-a"][0] == "option"
    assert got[1, "aonly"][0] == "unknown"  # the line is ubuntu's by then
    assert got[2, "git"] == ("synopsis", "arch/latest/1/git.1.gz")
    assert spans.where("query_id = 3").first().error == "unknown: nothing"
    lines = [(7, "git commit -a"), (8, "git commit -a"), (9, None), (10, ""), (11, "aonly; git"), (12, "git commit -a")]
    each = store.explain_preferring(spark.createDataFrame(lines, "query_id int, cmd string")).collect()
    of = lambda q: sorted(tuple(r)[1:] for r in each if r.query_id == q)
    assert of(7) == of(8) == of(12) and len(of(7)) == 2 and {r.query_id for r in each} == {7, 8, 11, 12}
    assert {r.source for r in each if r.query_id == 11 and r.source} == {"arch/latest/1/aonly.1.gz", "arch/latest/1/git.1.gz"}
    assert [tuple(r) for r in store.distros().collect()] == [("arch", "latest"), ("ubuntu", "26.04")]
    assert store.default_distro().first().distro == "ubuntu"
    assert {r.what: r.n for r in store.stats().collect()} == {"manpages": 4, "mappings": 6, "raw": 4, "arch/latest/": 2, "ubuntu/26.04/": 2}
    assert store.check().count() == 0
    assert store.raw_page("arch/latest/1/git.1.gz").first().as_html


def test_replacing_and_deleting(spark, store):
    again = parsed_row("arch/latest/1/git.1.gz", "git")
    store.add_pages(spark.createDataFrame([raw_row(again[0])], RAW), spark.createDataFrame([again], PARSED))
    assert store.mappings.where("src = 'alias'").isEmpty()
    assert store.parsed.count() == 4
    with pytest.raises(Duplicate):
        other = parsed_row("arch/latest/2/git.2.gz", "git")
        store.add_pages(spark.createDataFrame([raw_row(other[0])], RAW), spark.createDataFrame([other], PARSED))
    with pytest.raises(ValueError, match="malformed"):
        store.add_pages(spark.createDataFrame([raw_row("x")], RAW), spark.createDataFrame([parsed_row("x", "x")], PARSED))
    store.delete(spark.createDataFrame([("arch/latest/1/git.1.gz",)], "source string"))
    assert (store.raw.count(), store.parsed.count(), store.mappings.where("dst like 'arch/latest/1/git%'").count()) == (3, 3, 0)
    store.log_event("extraction", {"n": 1})
    store.log_event("upload", {"n": 2})
    assert [r.event for r in store.events(5).collect()] == ["extraction", "upload"]
    assert store.events(5, "upload").count() == 1
    fresh = spark.createDataFrame([parsed_row("ubuntu/26.04/1/git-commit.1.gz", "git-commit", options=[option("other text", "-a", "--all"), option("new", "-n")])], PARSED)
    fields, options = store.diff(fresh)
    assert fields.count() == 0
    assert {(r.key, r.change) for r in options.collect()} == {("-a|--all", "changed"), ("-n|", "added"), ("positional:FILE", "removed")}
    files = spark.createDataFrame([(0, "ubuntu/26.04/1/git.1.gz", "x", 1, None), (1, "ubuntu/26.04/1/new.1.gz", "hubuntu/26.04/1/git.1.gz", 1, None), (2, "ubuntu/26.04/1/new2.1.gz", "z", 1, None)], "pos int, source string, sha string, length int, canonical string")
    assert {r.pos: r.kind for r in store.plan(files).collect()} == {0: "stored", 1: "content_dup", 2: "work"}


def test_command_line(spark, store, capsys):
    assert main([store.path, "page", "git-commit"], spark) == 0
    assert "-a, --all" in capsys.readouterr().out
    assert main([store.path, "page", "none"], spark) == 1
    assert main([store.path, "page", "git", "--distro", "arch"], spark) == 2
    assert main([store.path, "check"], spark) == 0
    for command in (["distros"], ["stats"], ["sections", "arch", "latest"], ["pages", "arch/"], ["mappings", "--prefix", "arch/"], ["explain", "git-commit -a"]):
        assert main([store.path, *command], spark) == 0
    assert "all of it" in capsys.readouterr().out
    assert main([store.path, "page", "git", "--distro", "suse", "--release", "1"], spark) == 1


def test_more_commands(spark, store, capsys, tmp_path):
    store.log_event("extraction", {"succeeded": 2, "failed": {"x": 1}})
    assert main([store.path, "events", "-n", "1"], spark) == 0
    assert "extraction\n  failed: {\"x\": 1}\n  succeeded: 2" in capsys.readouterr().out
    spark.createDataFrame([parsed_row("ubuntu/26.04/1/git-commit.1.gz", "git-commit", options=[option("new", "-n")])], PARSED).write.parquet(str(tmp_path / "fresh"))
    assert main([store.path, "diff", str(tmp_path / "fresh")], spark) == 0
    out = capsys.readouterr().out
    assert "added" in out and "removed" in out
    files = [(0, "ubuntu/26.04/1/git.1.gz", "x", 1, None), (1, "ubuntu/26.04/1/n.1.gz", None, 1, None), (2, "ubuntu/26.04/1/m.1.gz", None, 9000, None)]
    spark.createDataFrame(files, "pos int, source string, sha string, length int, canonical string").write.parquet(str(tmp_path / "files"))
    assert main([store.path, "plan", str(tmp_path / "files"), "--size", "small"], spark) == 0
    out = capsys.readouterr().out
    assert "size_skip" in out and "stored" in out and "work" in out
    assert main([store.path, "diff-extractors", "reader..reader", "--prefix", "arch/"], spark) == 0
    assert "success" in capsys.readouterr().out


def test_metadata(spark):
    df = spark.createDataFrame([("s", "tar", 0, "tar", "an archiver"), ("s", "tar", 1, "untar", "an archiver"), ("s", "tar", 2, "rmt", "other")], "source string, name string, pos int, program string, text string")
    r = M.synopsis_and_aliases(df).first()
    assert (r.synopsis, [tuple(a) for a in r.aliases]) == ("an archiver", [("tar", 10), ("rmt", 1), ("untar", 1)])
    lines = [("r", 0, '{"type": "agent_message", "text": "a"}'), ("r", 1, '{"type": "turn", "usage": {"input_tokens": 3, "output_tokens": 4}}'), ("r", 2, '{"type": "agent_message", "text": "b"}'), ("r", 3, "noise")]
    r = M.last_messages(spark.createDataFrame(lines, "run string, pos int, line string")).first()
    assert (r.message, r.tokens) == ("b", 7)
    req = spark.createDataFrame([("p:0",), ("p:1",), ("q:0",)], "custom_id string")
    out = spark.createDataFrame([('{"custom_id": "p:0", "response": {"status_code": 200, "body": "ok"}}',), ('{"custom_id": "q:0", "response": {"status_code": 500, "body": ""}}',)], "line string")
    assert {r.custom_id: (r.reply, r.error) for r in M.batch_replies(req, out).collect()} == {"p:0": ("ok", None), "p:1": (None, "missing"), "q:0": (None, "status 500")}
    t = lambda s: F.lit(s).cast("timestamp")
    ages = spark.range(1).select(M.age(t("2024-01-01 00:00:00"), t("2024-01-01 00:01:05")), M.age(t("2024-01-01"), t("2024-01-03")), M.parse_model(F.lit("openai/gpt/high")))
    assert tuple(ages.first())[:2] == ("1 minute ago", "2 days ago")
    assert ages.first()[2].effort == "high"
    spans = spark.createDataFrame([(1, 0, 2, 9), (1, 4, 5, 9), (1, 4, 7, 9), (1, 5, 6, 9), (2, 3, 3, 4), (2, None, 1, 4), (3, -2, 99, 5), (4, 2, 4, 4)], "k int, s int, e int, n int")
    assert sorted(tuple(r) for r in M.uncovered(spans, "k", "s", "e", "n").collect()) == [(1, 2, 4), (1, 7, 9), (2, 0, 4), (4, 0, 2)]
