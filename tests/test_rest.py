"""Texts, options, comparisons, ingest, extraction, readers, writers and streams on small inputs."""

import gzip
import json
import random
import re
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cliloom.functions import strings as S
from cliloom.operators import analytics as O
from cliloom.operators import compare as D
from cliloom.operators import explain as E
from cliloom.operators import extract as X
from cliloom.operators import ingest as I
from cliloom.operators import loadgen as L
from cliloom.operators import options as P
from cliloom.operators import texts as T
from cliloom.sources import readers as R
from cliloom.sources import sinks as W
from cliloom.streaming import logs


def one(spark, expression, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return df.select(expression.alias("x")).first()["x"]


# Scalars.


@pytest.mark.parametrize(
    ("text", "out"),
    [(r"\fBfoo\fR \-\-bar", "foo --bar"), (r"a\(enb\(emc", "a-b-c"), (r"\(lqx\(rq \(aqy\(cq", "\"x\" 'y'"), (r"\&a\~b\0c\ d", "a b c d"), (r"\m[red]x\m[]", "x"), (r"\s-2x\s+2", "x"), (r"a   b ", "a b"), (r"\(bu item", "item")],
)
def test_clean_roff(spark, text, out):
    assert one(spark, S.clean_roff("t"), t=text) == out


def test_small_functions(spark):
    assert one(spark, S.parse_synopsis("t"), t='/a/tar.1.gz: "tar - an archiver."').asDict() == {"name": "tar", "text": "an archiver"}
    assert one(spark, S.parse_synopsis("t"), t="nothing") is None
    assert one(spark, S.redirect_target("t"), t="\n.so man1/gzip.1\n") == "man1/gzip.1"
    assert one(spark, S.redirect_target("t"), t=".so man1/gzip.1\nmore") is None
    assert one(spark, S.names_nested_command("t"), t=r"\fBsudo\fR [options] command [args]")
    assert not one(spark, S.names_nested_command("t"), t="git <command>")
    assert not one(spark, S.names_nested_command("t"), t="rsync --rsh-command=x")
    assert one(spark, S.is_header("t", "name"), t='.SH "NAME"')
    assert one(spark, S.unescape_copy("t"), t="a\\tb\\nc\\\\d") == "a\tb\nc\\d"
    assert one(spark, S.fnv1a("t"), t="") == 2166136261
    assert one(spark, S.fnv1a("t"), t="a") == 0xE40C292C
    assert one(spark, S.fnv1a("t"), t="é") == _fnv("é")
    assert one(spark, S.repaired_json("t"), t='```json\n{"a": "x\\d"}\n```') == '{"a":"x\\\\d"}'
    assert one(spark, S.repaired_json("t"), t="no json") is None
    assert one(spark, S.longest_template("t", {"a/": "1", "a/b/": "2"}), t="a/b/c") == "2"
    assert one(spark, S.parse_mode("t"), t="llm:x/y").asDict() == {"mode": "llm", "model": "x/y"}
    assert one(spark, S.first_nonempty("a", "b", "c"), a="", b="h2", c="r") == "h2"
    assert one(spark, S.is_source("t"), t="ubuntu/26.04/1/tar.1.gz")
    assert not one(spark, S.is_source("t"), t="1/tar.1.gz")
    assert one(spark, S.distro("t"), t="none") == ""
    assert one(spark, S.html_escape("t"), t="<a href='x'>&") == "&lt;a href=&#39;x&#39;&gt;&amp;"
    assert one(spark, S.command_shape("t"), t="ls -l | wc -l") == "ls:args=4:pipes=1"


def _fnv(s):
    h = 2166136261
    for b in s.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


# Aggregates and folds.


def test_histogram_and_summary(spark):
    counts = [0, 0, 1, 3, 5, 7, 10, 15, 16, 30, 50, 51, 100]
    df = spark.createDataFrame([(c,) for c in counts], "n int")
    assert [(r.bucket, r.pages) for r in O.option_histogram(df, "n").orderBy("place").collect()] == [("0", 2), ("1-5", 3), ("6-15", 3), ("16-50", 3), ("50+", 2)]
    r = O.count_summary(df, "n").first()
    assert (r.n, r.median, r.most) == (13, 10, 100)
    assert r.p90 == pytest.approx(80.4) == pytest.approx(statistics.quantiles(counts, n=10)[8])
    assert O.count_summary(df.limit(0), "n").first().asDict() == {"n": 0, "total": 0, "mean": 0.0, "median": 0.0, "most": 0, "p90": 0.0}


@pytest.mark.parametrize(("sizes", "capacity", "batches"), [([1, 1, 1, 1], 2, [0, 0, 1, 1]), ([1, 3], 2, [0, 1]), ([10], 3, [0]), ([2, 2], 2, [0, 1])])
def test_greedy_batches(spark, sizes, capacity, batches):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate(sizes)], "g int, o int, s int")
    assert [r.batch for r in O.greedy_batches(df, "g", "o", "s", capacity).orderBy("o").collect()] == batches


def test_detector(spark):
    cmds = [(1, "ls | grep x; wc"), (2, ""), (3, "ls ls"), (4, "ls ls " + "z" * 250), (5, "ls ls ls ls " + "z" * 5000), (6, "ls ls ls ls")]
    names = spark.createDataFrame([("ls",), ("grep",), ("wc",)], "n string")
    rows = {r.id: (r.hits, r.shed) for r in O.hits_and_verdict(spark.createDataFrame(cmds, "id int, cmd string"), names).collect()}
    assert rows == {1: (3, False), 2: (0, False), 3: (2, False), 4: (2, True), 5: (4, False), 6: (4, True)}


# Text structure.


def page(sections=10, size=8100):
    rng = random.Random(1)
    out = ["# NAME", "tool - does it", "# SYNOPSIS", "tool [-a]"]
    for i in range(sections):
        out.append(f"# SECTION {i}")
        while sum(map(len, out)) < size * (i + 1):
            out += ["", f"**-{rng.choice('abcdef')}**, **--opt{i}**", "", "> " + "word " * rng.randint(10, 60)]
    return "\n".join(out)


def body_lines(chunk):
    return [x for x in chunk.split("\n---\n\n")[-1].split("\n")]


@pytest.mark.parametrize("text", [page(), page(3, 50_000), "\n\n".join("p" * 5000 for _ in range(20)), "x\n" * 30_000])
def test_chunks_hold_every_line_once(text):
    parts = T.chunk(text)
    assert len(parts) > 1
    assert all(len(p) <= T.CHUNK for p in parts)
    lines = [x.split("| ", 1) for p in parts for x in body_lines(p)]
    numbers = [int(n) for n, _ in lines]
    assert sorted(set(numbers)) == numbers
    full = text.split("\n")
    assert all(full[n - 1] == x for n, (_, x) in zip(numbers, lines, strict=True))
    assert {i + 1 for i, x in enumerate(full) if x.strip()} <= set(numbers)


def test_no_chunk_ends_on_a_bare_heading():
    for size in (500, 900, 1500, 2000, 3000):
        text = "# OPTIONS\n" + "\n\n".join(f"**-{i}**\n\n**--long{i}**\n\n> " + "b" * size for i in range(90_000 // size))
        parts = T.chunk(text)
        assert len(parts) > 1
        for p in parts[:-1]:
            last = [x for x in p.split("\n") if x.split("|", 1)[1].strip()][-1] if "|" in p else ""
            assert not last.split("| ", 1)[1].startswith("**-")


def test_oversize_line_is_one_chunk():
    assert len(T.chunk("y" * 60_001)) == 1
    assert T.chunk("a\nb") == ["1| a\n2| b"]


def test_preamble_is_capped():
    lead = T.preamble("# NAME\n" + "line\n" * 20_000 + "# SYNOPSIS\nx")
    assert len(lead) <= T.PREAMBLE + 20
    assert lead.endswith("[…truncated]")


def test_filter_takes_subsections_along(spark):
    text = "# NAME\na\n# SEE ALSO\nb\n## More\nc\n# OPTIONS\n## Sub\nd"
    r = T.filtered(spark.createDataFrame([(1, text)], "k int, text string"), "k", "text").first()
    assert r.text == "# NAME\na\n# OPTIONS\n## Sub\nd"
    assert [(x.heading, x.n) for x in r.removed] == [("SEE ALSO", 1)]


@settings(max_examples=20, deadline=None)
@given(st.lists(st.sampled_from(["", "# A", "## B", "text", "> quote", "# SEE ALSO"]), min_size=1, max_size=12))
def test_sections_and_paragraphs_give_the_text_back(lines):
    bounds = T._section_bounds(lines)
    parts = list(zip(bounds, bounds[1:], strict=False))
    assert [x for a, b in parts for x in lines[a:b]] == lines
    for a, b in parts:
        assert ["\n".join(lines[i:j]) for i, j in T._paragraphs(lines, a, b)] == "\n".join(lines[a:b]).split("\n\n")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 9), st.booleans()), min_size=1, max_size=12), st.integers(1, 30), st.integers(0, 1))
def test_runs_are_as_long_as_fits(items, room, least):
    """Against taking one item after the other."""
    sizes, waits = [n for n, _ in items], [w for _, w in items]
    places = [sum(sizes[:k]) for k in range(len(sizes) + 1)]
    got = T._runs(np.array(places[:-1]), np.array(places[1:]), room, waits, least)
    want, at, taken = [], 0, 0  # the run begins at `at` and has `taken` items
    for k, n in enumerate(sizes):
        if taken and sum(sizes[at:k]) + n > room:
            while taken > least and waits[at + taken - 1]:
                taken -= 1
            if taken:
                want.append((at, at + taken))
            at, taken = at + taken, k - at - taken
        taken += 1
    assert got == [*want, (at, len(sizes))]


def test_slices(spark):
    lines = F.split(F.lit("a\n> -x\n> \n> does x\n> \nb"), "\n", -1)
    assert one(spark, T.line_slice(lines, F.lit(2), F.lit(5))) == "-x\n\ndoes x"
    assert one(spark, T.line_slice(lines, F.lit(2), F.lit(2))) == "-x"
    assert one(spark, T.line_slice(lines, F.lit(9), F.lit(9))) == ""
    assert one(spark, T.line_slice(lines, F.lit(3), F.lit(2))) == ""


def test_audit(spark):
    df = spark.createDataFrame([(1, "a **** b \\fB \\[bu] \\(em \\`\\`\n# SYNOPSIS\n" + "z" * 201, "<em> </em> &nbsp; &amp;amp; &zwnj;")], "k int, md string, html string")
    got = {r.rule: r.hits for r in T.audit(df, "k", "md", "html").collect()}
    assert got == dict.fromkeys(("quad_star_run", "roff_named_escape", "roff_two_letter_escape", "roff_font_escape", "visible_open_double_backtick", "empty_emphasis_tag", "visible_zwnj_entity", "visible_nbsp_entity", "visible_double_amp", "synopsis_no_spaces_run"), 1)
    none = {r.rule for r in T.audit(df, "k", "md", "html", known_escapes=F.array(F.lit("other"))).collect()}
    assert "roff_named_escape" not in none


# Options.


def opt(flags, text, **more):
    return {"short": [f for f in flags if not f.startswith("--")], "long": [f for f in flags if f.startswith("--")], "text": text, "line_start": 1, "line_end": 1} | more


@pytest.mark.parametrize(
    ("rows", "out"),
    [
        ([(["-M", "Z"], "x"), (["Z"], "see -M")], [({"-M", "Z"}, "see -M")]),
        ([(["-a", "-b"], "short"), (["-a"], "much longer, as -b")], [({"-a", "-b"}, "much longer, as -b")]),
        ([(["-a", "-b", "-c"], "l"), (["-a", "-b"], "k"), (["-a"], "with -b")], [({"-a", "-b", "-c"}, "l"), ({"-a", "-b"}, "with -b")]),
        ([(["-a"], "with -b"), (["-a", "-b"], "k"), (["-a", "-b", "-c"], "l")], [({"-a", "-b"}, "with -b"), ({"-a", "-b", "-c"}, "l")]),
        ([(["-A", "-e"], "x"), (["-e"], "no mention")], [({"-A", "-e"}, "x"), ({"-e"}, "no mention")]),
    ],
)
def test_superset_merge(spark, rows, out):
    assert merged(spark, {1: rows})[1] == out


OPTION_ROWS = "page int, idx int, short array<string>, long array<string>, text string, line_start int, line_end int"


def merged(spark, pages):
    rows = [(p, i, *opt(f, t).values()) for p, options in pages.items() for i, (f, t) in enumerate(options)]
    rows = [(*r[:5], r[1] * 10, r[1] * 10 + 1) for r in rows]
    got = P.superset_dedup(spark.createDataFrame(rows, OPTION_ROWS).repartition(3), "page", "idx").orderBy("page", "idx").collect()
    assert all(r["line_end"] == r["line_start"] + 1 for r in got)
    return {p: [(set(r["short"]) | set(r["long"]), r["text"]) for r in got if r["page"] == p] for p in pages}


def folded(options):
    """The same from the rule, one option behind the other."""
    rows = [[set(f), t] for f, t in options]
    gone = set()
    for i, (f, t) in enumerate(rows):
        named = [j for j, (g, _) in enumerate(rows) if j not in gone and f and f < g and any(re.search(r"(?<![a-zA-Z0-9\-])" + re.escape(x) + r"(?![a-zA-Z0-9\-])", t) for x in g - f)]
        if named:
            j = min(named, key=lambda j: (len(rows[j][0]), j))
            rows[j][1] = max(rows[j][1], t, key=len)
            gone.add(i)
    return [(f, t) for i, (f, t) in enumerate(rows) if i not in gone]


def test_superset_merge_keeps_the_order_of_the_fold(spark):
    rng = random.Random(8)
    flags = ["-a", "-b", "-c", "--all", "--b", "x", "\\E"]
    pages = {p: [(rng.sample(flags, rng.randint(0, 5)), " ".join(rng.choices([*flags, "-ab", "word"], k=rng.randint(0, 6)))) for _ in range(rng.randint(1, 14))] for p in range(60)}
    assert merged(spark, pages) == {p: folded(o) for p, o in pages.items()}


def test_exact_dedup_and_mentions(spark):
    rows = [(1, 0, ["-o"], [], "short"), (1, 1, ["-x"], [], "x"), (1, 2, ["-o"], [], "a longer text"), (1, 3, [], [], "pos")]
    out = P.exact_dedup(spark.createDataFrame(rows, "p int, idx int, short array<string>, long array<string>, text string"), "p", "idx", "text").orderBy("idx").collect()
    assert [(r.idx, r.text) for r in out] == [(0, "a longer text"), (1, "x"), (3, "pos")]
    for text, flag, yes in (("see -b.", "-b", True), ("see --b", "-b", False), ("see -bc", "-b", False), ("(-b)", "-b", True)):
        assert one(spark, P.mentions(F.lit(text), F.lit(flag))) == yes


# Comparisons and ingest.


def test_classify_by_folder(spark):
    files = spark.createDataFrame([(0, "u/1/1/a.1.gz", "h", 10, None), (1, "u/1/1/b.1.gz", "h", 10, None), (2, "u/2/1/a.1.gz", "h", 10, None), (3, "u/1/1/c.1.gz", "k", 10, "u/1/1/a.1.gz"), (4, "u/1/1/d.1.gz", "m", 9999, None)], "pos int, source string, sha string, length int, canonical string")
    stored = spark.createDataFrame([], "source string, extractor string, model string")
    known = spark.createDataFrame([], "key string, source string")
    got = {r.pos: (r.kind, r["of"]) for r in D.classify(files, stored, known, size="small").collect()}
    assert got == {0: ("work", None), 1: ("content_dup", "u/1/1/a.1.gz"), 2: ("work", None), 3: ("symlink", "u/1/1/a.1.gz"), 4: ("size_skip", None)}


def test_text_diff(spark):
    assert one(spark, D.text_diff("a", "b"), a="x\ny\nz", b="x\nY\nz").split("\n")[1:] == [" x", "-y", "+Y", " z"]


def test_links(spark):
    links = [(f"n{i}", f"n{i + 1}") for i in range(11)] + [("a", "b"), ("b", "a"), ("m0", "m1")]
    got = {r.src: (r.dst, r.depth) for r in I.follow_links(spark.createDataFrame(links, "src string, dst string")).collect()}
    assert got["n1"] == ("n11", 10)
    assert got["n0"] == (None, 11)
    assert got["a"] == (None, None)
    assert got["m0"] == ("m1", 1)


def test_redirects(spark):
    pages = spark.createDataFrame([("1/zcat.1", "1", ".so man1/gzip.1"), ("3/x.3", "3", ".so y.3"), ("1/t.1", "1", "text")], "path string, section string, text string")
    known = spark.createDataFrame([("1/gzip.1",), ("3/y.3",)], "path string")
    assert {r.path: r.target for r in I.redirect_candidates(pages, known).collect()} == {"1/zcat.1": "1/gzip.1", "3/x.3": "3/y.3"}


# Extraction.


def test_extract(spark):
    text = "# OPTIONS\n-a, --all do all\n\n-o, --out=FILE where to\n\n# SEE ALSO\n-z no"
    pages = spark.createDataFrame([("p", text), ("e", "  "), ("big", "x" * 500_001)], "source string, text string")
    outcomes, options = X.extract(pages, "reader")
    assert {r.source: (r.outcome, r.reason) for r in outcomes.collect()} == {"p": ("success", None), "e": ("skipped", "empty"), "big": ("skipped", "oversize")}
    assert [(sorted(r.short + r.long), r.has_arg) for r in options.orderBy("idx").collect()] == [(["--all", "-a"], False), (["--out=FILE", "-o"], True)]


def test_failures_stay_with_their_page(spark):
    replies = [("ok", 0, 1, json.dumps({"options": [{"short": ["-a"], "long": [], "lines": [1, 1]}]}), 3, None), ("bad", 0, 1, "not json", 0, None), ("lost", 0, 2, json.dumps({"options": []}), 0, None), ("err", 0, 1, None, 0, "boom"), ("wide", 0, 1, json.dumps({"options": [{"short": [f"-{c}"], "long": [], "lines": [1, 2]} for c in "abcd"]}), 0, None)]
    df = spark.createDataFrame(replies, X._REPLY)
    outcomes, options = X.assemble(df, spark.createDataFrame([(r[0], "-a x\n-b y") for r in replies], "source string, text string"))
    assert {r.source: r.reason for r in outcomes.collect()} == {"ok": None, "bad": "bad_reply", "lost": "missing_chunk", "err": "bad_reply", "wide": "line_span_coverage"}
    assert {r.source for r in options.collect()} == {"ok"}


def test_retry():
    class Flaky:
        n = 0

        def call(self, prompt):
            self.n += 1
            if self.n < 3:
                raise X.RetryableError
            return "ok", 1

    waits = []
    assert X.call_with_retry(Flaky(), "p", wait=waits.append) == ("ok", 1)
    assert waits == [1.0, 2.0]
    with pytest.raises(X.RetryableError):
        X.call_with_retry(Flaky(), "p", tries=2, wait=waits.append)
    with pytest.raises(ValueError):
        X.make_provider("none/x")


def test_markup():
    out = E.markup("b $(c) <", 10, [(14, 15, "substitution")])
    assert out == 'b&nbsp;$(<a href="/explain?cmd=c">c</a>)&nbsp;&lt;'


# Readers and writers.


def test_page_files(spark, tmp_path):
    for name, text in (("ubuntu/26.04/1/a.1.gz", ".SH NAME\na - b\n.SH SYNOPSIS\na command\n.SH X\n"), ("ubuntu/26.04/1/b.1.gz", "x")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(gzip.compress(text.encode()))
    files = R.gz_files(spark, [str(tmp_path)])
    assert {r.source for r in files.collect()} == {"ubuntu/26.04/1/a.1.gz", "ubuntu/26.04/1/b.1.gz"}
    texts = R.page_texts(spark, str(tmp_path))
    assert {r.source: r.text for r in R.roff_section(texts, "source", "text", "synopsis").collect()} == {"ubuntu/26.04/1/a.1.gz": "a command"}
    with pytest.raises(ValueError):
        R.gz_files(spark, ["a.txt"])
    (tmp_path / "list.txt").write_text("one # not\n\n# no\ntwo\n")
    assert R.expand_lists(spark, ["zero", f"@{tmp_path}/list.txt"]) == ["zero", "one", "two"]
    up = R.rendered(texts, str.upper).orderBy("source").collect()
    assert up[1].text == "X"


def test_dumps(spark, tmp_path):
    (tmp_path / "f.tsv").write_text('1\t"a b"\t\\N\n')
    assert R.dump_table(spark, f"{tmp_path}/f.tsv", "id int, name string, x string").first() == (1, "a b", None)
    (tmp_path / "c.txt").write_text("h1\tm\ta\\tb\\nc\td\n")
    assert R.dump_contents(spark, f"{tmp_path}/c.txt").first().text == "a\tb\nc\td"
    (tmp_path / "l.json").write_text('{"a": 1}\nbroken\n')
    assert R.log_rows(spark, f"{tmp_path}/l.json", "a int").count() == 1
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        R.export(spark, f"{tmp_path}/l.json", "a int").collect()


def test_versions(spark, tmp_path):
    t = W.VersionedTable(spark, str(tmp_path / "t"))
    assert t.upsert(spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), "k") == 0
    assert t.upsert(spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k") == 1
    assert {tuple(r) for r in t.read().collect()} == {(1, "a"), (2, "c"), (3, "d")}
    with pytest.raises(ValueError):
        t.clear()
    t.clear(confirm=True)
    assert t.read().count() == 0
    W.append_event(spark, str(tmp_path / "e"), "upload", {"n": 1})
    W.append_event(spark, str(tmp_path / "e"), "upload", {"n": 2})
    assert spark.read.parquet(str(tmp_path / "e")).count() == 2
    W.write_report({"b": 1, "a": 2}, str(tmp_path / "r.json"))
    assert list(json.loads((tmp_path / "r.json").read_text())) == ["a", "b"]


def test_load_lines_are_the_same_each_time(spark):
    a, b = (L.commands(spark.range(200), "id").collect() for _ in range(2))
    assert a == b
    assert len({r.cmd for r in a}) > 30


# Streams.


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i // 7:02d}:{i % 60:02d}", f"10.0.0.{i % 3}") for i in range(200)]
    df = spark.createDataFrame(rows, "id int, t string, ip string").select("id", F.col("t").cast("timestamp").alias("ts"), "ip")
    df.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = logs.minute_bursts(logs.read_log(spark, f"{tmp_path}/in", df.schema, 1))
    stream.writeStream.outputMode("complete").format("memory").queryName("bursts").trigger(availableNow=True).start().awaitTermination()
    got = {tuple(r) for r in spark.table("bursts").collect()}
    want = {tuple(r) for r in df.groupBy(F.date_trunc("MINUTE", "ts").alias("minute"), "ip").agg(F.count("*").alias("hits")).collect()}
    assert got == want
    stream = logs.minute_bursts(logs.read_log(spark, f"{tmp_path}/in", df.schema, 1), late="1 hour")  # no row of the four files is later
    logs.upsert_batches(stream, f"{tmp_path}/u", ["minute", "ip"], f"{tmp_path}/su").awaitTermination()
    assert {tuple(r) for r in logs.upserted(spark, f"{tmp_path}/u", stream.schema, ["minute", "ip"]).collect()} == want
    df.where("id = 199 or id < 3").coalesce(1).write.parquet(f"{tmp_path}/one")
    logs.upsert_batches(logs.read_log(spark, f"{tmp_path}/one", df.schema, 1), f"{tmp_path}/v", ["ip"], f"{tmp_path}/s", "id").awaitTermination()
    assert {(r.ip, r.id) for r in logs.upserted(spark, f"{tmp_path}/v", df.schema, ["ip"]).collect()} == {("10.0.0.0", 0), ("10.0.0.1", 199), ("10.0.0.2", 2)}


# Presentation, guards.


def test_differences_in_print(spark):
    schema = "page string, at int, short array<string>, long array<string>, positional string, has_arg boolean, text string"
    a = spark.createDataFrame([("p", 0, ["-a"], ["--all"], None, False, "all"), ("p", 1, ["-b"], [], None, False, "old"), ("p", 2, [], [], "file", False, "x")], schema)
    b = spark.createDataFrame([("p", 0, ["-a"], ["--all"], None, None, "all"), ("p", 1, ["-b"], [], None, True, "new"), ("p", 2, ["-c"], [], None, True, " c\nd ")], schema)
    assert D.diff_lines(a, b, "page", "at").first().lines == [
        "  -a, --all (unchanged)", "  -b", "    - text: old", "    + text: new", "    - has_arg: none", "    + has_arg: true",
        "- <file>", "-     short: ", "-     long: ", "-     takes a value: false", "-     positional: file", "-     x",
        "+ -c", "+     short: -c", "+     long: ", "+     takes a value: true", "+     c", "+     d",
    ]
    runs = spark.createDataFrame([("p", "m", 1.0, None, "removed")], "path string, metric string, a double, b double, change string")
    assert D.change_lines(runs).first().line == "m: 1.00 -> none (removed)"


def test_decisions_take_effect(spark):
    d = spark.createDataFrame([(0, "a", "symlink", "b"), (1, "b", "work", None), (2, "c", "symlink", "z"), (3, "d", "content_dup", "b")], "pos int, source string, kind string, of string")
    told, left = D.applied(d, spark.createDataFrame([("a",), ("b",), ("q",)], "source string"))
    assert {r.source: r.message for r in told.collect()} == {"a": "link to b (given too)", "b": None, "c": "link to z (give that file to extract it)", "d": "same content as b"}
    assert {r.source for r in left.collect()} == {"b", "q"}


def test_snippets_and_raw_pages(spark):
    assert one(spark, T.padded(F.col("t"), F.col("f")), t="0123456789abcdefXYghijklmnopqrstuv", f="XY") == "456789abcdefXYghijklmnopqr"
    assert one(spark, T.padded(F.col("t"), F.col("f")), t="abXY", f="XY") == "abXY"
    assert one(spark, T.padded(F.col("t"), F.col("f")), t="ab", f="XY") == ""
    raw = I.raw_pages(spark.createDataFrame([("s", "t", b"abc")], "source string, text string, content binary"), "g", "1").first()
    assert (raw.sha[:8], raw.generator, raw.generator_version) == ("ba7816bf", "g", "1")


def test_pages_of_too_many_chunks_fail(spark):
    pages = spark.createDataFrame([("long", "\n\n".join(["-a word " + "x" * 80] * 40)), ("short", "-a word")], "source string, text string")
    outcomes, _ = X.extract(pages, "reader", 200)
    got = {r.source: (r.outcome, r.reason, r.chunks > T.MOST_CHUNKS) for r in outcomes.collect()}
    assert got["long"] == ("failed", "too_many_chunks", True)
    assert got["short"][1] != "too_many_chunks"
