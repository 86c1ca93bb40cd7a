"""Metrics against Python's own HTML parser and plain loops; comparisons of runs from their rules."""

import json
from collections import Counter
from html.parser import HTMLParser

import pytest

from cliloom.operators import evals as V


class Walk(HTMLParser):
    def __init__(self):
        super().__init__()
        self.tags, self.text, self.depth, self.most = Counter(), "", 0, 0

    def handle_starttag(self, tag, attrs):
        self.tags[tag] += 1
        self.depth += 1
        self.most = max(self.most, self.depth)

    def handle_startendtag(self, tag, attrs):
        self.tags[tag] += 1

    def handle_endtag(self, tag):
        self.depth = max(0, self.depth - 1)

    def handle_data(self, data):
        self.text += data


HTML = [
    "", "plain *text*", "<p>a<b>b</b></p>", "</p></p><p>x", "<P CLASS='a>b'>x<br>y<br/>z</P>", "<!-- <p> --><ul><li><em>[x]</em><li>y</ul>", "<table><tr><td>a_b</td></tr></table>", "a &lt;b&gt; &amp;amp; \\ `c`",
    "<!DOCTYPE html><script>if (a<b) { '<p>' }</script><pre>*</pre>", "<div>" * 50 + "deep" + "</div>" * 60 + "<h1>t</h1>",
]


def test_html_metrics(spark):
    df = spark.createDataFrame(list(enumerate(HTML)), "i int, h string")
    for r in df.select("i", "h", V.html_metrics(df.h).alias("m")).collect():
        w = Walk()
        w.feed(r["h"])
        w.close()
        text = w.text if "script" not in r["h"] else "*"  # what a script holds is no text here
        assert r["m"]["tags"] == {t: w.tags[t] for t in V.TAGS}, r["h"]
        assert (r["m"]["data_chars"], r["m"]["max_depth"]) == (len(text), w.most), r["h"]
        assert r["m"]["chars"] == {c: text.count(c) for c in V.SENSITIVE}
    voids = spark.createDataFrame([("<p>a<br>b<br>c",)], "h string")
    assert [voids.select(V.html_metrics(voids.h, v)["max_depth"].alias("d")).first()["d"] for v in ((), ("br",))] == [3, 1]


def test_page_metrics(spark):
    md = "# NAME\nls -a, --all\n\n# SEE ALSO\nx\n# OPTIONS\n**-x** \\* -b\n" + "y" * 600 + "\n"
    df = spark.createDataFrame([(1, md, "<p>x</p>"), (2, None, None), (3, "", "")], "k int, md string, html string")
    rows = {r["k"]: r for r in V.page_metrics(df, "k", "md", "html").collect()}
    m = rows[1]["markdown"]
    assert (m["line_count"], m["nonblank_line_count"], m["char_count"], m["max_line_length"], m["giant_lines_500"], m["giant_lines_1000"]) == (8, 7, len(md), 600, 1, 0)
    assert (m["option_like_tokens"], m["max_option_like_tokens_on_line"], m["lines_with_multiple_option_like_tokens"], m["unescaped_star_runs"]) == (4, 2, 2, 2)
    assert rows[1]["filtered"]["removed_sections"] == {"SEE ALSO": 1} and rows[1]["filtered"]["line_count"] == 6
    assert rows[2]["markdown"]["line_count"] == rows[3]["markdown"]["line_count"] == 0 and rows[2]["html"]["max_depth"] == 0


RUN = "path string, m struct<ok: boolean, n: long, deep: struct<x: double>, each: map<string, int>>, note string"


def runs(spark):
    a = [("p", (True, 100, (1.0,), {"k": 1}), "x"), ("q", (True, 10, (None,), {}), "x"), ("gone", (True, 1, (1.0,), {}), "x")]
    b = [("p", (False, 101, (1.0,), {"k": 2, "new": 1}), "y"), ("q", (True, 5, (3.0,), {}), "x"), ("come", (True, 1, (1.0,), {}), "x")]
    return (spark.createDataFrame(x, RUN) for x in (a, b))


def test_comparison(spark, tmp_path):
    before, after = (V.unpivoted(x, "path") for x in runs(spark))
    assert {r["metric"] for r in before.collect()} == {"m.ok", "m.n", "m.deep.x", "m.each.k"}
    checks = spark.createDataFrame([("m.ok", 0.0, None), ("m.n", 0.02, "down"), ("m.deep.x", 0.0, "up"), ("m.each.k", 0.0, "down"), ("m.each.new", 0.0, None)], "metric string, tolerance double, direction string")
    got = sorted(map(tuple, V.compared(before, after, checks).collect()), key=str)
    want = [("come", None, None, None, None, "added"), ("gone", None, None, None, None, "removed"), ("p", "m.each.new", 0.0, 1.0, 1.0, "changed"), ("p", "m.ok", 1.0, 0.0, -1.0, "flipped"), ("q", "m.deep.x", 0.0, 3.0, 3.0, "changed"), ("q", "m.n", 10.0, 5.0, -5.0, "changed")]
    assert got == want
    assert {tuple(r) for r in V.total_checks(before, after, checks.where("direction is not null")).collect()} == {("m.n", 111.0, 107.0, -4.0), ("m.deep.x", 2.0, 5.0, 3.0)}
    for name, run in zip("ab", runs(spark), strict=True):
        (tmp_path / name).mkdir()
        (tmp_path / name / "pages.json").write_text("\n".join(json.dumps(r.asDict(recursive=True) | {"m": r["m"].asDict(recursive=True)}) for r in run.collect()))
    pages, all_ = V.compare_folders(spark, str(tmp_path / "a"), str(tmp_path / "b"), checks)
    assert sorted(map(tuple, pages.collect()), key=str) == want and all_.count() > 0


@pytest.mark.parametrize(("a", "b", "differ"), [({"X": 1}, {"X": 1}, False), ({"X": 1}, {"X": 2}, True), ({}, {"X": 1}, True), ({"X": 1}, {}, True)])
def test_removed_sections(spark, a, b, differ):
    run = lambda m: V.unpivoted(spark.createDataFrame([("p", (m, 1))], "path string, filtered struct<removed_sections: map<string, int>, n: int>"), "path")
    assert (V.removed_sections_changed(run(a), run(b)).count() == 1) == differ
