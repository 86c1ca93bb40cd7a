"""Scalar functions, text structure, options, comparisons and ingest over the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import analytics as O
from ..operators import compare as D
from ..operators import evals as V
from ..operators import ingest as I
from ..operators import metadata as M
from ..operators import options as P
from ..operators import texts as T
from . import analogs as A
from .registry import query

# Scalars.


@query("str_paths", "a_page", """SELECT source, split_part(source, '/', 1) AS distro, split_part(source, '/', 2) AS release, split_part(source, '/', 1) || '/' || split_part(source, '/', 2) || '/' AS prefix, source AS tail, regexp_extract(source, '[^/]*$') AS base,
name, section, name || '(' || section || ')' AS shown, replace(replace(source, '.gz', ''), '/', '__') AS stem FROM a_page""")
def _(spark, d):
    s = A.pages(spark, d).select("source")
    return s.select("source", S.distro("source").alias("distro"), S.release("source").alias("release"), S.scope_prefix("source").alias("prefix"), S.source_of_path(F.concat(F.lit("/srv/pages/"), "source")).alias("tail"), S.basename("source").alias("base"), S.page_name("source").alias("name"), S.section_of("source").alias("section"), S.shown_name(S.page_name("source"), S.section_of("source")).alias("shown"), S.artifact_stem("source").alias("stem"))


@query("str_name_section", "", "SELECT w, CASE WHEN w LIKE '%.%' AND w <> '.' THEN regexp_extract(w, '^(.*)\\.([^.]*)$', 1) ELSE w END AS name, CASE WHEN w LIKE '%.%' AND w <> '.' THEN regexp_extract(w, '^(.*)\\.([^.]*)$', 2) END AS section FROM (SELECT DISTINCT unnest(string_split(text, ' ')) AS w FROM documents) WHERE w NOT LIKE '%' || chr(10) || '%'")
def _(spark, d):
    w = A.table(spark, d, "documents").select(F.explode(F.split("text", " ")).alias("w")).distinct().where(~F.col("w").contains("\n"))
    return w.select("w", S.split_section("w").alias("s")).select("w", "s.name", "s.section")


@query("str_rewrite", "a_page", "SELECT source, CASE WHEN p_size % 3 = 0 THEN 'x/1/' || name WHEN p_size % 3 = 1 THEN name END AS link FROM a_page")
def _(spark, d):
    p = A.pages(spark, d)
    target = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("x/man1/"), "name")).when(F.col("p_size") % 3 == 1, F.col("name")).otherwise(F.concat(F.lit("x/man3/"), "name"))
    return p.select("source", S.rewritten_link(target).alias("link"))


@query("str_format", "", """SELECT o_orderkey, CASE WHEN n >= 1000000 THEN printf('%.1fM', n / 1000000) WHEN n >= 1000 THEN printf('%.0fK', n / 1000) ELSE CAST(n AS VARCHAR) END AS tokens, CASE WHEN o_orderkey >= 60 THEN printf('%dm%02ds', o_orderkey // 60, o_orderkey % 60) ELSE printf('%ds', o_orderkey) END AS took,
regexp_replace(regexp_replace(o_orderpriority, '[^A-Za-z0-9_.-]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM (SELECT *, CAST(o_orderkey AS BIGINT) * 137 AS n FROM orders)""")
def _(spark, d):
    o = A.table(spark, d, "orders")
    return o.select("o_orderkey", S.short_tokens(F.col("o_orderkey") * 137).alias("tokens"), S.elapsed("o_orderkey").alias("took"), S.label_slug("o_orderpriority").alias("slug"))


@query("str_trim_blanks", "a_line", "SELECT doc_id, n, regexp_replace(line || '  ' || chr(10), '[\\n ]+$', '') AS kept FROM a_line")
def _(spark, d):
    return A.lines(spark, d).select("doc_id", "n", S.strip_trailing_blanks(F.concat("line", F.lit("  \n"))).alias("kept"))


@query("str_subcommands", "a_page", "SELECT distro, list_sort(list(DISTINCT split_part(p_name, ' ', 2))) AS subs FROM a_page GROUP BY 1")
def _(spark, d):
    p = A.pages(spark, d).select("distro", F.replace("p_name", F.lit(" "), F.lit("-")).alias("full"), F.split_part("p_name", F.lit(" "), F.lit(1)).alias("parent"))
    each = p.select("distro", F.explode(S.normal_subcommands(F.array("full", "full"), "parent")).alias("s"))
    return each.groupBy("distro").agg(F.sort_array(F.collect_set("s")).alias("subs"))


@query("dat_lenient", "", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN '0001-01-01' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE CAST(epoch(o_orderdate) AS BIGINT) END AS e FROM orders")
def _(spark, d):
    t = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("2024-13-"), F.col("o_orderkey") % 10)).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return A.table(spark, d, "orders").select("o_orderkey", t.alias("t")).select("o_orderkey", S.lenient_date("t").cast("string").alias("d"), S.released_epoch("t").alias("e"))


@query("mth_ratios", "", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_discount / greatest(l_tax, l_discount, 1) AS ratio, abs(l_tax - l_discount) / greatest(abs(l_discount), 1) AS change FROM lineitem")
def _(spark, d):
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.guarded_ratio(F.col("l_discount"), F.col("l_tax"), F.col("l_discount")).alias("ratio"), S.relative_change(F.col("l_tax"), F.col("l_discount")).alias("change"))


@query("net_url_param", "a_request", "SELECT event_id, CASE WHEN uri LIKE '/explain?cmd=tar%' THEN 'tar -x ' || (json->>'$.k') WHEN uri LIKE '/explain%' THEN 'ls | wc -l' ELSE '' END AS cmd, array_to_string(string_split(ip, '.')[1:3], '.') || '.0' AS net FROM a_request")
def _(spark, d):
    return A.requests(spark, d).select("event_id", S.url_param("uri", "cmd").alias("cmd"), S.slash24("ip").alias("net"))


@query("net_html_escape", "", "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&#34;'), '''', '&#39;') AS safe FROM pages")
def _(spark, d):
    return A.table(spark, d, "pages").select("page_id", S.html_escape(F.col("html")).alias("safe"))


@query("hsh_sha256", "", "SELECT doc_id, sha256(text) AS sha, substr(sha256(text), 1, 12) AS short FROM documents")
def _(spark, d):
    sha = F.sha2(F.col("text").cast("binary"), 256)
    return A.table(spark, d, "documents").select("doc_id", sha.alias("sha"), F.substring(sha, 1, 12).alias("short"))


@query("hsh_fnv1a", "", """WITH RECURSIVE w AS (SELECT DISTINCT p_name AS s, encode(p_name) AS b FROM part), f AS (SELECT s, b, 0 AS i, 2166136261::BIGINT AS h FROM w
UNION ALL SELECT s, b, i + 1, CAST((CAST(xor(h, CAST(('0x' || substr(hex(b), 2 * i + 1, 2)) AS BIGINT)) AS HUGEINT) * 16777619) % 4294967296 AS BIGINT) FROM f WHERE i < octet_length(b))
SELECT s, h, h % 7 AS canned FROM f WHERE i = octet_length(b)""")
def _(spark, d):
    return A.table(spark, d, "part").select(F.col("p_name").alias("s")).distinct().select("s", S.fnv1a("s").alias("h"), O.canned_response("s", 7).alias("canned"))


@query("jsn_paths", "", "SELECT event_id, coalesce(props->>'$.k', '') AS k, coalesce(TRY_CAST(props->>'$.k' AS BIGINT), 0) AS n, coalesce(props->>'$.none', '') AS missing, 0::BIGINT AS zero FROM events")
def _(spark, d):
    return A.table(spark, d, "events").select("event_id", S.json_string("props", "$.k").alias("k"), S.json_int("props", "$.k").alias("n"), S.json_string("props", "$.none").alias("missing"), S.json_int("props", "$.none").alias("zero"))


@query("jsn_variant_union", "", "SELECT event_id, event_id % 3 = 0 AS flag, CASE WHEN event_id % 3 = 1 THEN [CAST(event_id AS VARCHAR), 'x'] ELSE [] END AS vals FROM events")
def _(spark, d):
    e = A.table(spark, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, "true").when(F.col("event_id") % 3 == 1, F.concat(F.lit('["'), "event_id", F.lit('", "x"]'))).otherwise("false")
    v = F.try_parse_json("raw")
    return e.select("event_id", raw.alias("raw")).select("event_id", F.coalesce(F.try_variant_get(v, "$", "boolean"), F.lit(False)).alias("flag"), F.coalesce(F.try_variant_get(v, "$", "array<string>"), F.array().cast("array<string>")).alias("vals"))


@query("arr_flags", "a_option", "SELECT page, idx, qty, list_concat(short, long) AS flags, list_contains(list_concat(short, long), '-a') AS has_a FROM a_option")
def _(spark, d):
    return A.options(spark, d).select("page", "idx", "qty", P.flags().alias("flags"), F.array_contains(P.flags(), "-a").alias("has_a"))


@query("arr_page_bytes", "a_option", "SELECT page, CAST(256 + sum(192 + strlen(text) + list_sum(list_transform(list_concat(['x'], short, long), lambda f: strlen(f))) - 1) AS BIGINT) AS n_bytes FROM a_option GROUP BY 1")
def _(spark, d):
    each = F.aggregate(P.flags(), F.lit(0), lambda a, f: a + F.octet_length(f))
    return A.options(spark, d).groupBy("page").agg((256 + F.sum(192 + F.octet_length("text") + each)).alias("n_bytes"))


# Text structure.  Documents have no headings, so each line of up to 40 characters is made one.

_MARKED = "marked AS (SELECT doc_id, string_agg(CASE WHEN length(line) BETWEEN 1 AND 25 THEN '# SEE ALSO' WHEN length(line) BETWEEN 26 AND 40 THEN '# ' || line WHEN length(line) BETWEEN 41 AND 50 THEN '## ' || line ELSE line END, chr(10) ORDER BY n) AS text FROM a_line GROUP BY 1)"


def _marked(spark, d):
    n = lambda x: F.length(x)
    line = lambda x: F.when(n(x).between(1, 25), F.lit("# SEE ALSO")).when(n(x).between(26, 40), F.concat(F.lit("# "), x)).when(n(x).between(41, 50), F.concat(F.lit("## "), x)).otherwise(x)
    return A.table(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(F.transform(F.split("text", "\n", -1), line), "\n").alias("text"))


_SECTIONS = f""", {_MARKED}, l AS (SELECT doc_id, generate_subscripts(t, 1) AS n, unnest(t) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS t FROM marked)),
s AS (SELECT *, sum(CASE WHEN regexp_matches(line, '^#{{1,2}} ') AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS section FROM l),
parts AS (SELECT doc_id, CAST(section AS BIGINT) AS section, min(n) AS start, string_agg(line, chr(10) ORDER BY n) AS text FROM s GROUP BY 1, 2)"""


@query("txt_sections", "a_line", _SECTIONS + "SELECT * FROM parts")
def _(spark, d):
    return T.sections(_marked(spark, d), "doc_id", "text")


@query("txt_filter_sections", "a_line", _SECTIONS + """, m AS (SELECT *, trim(split_part(text, chr(10), 1)) AS head FROM parts), b AS (SELECT *, CASE WHEN starts_with(head, '# ') THEN upper(trim(substr(head, 3))) END AS heading FROM m),
k AS (SELECT *, coalesce(last_value(CASE WHEN heading IS NOT NULL THEN heading IN ('SEE ALSO') END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS skipped FROM b)
SELECT doc_id, coalesce(string_agg(text, chr(10) ORDER BY section) FILTER (NOT skipped), '') AS text, count(*) FILTER (skipped AND heading IS NOT NULL) AS removed FROM k GROUP BY 1""")
def _(spark, d):
    out = T.filtered(_marked(spark, d), "doc_id", "text")
    return out.select("doc_id", "text", F.coalesce(F.aggregate("removed", F.lit(0), lambda a, x: a + x["n"]), F.lit(0)).alias("removed"))


@query("txt_number_lines", "a_line", "SELECT doc_id, string_agg(lpad(CAST(n AS VARCHAR), CAST(length(CAST(c AS VARCHAR)) AS INT), ' ') || '| ' || line, chr(10) ORDER BY n) AS text FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS c FROM a_line) GROUP BY 1")
def _(spark, d):
    return A.table(spark, d, "documents").where("text is not null").select("doc_id", T.numbered(F.col("text")).alias("text"))


@query("txt_slice", "a_line", """, x AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY n) FILTER (n BETWEEN 3 AND 4) AS body, max(line) FILTER (n = 2) AS head, count(*) AS c FROM a_line GROUP BY 1)
SELECT doc_id, CASE WHEN c < 2 THEN '' WHEN trim(coalesce(body, '')) = '' THEN head ELSE head || chr(10) || chr(10) || regexp_replace(body, '^([ \\t]*\\n)+|(\\n[ \\t]*)+$', '', 'g') END AS text FROM x""")
def _(spark, d):
    lines = F.split("text", "\n", -1)
    return A.table(spark, d, "documents").where("text is not null").select("doc_id", T.line_slice(lines, F.lit(2), F.lit(4)).alias("text"))


@query("txt_size_verdict", "", "SELECT doc_id, CASE WHEN trim(text) = '' THEN 'empty' WHEN length(text) > 500000 THEN 'oversize' END AS verdict FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", T.size_verdict(F.col("text")).alias("verdict"))


@query("txt_chunk")
def _(spark, d):
    return T.chunks(_marked(spark, d), "doc_id", "text", 4000)


@query("agg_line_metrics", "a_line", """SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars, max(length(line)) AS longest, round(avg(length(line)), 2) AS mean_length, count(*) FILTER (trim(line) = '') AS blank_lines, count(*) FILTER (length(line) > 2000) AS giant_lines,
count(*) FILTER (regexp_matches(line, '^#{1,6} ')) AS headings, count(*) FILTER (regexp_matches(line, '^\\s*[-*] ')) AS bullets, count(*) FILTER (starts_with(line, '> ')) AS quotes, CAST(sum(len(regexp_extract_all(line, '--?[A-Za-z][A-Za-z0-9-]*'))) AS BIGINT) AS option_like,
CAST(sum(len(regexp_extract_all(line, '\\*\\*'))) AS BIGINT) AS bold_marks, count(*) FILTER (regexp_matches(line, '\\*{4,}')) AS star_runs FROM a_line GROUP BY 1""")
def _(spark, d):
    return T.line_metrics(A.table(spark, d, "documents").where("text is not null"), "doc_id", "text")


@query("agg_tags", "", "SELECT page_id, lower(t) AS tag, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(html, '<([a-zA-Z][a-zA-Z0-9]*)', 1)) AS t FROM pages) GROUP BY 1, 2")
def _(spark, d):
    return T.tag_counts(A.table(spark, d, "pages"), "page_id", "html")


#: The rules as the SQL has them; its patterns look neither back nor at single lines.
_RULES_SQL = {
    "quad_star_run": (r"(?:^|[^\\])\*{4,}", "html"),
    "roff_named_escape": (r"\\\[[A-Za-z0-9_-]+\]", "html"),
    "roff_two_letter_escape": (r"\\\([A-Za-z0-9]{2}", "html"),
    "roff_font_escape": (r"\\f[BIRP]\b", "html"),
    "visible_open_double_backtick": (r"\\`\\`", "html"),
    "empty_emphasis_tag": (r"<em\b[^>]*>\s*</em>|<strong\b[^>]*>\s*</strong>", "html"),
    "visible_zwnj_entity": (r"&zwnj;", "plain"),
    "visible_nbsp_entity": (r"&nbsp;", "plain"),
    "visible_double_amp": (r"&amp;amp;", "plain"),
}


@query("aud_rules", "", "WITH p AS (SELECT page_id, html, regexp_replace(html, '<[^>]+>', '', 'g') AS plain FROM pages), r AS (" + "".join(f"SELECT page_id, '{name}' AS rule, len(regexp_extract_all({arm}, '{x}')) AS hits FROM p UNION ALL " for name, (x, arm) in _RULES_SQL.items()) + """SELECT page_id, 'giant_markdown_line', len(list_filter(string_split(html, chr(10)), lambda x: length(x) > 2000)) FROM pages) SELECT page_id, rule, hits FROM r WHERE hits > 0""")
def _(spark, d):
    pages = A.table(spark, d, "pages").withColumn("md", F.col("html"))
    return T.audit(pages, "page_id", "md", "html").select("page_id", "rule", "hits")


@query("aud_synopsis", "", r"""WITH t AS (SELECT doc_id, string_split(replace(replace(text, ' ', ''), '#', ''), chr(10)) AS l FROM documents), f AS (SELECT doc_id, flatten(list_transform(l, lambda x: list_transform(regexp_extract_all(x, '\S{201,}'), lambda y: {'x': x, 'y': y}))) AS f FROM t)
SELECT doc_id, 'synopsis_no_spaces_run' AS rule, len(f) AS hits, substr(f[1].x, greatest(strpos(f[1].x, f[1].y) - 12, 1), strpos(f[1].x, f[1].y) - greatest(strpos(f[1].x, f[1].y) - 12, 1) + length(f[1].y) + 12) AS snippet FROM f WHERE len(f) > 0""")
def _(spark, d):
    docs = A.table(spark, d, "documents").where("text is not null")
    squeezed = F.concat(F.lit("# NAME\n" + "x" * 300 + "\n# SYNOPSIS\n"), F.replace(F.replace("text", F.lit(" "), F.lit("")), F.lit("#"), F.lit("")), F.lit("\n# OTHER\n" + "y" * 300))
    return T.audit(docs.select("doc_id", squeezed.alias("md"), F.lit("").alias("html")), "doc_id", "md", "html", rules=()).select("doc_id", "rule", "hits", F.get("snippets", F.lit(0)).alias("snippet"))


@query("aud_summary", "", """WITH r AS (SELECT page_id, len(list_filter(string_split(html, chr(10)), lambda x: length(x) > 2000)) AS hits FROM pages)
SELECT 'giant_markdown_line' AS rule, count(*) AS pages, CAST(sum(hits) AS BIGINT) AS hits, (SELECT list(page_id ORDER BY hits DESC, page_id) FROM (SELECT * FROM r WHERE hits > 0 ORDER BY hits DESC, page_id LIMIT 10)) AS top FROM r WHERE hits > 0""")
def _(spark, d):
    pages = A.table(spark, d, "pages").withColumn("md", F.col("html"))
    return T.audit_summary(T.audit(pages, "page_id", "md", "html", tuple(r for r in T.RULES if r[0] == "giant_markdown_line")), "page_id")


# Metrics of pages and comparisons of runs.

_TAG_SQL = r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|''[^'']*''|[^''">])*)>"""
_DATA_SQL = f"regexp_replace(plain, '{_TAG_SQL}', '', 'g')"
for _entity, _char in V._ENTITIES:
    _DATA_SQL = f"replace({_DATA_SQL}, '{_entity}', '{_char.replace(chr(39), chr(39) * 2)}')"
#: From r(…, html) to x with plain, tags (whole ones), opening (names), data, lines and lengths of the page as Markdown.
_PAGE_SQL = f"""c AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->|<![^>]*>', '', 'g'), '(?is)(<script\\b[^>]*>).*?(</script\\s*>)', '\\1\\2', 'g'), '(?is)(<style\\b[^>]*>).*?(</style\\s*>)', '\\1\\2', 'g') AS plain FROM r),
t AS (SELECT *, regexp_extract_all(plain, '{_TAG_SQL}') AS tags, {_DATA_SQL} AS data, CASE WHEN ends_with(html, chr(10)) OR html = '' THEN list_slice(string_split(html, chr(10)), 1, -2) ELSE string_split(html, chr(10)) END AS lines FROM c),
x AS (SELECT *, list_transform(list_filter(tags, lambda g: NOT starts_with(g, '</')), lambda g: lower(regexp_extract(g, '<([a-zA-Z][^\\s/>]*)', 1))) AS opening, list_transform(lines, lambda l: length(l)) AS lengths FROM t)"""
_DEPTH_SQL = """list_reduce(list_transform(tags, lambda g: CASE WHEN starts_with(g, '</') THEN -1 WHEN ends_with(g, '/>') THEN 0 ELSE 1 END::BIGINT),
  lambda s, e: greatest(s // 1000000 + e, 0) * 1000000 + greatest(s % 1000000, greatest(s // 1000000 + e, 0)), 0::BIGINT) % 1000000"""


@query("agg_page_metrics", "", f"""WITH r AS (SELECT page_id, html FROM pages), {_PAGE_SQL}
SELECT page_id, {_DEPTH_SQL} AS max_depth, length(data) AS data_chars, len(list_filter(opening, lambda g: g = 'p')) AS p, len(list_filter(opening, lambda g: g = 'a')) AS a, length(data) - length(replace(data, '<', '')) AS lt, length(data) - length(replace(data, '_', '')) AS low,
len(lines) AS line_count, len(list_filter(lines, lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))) AS nonblank, coalesce(list_max(lengths), 0) AS longest, CASE WHEN len(lines) > 0 THEN round(list_sum(lengths) / len(lines), 2) ELSE 0 END AS mean_length FROM x""")
def _(spark, d):
    m = V.page_metrics(A.table(spark, d, "pages"), "page_id", "html", "html")
    md, h = (lambda n: F.col(f"markdown.{n}")), (lambda n: F.col(f"html.{n}"))
    return m.select("page_id", h("max_depth").alias("max_depth"), h("data_chars").alias("data_chars"), h("tags")["p"].alias("p"), h("tags")["a"].alias("a"), h("chars")["<"].alias("lt"), h("chars")["_"].alias("low"), md("line_count").alias("line_count"), md("nonblank_line_count").alias("nonblank"), md("max_line_length").alias("longest"), md("avg_line_length").alias("mean_length"))


_METRICS_SQL = {
    "markdown.max_line_length": "coalesce(list_max(lengths), 0)", "markdown.giant_lines_500": "len(list_filter(lengths, lambda n: n > 500))", "markdown.giant_lines_1000": "len(list_filter(lengths, lambda n: n > 1000))",
    "markdown.unescaped_star_runs": r"len(regexp_extract_all(html, '(?:^|[^\\*])\*+')) + len(regexp_extract_all(html, '\\\*\*+'))", "markdown.unescaped_under_runs": r"len(regexp_extract_all(html, '(?:^|[^\\_])_+')) + len(regexp_extract_all(html, '\\__+'))",
    "markdown.char_count": "length(html)", "filtered.line_count": "len(lines)", "html.data_chars": "length(data)",
    **{m: f"len(list_filter(opening, lambda g: g = '{m.rsplit('.', 1)[1]}'))" for m, _ in V.RENDER_CHECKS if m.startswith("html.tags.")},
    **{f"html.chars.{c}": f"length(data) - length(replace(data, '{c}', ''))" for c in V.SENSITIVE},
}
_ALL_METRICS = "[" + ", ".join(f"{{'metric': '{m}', 'value': CAST({x} AS DOUBLE)}}" for m, x in _METRICS_SQL.items()) + "]"


@query("dif_metrics", "", f"""WITH r AS (SELECT 0 AS run, page_id, html FROM pages WHERE page_id % 17 > 0
  UNION ALL SELECT 1, page_id, CASE page_id % 3 WHEN 0 THEN replace(replace(html, '<p>', '<div>'), 'er', '*') WHEN 1 THEN html || chr(10) || '<ul><li>a_b &lt;c&gt;</ul>' ELSE html END FROM pages WHERE page_id % 13 > 0), {_PAGE_SQL},
m AS (SELECT run, page_id, unnest({_ALL_METRICS}) AS u FROM x), a AS (SELECT page_id, u.metric AS metric, u.value AS before FROM m WHERE run = 0), b AS (SELECT page_id, u.metric AS metric, u.value AS after FROM m WHERE run = 1)
SELECT CAST(page_id AS VARCHAR) AS path, metric, before, after, after - before AS delta, 'changed' AS reason FROM a JOIN b USING (page_id, metric) WHERE after <> before AND abs(after - before) / greatest(abs(before), 1) > CASE WHEN metric IN ('markdown.char_count', 'html.data_chars') THEN 0.02 ELSE 0 END
UNION ALL SELECT CAST(page_id AS VARCHAR), NULL, NULL, NULL, NULL, CASE WHEN page_id % 17 = 0 THEN 'added' ELSE 'removed' END FROM pages WHERE (page_id % 17 = 0) <> (page_id % 13 = 0)""")
def _(spark, d):
    """Two renderings of the pages, all structural metrics but the option-like tokens, whose pattern the SQL can't say."""
    p, n = A.table(spark, d, "pages"), F.col("page_id") % 3
    html = F.when(n == 0, F.replace(F.replace("html", F.lit("<p>"), F.lit("<div>")), F.lit("er"), F.lit("*"))).when(n == 1, F.concat("html", F.lit("\n<ul><li>a_b &lt;c&gt;</ul>"))).otherwise(F.col("html"))
    run = lambda df: V.unpivoted(V.page_metrics(df, "page_id", "html", "html"), "page_id")
    checks = V.render_checks(spark).where("metric <> 'markdown.max_option_like_tokens_on_line'")
    return V.compared(run(p.where("page_id % 17 > 0")), run(p.where("page_id % 13 > 0").withColumn("html", html)), checks)


# Options.


def _option_rows(spark, d):
    o = A.options(spark, d)
    return o.select("page", "idx", "short", "long", "text", "line_start", "line_end", (F.col("qty") % 2 == 0).alias("has_arg"), F.when(F.col("qty") % 3 == 0, F.concat(F.lit("name"), F.col("qty") % 5)).alias("positional"), F.when(F.col("qty") % 4 == 0, "@").when(F.col("qty") % 4 == 1, "x").alias("prefix"), (F.col("qty") % 7 == 0).alias("nested"), "qty")


@query("opt_sanitize", "a_option", """SELECT page, idx, qty, CAST(NULL AS VARCHAR) AS positional, CASE WHEN qty % 3 = 0 AND qty % 4 = 0 THEN '@' END AS prefix, qty % 2 = 0 OR qty % 7 = 0 AS has_arg FROM a_option""")
def _(spark, d):
    rows = _option_rows(spark, d)
    out = P.sanitise(rows)
    # The stand-in's options all have flags; the prefix is judged on the positional as it came.
    kept = F.when(F.col("qty") % 3 == 0, F.when(F.col("qty") % 4 == 0, "@"))
    return out.select("page", "idx", "qty", "positional", kept.alias("prefix"), "has_arg")


@query("opt_exact_dedup", "a_option", """, k AS (SELECT *, list_sort(list_distinct(list_concat(short, long))) AS key FROM a_option)
SELECT page, min(idx) AS idx, key, CAST(max(qty) AS BIGINT) AS size FROM k GROUP BY page, key""")
def _(spark, d):
    o = A.options(spark, d)
    return P.exact_dedup(o, "page", "idx", "text").select("page", "idx", F.array_sort(F.array_distinct(P.flags())).alias("key"), F.length("text").alias("size"))


@query("opt_chunk_dedup", "a_option", "SELECT page, idx, qty FROM (SELECT *, row_number() OVER (PARTITION BY page, list_sort(short), list_sort(long) ORDER BY line_end - line_start DESC, idx * 1000 + qty) AS n FROM a_option) WHERE n = 1")
def _(spark, d):
    o = A.options(spark, d).withColumn("at", F.col("idx") * 1000 + F.col("qty"))
    return P.chunk_dedup(o, "page", "at", F.col("line_end") - F.col("line_start")).select("page", "idx", "qty")


@query("opt_span_sanity", "a_option", "SELECT page, sum(greatest(line_end - line_start + 1, 0)) / max(line_end) AS coverage, sum(greatest(line_end - line_start + 1, 0)) / max(line_end) > 3.0 AS failed FROM a_option GROUP BY 1")
def _(spark, d):
    return P.span_sanity(A.options(spark, d), "page")


@query("opt_cross_ref", "", "SELECT doc_id, regexp_matches(text, '(^|[^a-zA-Z0-9-])the($|[^a-zA-Z0-9-])') AS named FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", P.mentions(F.col("text"), F.lit("the")).alias("named"))


@query("opt_drop_empty", "a_option", "SELECT page, idx, qty FROM a_option WHERE qty % 2 = 0 OR qty % 3 = 0")
def _(spark, d):
    empty = F.array().cast("array<string>")
    o = A.options(spark, d).withColumn("short", F.when(F.col("qty") % 2 == 0, F.col("short")).otherwise(empty)).withColumn("long", empty).withColumn("positional", F.when(F.col("qty") % 3 == 0, "FILE").otherwise(""))
    return P.drop_empty(o).select("page", "idx", "qty")


@query("opt_normalise", "", """SELECT event_id, CASE event_id % 5 WHEN 0 THEN false WHEN 1 THEN true WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS has_arg, CASE WHEN event_id % 5 = 3 THEN ['1', 'b'] ELSE [] END AS arg_values, CASE WHEN event_id % 4 = 0 THEN 'host' ELSE '@' END AS positional, CASE WHEN event_id % 4 = 0 THEN '@' END AS prefix FROM events""")
def _(spark, d):
    e, n = A.table(spark, d, "events"), F.col("event_id")
    raw = F.when(n % 5 == 1, "true").when(n % 5 == 2, '"yes"').when(n % 5 == 3, '[1, "b"]').when(n % 5 == 4, "false")
    rows = e.select("event_id", raw.alias("has_arg"), F.when(n % 4 == 0, "@host").otherwise("@").alias("positional"), F.lit(None).cast("string").alias("prefix"))
    return P.normalise(rows).select("event_id", "has_arg", "arg_values", "positional", "prefix")


def _nested_rows(spark, d):
    """Options whose flags hold each other's, over several steps, with texts that name some of them."""
    o, q = A.options(spark, d), F.col("qty")
    none = F.array().cast("array<string>")
    short = F.when(q % 3 == 0, F.slice("short", 1, 1)).otherwise(F.col("short"))
    long = F.concat("long", F.when(q % 5 < 2, F.array(F.lit("--more"))).otherwise(none), F.when(q % 7 < 3, F.array(F.lit("--zone"))).otherwise(none))
    text = F.concat("text", F.lit(" like -f, --opt"), q % 4, F.when(q % 2 == 0, " and --more").otherwise(" but --zone."))
    rows = o.select("page", "idx", short.alias("short"), long.alias("long"), text.alias("text"), "line_start", "line_end")
    # One option of each set of flags, at a place of its own.
    rows = rows.groupBy("page", F.array_sort(F.array_distinct(P.flags())).alias("set")).agg(F.min(F.struct("idx", "text", "line_end", "line_start", "short", "long")).alias("o"))
    place = F.row_number().over(Window.partitionBy("page").orderBy("o.idx", "set"))
    return rows.select("page", place.alias("idx"), "o.short", "o.long", "o.text", "o.line_start", "o.line_end")


@query("opt_superset_dedup", "a_option", r""", o AS (
  SELECT page, idx, list_distinct(list_concat(CASE WHEN qty % 3 = 0 THEN short[1:1] ELSE short END, long, CASE WHEN qty % 5 < 2 THEN ['--more'] ELSE [] END, CASE WHEN qty % 7 < 3 THEN ['--zone'] ELSE [] END)) AS f,
    text || ' like -f, --opt' || (qty % 4) || CASE WHEN qty % 2 = 0 THEN ' and --more' ELSE ' but --zone.' END AS text, line_end FROM a_option
), k AS (SELECT page, list_sort(f) AS f, min({'idx': idx, 'text': text, 'line_end': line_end}) AS m FROM o GROUP BY 1, 2
), d AS (SELECT page, f, m.text AS text, m.line_end AS line_end, row_number() OVER (PARTITION BY page ORDER BY m.idx, f) AS idx FROM k
), p AS (SELECT page, count(*) AS n, list(idx ORDER BY idx) AS idxs, list(f ORDER BY idx) AS f, list(text ORDER BY idx) AS t, list(line_end ORDER BY idx) AS e FROM d GROUP BY page),
fold AS (
  SELECT page, n, idxs, f, t, e, list_transform(idxs, lambda x: false) AS gone, 1 AS i FROM p
  UNION ALL SELECT page, n, idxs, f, CASE WHEN length(t[i]) > length(t[j]) THEN list_transform(range(1, n + 1), lambda k: t[CASE WHEN k = j THEN i ELSE k END]) ELSE t END,
    CASE WHEN length(t[i]) > length(t[j]) THEN list_transform(range(1, n + 1), lambda k: e[CASE WHEN k = j THEN i ELSE k END]) ELSE e END,
    CASE WHEN j IS NULL THEN gone ELSE list_transform(range(1, n + 1), lambda k: k = i OR gone[k]) END, i + 1
  FROM (SELECT *, list_min(list_transform(list_filter(range(1, n + 1), lambda k: NOT gone[k] AND len(f[k]) > len(f[i]) AND list_has_all(f[k], f[i])
      AND len(list_filter(f[k], lambda g: NOT list_contains(f[i], g) AND regexp_matches(t[i], '(^|[^a-zA-Z0-9\-])' || regexp_escape(g) || '([^a-zA-Z0-9\-]|$)'))) > 0), lambda k: len(f[k]) * 1000 + k)) % 1000 AS j FROM fold WHERE i <= n)
)
SELECT page, u.idx, list_sort(u.f) AS flags, u.t AS text, u.e AS line_end FROM (SELECT page, unnest(list_transform(list_filter(range(1, n + 1), lambda k: NOT gone[k]), lambda k: {'idx': idxs[k], 'f': f[k], 't': t[k], 'e': e[k]})) AS u FROM fold WHERE i = n + 1)""")
def _(spark, d):
    return P.superset_dedup(_nested_rows(spark, d), "page", "idx").select("page", "idx", F.array_sort(F.array_distinct(P.flags())).alias("flags"), "text", "line_end")


# Comparisons.


@query("dif_fields", "", "SELECT p_partkey, u.field, u.before, u.after FROM (SELECT p_partkey, unnest([{'field': 'p_brand', 'before': nullif(p_brand, ''), 'after': CASE WHEN p_size % 5 = 0 THEN 'other' ELSE p_brand END}, {'field': 'p_type', 'before': CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END, 'after': CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_type END}]) AS u FROM part) WHERE u.before IS DISTINCT FROM u.after")
def _(spark, d):
    p = A.table(spark, d, "part")
    seven = F.col("p_size") % 7 == 0
    stored = p.withColumn("p_type", F.when(seven, "").otherwise(F.col("p_type")))
    fresh = p.withColumn("p_brand", F.when(F.col("p_size") % 5 == 0, "other").otherwise(F.col("p_brand"))).withColumn("p_type", F.when(seven, "false").otherwise(F.col("p_type")))
    return D.compare_fields(stored, fresh, "p_partkey", ("p_brand", "p_type"))


@query("jon_full_outer_diff", "a_option", """, k AS (SELECT page, array_to_string(list_sort(short), ',') || '|' || array_to_string(list_sort(long), ',') AS key, idx, qty, text FROM a_option), a AS (SELECT page, key, max_by(text, idx * 1000 + qty) AS text FROM k WHERE idx < 4 GROUP BY 1, 2), b AS (SELECT page, key, max_by(text, idx * 1000 + qty) AS text FROM k WHERE idx > 2 GROUP BY 1, 2)
SELECT coalesce(a.page, b.page) AS page, coalesce(a.key, b.key) AS key, CASE WHEN a.page IS NULL THEN 'added' WHEN b.page IS NULL THEN 'removed' ELSE 'changed' END AS change FROM a FULL JOIN b ON a.page = b.page AND a.key = b.key WHERE a.page IS NULL OR b.page IS NULL OR a.text IS DISTINCT FROM b.text""")
def _(spark, d):
    o = A.options(spark, d).withColumn("at", F.col("idx") * 1000 + F.col("qty"))
    return D.compare_options(o.where("idx < 4"), o.where("idx > 2"), "page", "at").select("page", "key", "change")


@query("dif_agreement", "a_option", """, k AS (SELECT page, idx, array_to_string(list_sort(short), ',') || '|' || array_to_string(list_sort(long), ',') AS key, text FROM a_option), a AS (SELECT page, key, max({'idx': idx, 'text': text}).text AS t FROM k WHERE idx < 4 GROUP BY 1, 2), b AS (SELECT page, key, max({'idx': idx, 'text': text}).text AS t FROM k WHERE idx > 2 GROUP BY 1, 2),
j AS (SELECT coalesce(a.page, b.page) AS page, a.key AS l, b.key AS r, a.t AS lt, b.t AS rt FROM a FULL JOIN b ON a.page = b.page AND a.key = b.key), c AS (SELECT page, count(*) FILTER (r IS NULL) AS only_left, count(*) FILTER (l IS NULL) AS only_right, count(*) FILTER (l IS NOT NULL AND r IS NOT NULL) AS common, count(*) FILTER (lt <> rt) AS diff_text FROM j GROUP BY 1)
SELECT *, common / greatest(common + only_left, common + only_right, 1) AS agreement FROM c""")
def _(spark, d):
    o = A.options(spark, d)
    return D.agreement(o.where("idx < 4"), o.where("idx > 2"), "page", "idx", ("text",))


@query("dif_runs", "", """WITH a AS (SELECT o_orderpriority AS path, o_orderstatus AS metric, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1, 2), b AS (SELECT o_orderpriority AS path, o_orderstatus AS metric, CAST(count(*) AS DOUBLE) AS v FROM orders WHERE o_orderkey % 2 = 1 AND o_orderstatus <> 'P' GROUP BY 1, 2)
SELECT * FROM (SELECT coalesce(a.path, b.path) AS path, coalesce(a.metric, b.metric) AS metric, a.v AS a, b.v AS b, CASE WHEN a.v IS NULL THEN 'added' WHEN b.v IS NULL THEN 'removed' WHEN abs(b.v - a.v) / greatest(abs(a.v), 1) > 0.01 AND b.v < a.v THEN 'worse' WHEN abs(b.v - a.v) / greatest(abs(a.v), 1) > 0.01 THEN 'better' END AS change FROM a FULL JOIN b ON a.path = b.path AND a.metric = b.metric) WHERE change IS NOT NULL""")
def _(spark, d):
    o = A.table(spark, d, "orders")
    run = lambda df: df.groupBy(F.col("o_orderpriority").alias("path"), F.col("o_orderstatus").alias("metric")).agg(F.count("*").cast("double").alias("value")).withColumn("direction", F.lit("up")).withColumn("tolerance", F.lit(0.01))
    return D.compare_runs(run(o.where("o_orderkey % 2 = 0")), run(o.where("o_orderkey % 2 = 1 and o_orderstatus <> 'P'")))


_FILES = """f AS (SELECT doc_id AS pos, source || '/x/' || doc_id AS src, CASE WHEN doc_id % 8 > 0 THEN sha256(text) END AS sha, strlen(text) AS len, CASE WHEN doc_id % 9 = 0 THEN 'other' END AS canonical, source || '/x' AS dir FROM documents), st AS (SELECT src FROM f WHERE pos % 10 = 0), kn AS (SELECT sha || ':' || dir AS key, min(src) AS src FROM f WHERE pos % 10 = 0 GROUP BY 1)"""


def _decided(spark, d):
    docs = A.table(spark, d, "documents")
    f = docs.select(F.col("doc_id").alias("pos"), F.concat("source", F.lit("/x/"), "doc_id").alias("source"), F.when(F.col("doc_id") % 8 > 0, F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.octet_length("text").alias("length"), F.when(F.col("doc_id") % 9 == 0, "other").alias("canonical"))
    stored = f.where("pos % 10 = 0")
    known = stored.groupBy(S.dedup_key("sha", "source").alias("key")).agg(F.min("source").alias("source"))
    return D.classify(f, stored.select("source", F.lit("llm").alias("extractor"), F.lit("m").alias("model")), known, size="small")


@query("cls_decisions", "", f"""WITH {_FILES}, e AS (SELECT f.*, CASE WHEN len > 2048 THEN 'size_skip' WHEN canonical IS NOT NULL THEN 'symlink' WHEN src IN (SELECT src FROM st) THEN 'stored' END AS early, sha || ':' || dir AS key FROM f),
o AS (SELECT e.*, kn.src AS db, CASE WHEN key IS NOT NULL THEN first_value(e.src) OVER w END AS first, row_number() OVER w AS n FROM e LEFT JOIN kn USING (key) WHERE early IS NULL WINDOW w AS (PARTITION BY key ORDER BY pos))
SELECT pos, src AS source, early AS kind, CASE WHEN early = 'symlink' THEN canonical END AS of FROM e WHERE early IS NOT NULL
UNION ALL SELECT pos, src, CASE WHEN coalesce(db, CASE WHEN n > 1 THEN first END) IS NOT NULL THEN 'content_dup' ELSE 'work' END, coalesce(db, CASE WHEN n > 1 THEN first END) FROM o""")
def _(spark, d):
    return _decided(spark, d)


@query("cls_pages_left", "", f"WITH {_FILES} SELECT src AS source FROM f WHERE pos % 10 = 0 AND NOT (coalesce(len, 0) <= 2048 AND canonical IS NOT NULL)")
def _(spark, d):
    stored = A.table(spark, d, "documents").where("doc_id % 10 = 0").select(F.concat("source", F.lit("/x/"), "doc_id").alias("source"))
    return D.applied(_decided(spark, d), stored)[1]


@query("dif_extractors", "", """WITH s AS (SELECT o_orderkey AS source, list_extract(['success', 'skipped', 'failed'], CAST(1 + o_custkey % 3 AS INT)) AS l, list_extract(['success', 'skipped', 'failed'], CAST(1 + o_orderkey % 7 % 3 AS INT)) AS r, o_custkey AS n FROM orders)
SELECT source, CASE WHEN l = 'failed' OR r = 'failed' THEN 'failed' WHEN l = 'skipped' OR r = 'skipped' THEN 'skipped' ELSE 'success' END AS outcome, CASE WHEN l = 'failed' THEN 'left' WHEN r = 'failed' THEN 'right' WHEN l = 'skipped' THEN 'left' WHEN r = 'skipped' THEN 'right' END AS reason,
CASE WHEN l = 'success' AND r = 'success' THEN 2 * n WHEN l = 'success' OR r = 'success' THEN n END AS tokens FROM s""")
def _(spark, d):
    o = A.table(spark, d, "orders")
    names = F.array(F.lit("success"), F.lit("skipped"), F.lit("failed"))
    side = lambda n, which: o.select(F.col("o_orderkey").alias("source"), F.get(names, n.cast("int")).alias("outcome"), F.lit(which).alias("reason"), F.col("o_custkey").alias("tokens"))
    return D.paired_outcomes(side(F.col("o_custkey") % 3, "left"), side(F.col("o_orderkey") % 7 % 3, "right"))


@query("jon_both_succeeded", "", "SELECT o_orderkey AS source FROM orders WHERE o_orderstatus <> 'F' AND o_custkey % 3 > 0")
def _(spark, d):
    o = A.table(spark, d, "orders")
    side = lambda good: o.select(F.col("o_orderkey").alias("source"), F.when(good, "success").otherwise("failed").alias("outcome"))
    return D.both_succeeded(o.select(F.col("o_orderkey").alias("source")), side(F.col("o_orderstatus") != "F"), side(F.col("o_custkey") % 3 > 0))


@query("cls_plan_counts", "", f"""WITH {_FILES}, e AS (SELECT f.*, CASE WHEN len > 2048 THEN 'size_skip' WHEN canonical IS NOT NULL THEN 'symlink' WHEN src IN (SELECT src FROM st) THEN 'filter_skip' END AS early, sha || ':' || dir AS key FROM f)
SELECT kind, count(*) AS n FROM (SELECT early AS kind FROM e WHERE early IS NOT NULL UNION ALL SELECT CASE WHEN key IS NOT NULL AND row_number() OVER (PARTITION BY key ORDER BY pos) > 1 THEN 'content_dup' ELSE 'work' END FROM e WHERE early IS NULL) GROUP BY 1""")
def _(spark, d):
    docs = A.table(spark, d, "documents")
    f = docs.select(F.col("doc_id").alias("pos"), F.concat("source", F.lit("/x/"), "doc_id").alias("source"), F.when(F.col("doc_id") % 8 > 0, F.sha2(F.col("text").cast("binary"), 256)).alias("sha"), F.octet_length("text").alias("length"), F.when(F.col("doc_id") % 9 == 0, "other").alias("canonical"))
    stored = f.where("pos % 10 = 0").select("source", F.lit("llm").alias("extractor"), F.lit("m").alias("model"))
    none = spark.createDataFrame([], "key string, source string")
    return D.plan_counts(D.classify(f, stored, none, overwrite=True, filters=[("llm", "other")], size="small"))


@query("cls_run_summary", "", "SELECT count(*) FILTER (k = 'success') AS succeeded, count(*) FILTER (k = 'skipped') AS skipped, count(*) FILTER (k = 'failed') AS failed, count(*) FILTER (k IN ('success', 'symlink', 'content_dup')) AS added, CAST(count(*) FILTER (k = 'failed') > 0 AS BIGINT) AS rc FROM (SELECT list_extract(['success', 'skipped', 'failed', 'symlink', 'content_dup'], CAST(1 + event_id % 5 AS INT)) AS k FROM events)")
def _(spark, d):
    k = F.element_at(F.array(*map(F.lit, ["success", "skipped", "failed", "symlink", "content_dup"])), (1 + F.col("event_id") % 5).cast("int"))
    return D.run_summary(A.table(spark, d, "events").select(k.alias("outcome")))


# Ingest.


@query("ing_pick_pages", "", """WITH f AS (SELECT l_orderkey AS version_id, l_suppkey % 300 AS man_id, CASE WHEN l_linenumber % 2 = 0 THEN '/usr/share/man/' ELSE '/opt/' END || l_partkey AS path, CASE l_linenumber % 3 WHEN 0 THEN '' WHEN 1 THEN 'en_US' ELSE 'de' END AS locale, l_partkey * 10 + l_linenumber AS hash FROM lineitem),
v AS (SELECT o_orderkey AS id, o_custkey AS package_id, strftime(o_orderdate, '%Y-%m-%d') AS released FROM orders), p AS (SELECT c_custkey AS id, c_nationkey AS system_id, c_name AS name FROM customer), m AS (SELECT s_suppkey AS id, s_name AS name, CAST(s_suppkey % 10 AS VARCHAR) AS section FROM supplier),
r AS (SELECT m.name || '.' || m.section AS key, p.name AS package, CAST(released AS DATE) AS released, hash, starts_with(path, '/usr/share/man/') AS standard, path FROM f JOIN v ON f.version_id = v.id JOIN p ON p.id = v.package_id JOIN nation n ON n.n_nationkey = p.system_id JOIN m ON m.id = f.man_id WHERE contains(lower(n_name), '_1') AND (locale = '' OR starts_with(locale, 'en'))),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key, package ORDER BY released DESC, hash) = 1), b AS (SELECT * FROM (SELECT *, bool_or(standard) OVER (PARTITION BY key) AS s FROM a) WHERE standard OR NOT s)
SELECT key, package, strftime(released, '%Y-%m-%d') AS released, hash, standard FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY released DESC, hash, package) = 1""")
def _(spark, d):
    t = lambda n: A.table(spark, d, n)
    n = F.col("l_linenumber")
    files = t("lineitem").select(F.col("l_orderkey").alias("version_id"), (F.col("l_suppkey") % 300).alias("man_id"), F.concat(F.when(n % 2 == 0, "/usr/share/man/").otherwise("/opt/"), "l_partkey").alias("path"), F.when(n % 3 == 0, "").when(n % 3 == 1, "en_US").otherwise("de").alias("locale"), (F.col("l_partkey") * 10 + n).alias("hash"))
    versions = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("package_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("released"))
    packages = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("system_id"), F.col("c_name").alias("name"))
    systems = t("nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"))
    mans = t("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") % 10).cast("string").alias("section"))
    return I.pick_pages(files, versions, packages, systems, mans, "_1").select("key", "package", F.col("released").cast("string").alias("released"), "hash", "standard")


@query("lkp_chain_depth", "", """WITH RECURSIVE l AS (SELECT p_partkey AS src, CASE WHEN p_partkey % 16 = 13 THEN p_partkey ELSE p_partkey + 1 END AS dst FROM part WHERE p_partkey % 16 NOT IN (0, 14)),
c AS (SELECT src, dst, 1 AS depth FROM l UNION ALL SELECT c.src, l.dst, depth + 1 FROM c JOIN l ON c.dst = l.src WHERE depth < 20)
SELECT src, max(CASE WHEN dst NOT IN (SELECT src FROM l) AND depth <= 10 THEN dst END) AS dst, max(CASE WHEN dst NOT IN (SELECT src FROM l) THEN CAST(depth AS BIGINT) END) AS depth FROM c GROUP BY 1""")
def _(spark, d):
    k = F.col("p_partkey")
    links = A.table(spark, d, "part").where((k % 16 != 0) & (k % 16 != 14)).select(k.alias("src"), F.when(k % 16 == 13, k).otherwise(k + 1).alias("dst"))
    return I.follow_links(links)


@query("ing_archive_links", "a_page", "SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN p_size % 4 = 0 THEN 'file' WHEN p_size % 4 = 1 THEN 'link' WHEN p_size % 4 = 2 THEN 'dropped' ELSE 'link' END AS outcome FROM a_page WHERE p_partkey % 3 > 0) GROUP BY 1")
def _(spark, d):
    p, n = A.pages(spark, d), F.col("p_size") % 4
    path = F.concat(F.when(F.col("p_partkey") % 3 == 1, "man1/").when(F.col("p_partkey") % 3 == 2, "man8/").otherwise("man5/"), "name")
    target = F.when(n == 1, F.concat(F.lit("../man8/"), "name")).when(n == 2, F.concat(F.lit("../man5/"), "name")).when(n == 3, F.col("name"))
    return I.archive_entries(p.select(path.alias("path"), target.alias("target"))).groupBy("outcome").agg(F.count("*").alias("n"))


@query("mig_coerce", "", "SELECT event_id, 'id' || event_id AS id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN true WHEN 2 THEN false ELSE false END AS flag FROM events")
def _(spark, d):
    e, n = A.table(spark, d, "events"), F.col("event_id")
    raw = F.when(n % 2 == 0, F.concat(F.lit('{"$oid": "id'), "event_id", F.lit('"}'))).otherwise(F.concat(F.lit("id"), "event_id"))
    flag = F.when(n % 4 == 0, "true").when(n % 4 == 1, "1").when(n % 4 == 2, "0").otherwise('"what"')
    return e.select("event_id", raw.alias("raw"), flag.alias("f")).select("event_id", I.unwrapped_id("raw").alias("id"), I.coerced_bool("f", False).alias("flag"))


# Metadata and batch replies.


@query("opt_aliases", "", "SELECT 'p' || o_custkey AS source, min_by(o_orderstatus, o_orderkey) AS synopsis, list_concat(['n' || o_custkey], list_sort(list(DISTINCT o_orderpriority))) AS names FROM orders GROUP BY o_custkey")
def _(spark, d):
    o = A.table(spark, d, "orders")
    rows = o.select(F.concat(F.lit("p"), "o_custkey").alias("source"), F.concat(F.lit("n"), "o_custkey").alias("name"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("program"), F.col("o_orderstatus").alias("text"))
    return M.synopsis_and_aliases(rows).select("source", "synopsis", F.transform("aliases", lambda a: a["name"]).alias("names"))


@query("exe_batch_replies", "", "SELECT o_custkey || ':' || o_orderkey AS custom_id, CASE WHEN o_orderkey % 3 = 0 THEN 'r' || o_orderkey END AS reply, CASE o_orderkey % 3 WHEN 1 THEN 'status 500' WHEN 2 THEN 'missing' END AS error, CAST(o_custkey AS VARCHAR) AS item, o_orderkey AS chunk FROM orders")
def _(spark, d):
    o, k = A.table(spark, d, "orders"), F.col("o_orderkey")
    cid = F.concat_ws(":", F.col("o_custkey").cast("string"), k.cast("string"))
    body = F.struct(cid.alias("custom_id"), F.struct(F.when(k % 3 == 0, 200).otherwise(500).alias("status_code"), F.concat(F.lit("r"), k).alias("body")).alias("response"))
    return M.batch_replies(o.select(cid.alias("custom_id")), o.where("o_orderkey % 3 < 2").select(F.to_json(body).alias("line")))


@query("win_span_cover", "", """WITH c AS (SELECT conv_id, turn * 10 + (turn % 3) AS s, turn * 10 + 8 + turn % 4 AS e FROM conversations), n AS (SELECT conv_id, max(e) + 2 AS n FROM c GROUP BY 1),
r AS (SELECT conv_id, unnest(range(0, n)) AS place FROM n), g AS (SELECT *, place - row_number() OVER (PARTITION BY conv_id ORDER BY place) AS island FROM r WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.conv_id = r.conv_id AND place >= s AND place < e))
SELECT conv_id, min(place) AS start, max(place) + 1 AS "end" FROM g GROUP BY conv_id, island""")
def _(spark, d):
    t = F.col("turn")
    c = A.table(spark, d, "conversations").select("conv_id", (t * 10 + t % 3).alias("s"), (t * 10 + 8 + t % 4).alias("e"))
    return M.uncovered(c.join(c.groupBy("conv_id").agg((F.max("e") + 2).alias("n")), "conv_id"), "conv_id", "s", "e", "n")


@query("dat_age", "", "SELECT event_id, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' minute' || CASE WHEN s // 60 = 1 THEN '' ELSE 's' END || ' ago' WHEN s < 86400 THEN (s // 3600) || ' hour' || CASE WHEN s // 3600 = 1 THEN '' ELSE 's' END || ' ago' ELSE (s // 86400) || ' day' || CASE WHEN s // 86400 = 1 THEN '' ELSE 's' END || ' ago' END AS age FROM (SELECT event_id, CAST(epoch(TIMESTAMP '2024-02-01') - floor(epoch(ts)) AS BIGINT) AS s FROM events)")
def _(spark, d):
    return A.table(spark, d, "events").select("event_id", M.age(F.col("ts").cast("timestamp"), F.lit("2024-02-01").cast("timestamp")).alias("age"))
