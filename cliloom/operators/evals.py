"""Metrics of rendered pages, and comparisons of two runs, in long form.

A run's pages are nested records; `unpivoted` turns them into rows of path, metric and value,
the metric being the dotted path of the field, so that one join of two runs compares every
field, and a table of directions and tolerances says which changes matter.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, MapType, NumericType, StructType

from . import texts as T

#: The elements and the characters that are counted.
TAGS = ("a", "b", "blockquote", "br", "code", "em", "h1", "h2", "h3", "h4", "h5", "h6", "i", "li", "ol", "p", "pre", "strong", "table", "tbody", "td", "th", "thead", "tr", "ul")
SENSITIVE = ("\\", "[", "]", "*", "_", "`", "<", ">")
#: Relative tolerances of the metrics whose changes are worth a look.
RENDER_CHECKS = (
    ("markdown.max_line_length", 0.0),
    ("markdown.giant_lines_500", 0.0),
    ("markdown.giant_lines_1000", 0.0),
    ("markdown.max_option_like_tokens_on_line", 0.0),
    ("markdown.unescaped_star_runs", 0.0),
    ("markdown.unescaped_under_runs", 0.0),
    ("markdown.char_count", 0.02),
    ("filtered.line_count", 0.0),
    ("html.tags.a", 0.0),
    ("html.tags.blockquote", 0.0),
    ("html.tags.br", 0.0),
    ("html.tags.code", 0.0),
    ("html.tags.em", 0.0),
    ("html.tags.h1", 0.0),
    ("html.tags.h2", 0.0),
    ("html.tags.h3", 0.0),
    ("html.tags.h4", 0.0),
    ("html.tags.h5", 0.0),
    ("html.tags.h6", 0.0),
    ("html.tags.li", 0.0),
    ("html.tags.pre", 0.0),
    ("html.tags.strong", 0.0),
    ("html.tags.tr", 0.0),
    ("html.tags.ul", 0.0),
    ("html.tags.ol", 0.0),
    ("html.tags.p", 0.0),
    ("html.data_chars", 0.02),
    ("html.chars.\\", 0.0),
    ("html.chars.[", 0.0),
    ("html.chars.]", 0.0),
    ("html.chars.*", 0.0),
    ("html.chars._", 0.0),
    ("html.chars.`", 0.0),
    ("html.chars.<", 0.0),
    ("html.chars.>", 0.0),
)
#: Patterns of what looks like an option, and of runs of stars and underscores that no backslash precedes; what most places fail by comes first.
OPTION_LIKE = r"(?=[-\\])(?<![\w\\])(?:\\?-{1,2}|\\\[mi\])[-A-Za-z0-9][-_A-Za-z0-9]*"
STAR_RUN, UNDER_RUN = r"\*(?<!\\\*)\**", r"_(?<!\\_)_*"

_TAG = r"""<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^'">])*)>"""
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is worked out once, however often and in whatever loops `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def html_metrics(html: Column, void: tuple[str, ...] = ()) -> Column:
    """Struct of tags (opening ones of `TAGS`), data_chars, max_depth and chars (`SENSITIVE` ones in the text).

    Depth rises with an opening tag and falls with a closing one, never below 0; a tag that
    closes itself, or one of `void`, doesn't count.  Text is what stands outside of tags,
    comments, scripts and styles, common entities read as the characters they mean.
    """
    plain = F.regexp_replace(html, r"(?s)<!(?:--.*?-->|[^>]*>)", "")
    plain = F.regexp_replace(plain, r"(?is)(<(script|style)\b[^>]*>).*?(</\2\s*>)", "$1$3")
    name = lambda t: F.lower(F.regexp_extract(t, r"^</?([a-zA-Z][^\s/>]*)", 1))
    level = lambda t: t.endswith("/>") | name(t).isin(*void) if void else t.endswith("/>")
    step = lambda t: F.when(t.startswith("</"), -1).when(level(t), 0).otherwise(1)
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("most"))

    def walk(state: Column, t: Column) -> Column:
        now = F.greatest(state["now"] + step(t), F.lit(0))
        return F.struct(now.alias("now"), F.greatest(state["most"], now).alias("most"))

    def counted(whole: Column, opening: Column, data: Column) -> Column:
        tags = F.map_from_arrays(F.lit(list(TAGS)), F.array(*(F.size(opening) - F.size(F.array_remove(opening, x)) for x in TAGS)))
        chars = F.map_from_arrays(F.lit(list(SENSITIVE)), F.array(*(F.length(data) - F.length(F.replace(data, F.lit(c), F.lit(""))) for c in SENSITIVE)))
        return F.struct(tags.alias("tags"), F.length(data).alias("data_chars"), F.aggregate(whole, start, walk)["most"].alias("max_depth"), chars.alias("chars"))

    def parsed(plain: Column) -> Column:
        data = reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), _ENTITIES, F.regexp_replace(plain, _TAG, ""))
        opening = lambda whole: F.transform(F.filter(whole, lambda t: ~t.startswith("</")), name)
        return _let(F.regexp_extract_all(plain, F.lit(_TAG), F.lit(0)), lambda whole: _let(opening(whole), lambda o: _let(data, lambda x: counted(whole, o, x))))

    return _let(plain, parsed)


def _shown_lines(text: Column) -> Column:
    """Lines without the empty one behind a last newline."""
    lines = F.split(text, "\n", -1)
    return F.when(F.element_at(lines, -1) == "", F.slice(lines, 1, F.size(lines) - 1)).otherwise(lines)


def markdown_metrics(markdown: Column) -> Column:
    """Struct of 12 counts over a text's lines."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)

    def counted(lines: Column, lengths: Column, likely: Column) -> Column:
        n = F.size(lines)
        return F.struct(
            n.alias("line_count"), F.size(F.filter(lines, lambda x: F.trim(F.translate(x, "\t\r\f\x0b", "    ")) != "")).alias("nonblank_line_count"), F.length(markdown).alias("char_count"), F.coalesce(F.array_max(lengths), F.lit(0)).alias("max_line_length"),
            F.when(n > 0, F.round(total(lengths) / n, 2)).otherwise(0.0).alias("avg_line_length"), F.size(F.filter(lengths, lambda x: x > 500)).alias("giant_lines_500"), F.size(F.filter(lengths, lambda x: x > 1000)).alias("giant_lines_1000"),
            total(likely).alias("option_like_tokens"), F.coalesce(F.array_max(likely), F.lit(0)).alias("max_option_like_tokens_on_line"), F.size(F.filter(likely, lambda x: x >= 2)).alias("lines_with_multiple_option_like_tokens"),
            F.regexp_count(markdown, F.lit(STAR_RUN)).alias("unescaped_star_runs"), F.regexp_count(markdown, F.lit(UNDER_RUN)).alias("unescaped_under_runs"),
        )

    likely = lambda lines: F.transform(lines, lambda x: F.regexp_count(x, F.lit(OPTION_LIKE)))
    return _let(_shown_lines(markdown), lambda lines: _let(F.transform(lines, F.length), lambda n: _let(likely(lines), lambda k: counted(lines, n, k))))


def page_metrics(pages: DataFrame, key: str, markdown: str, html: str) -> DataFrame:
    """key, markdown, html and filtered (the text without skipped sections: line_count, char_count, removed_sections)."""
    own = pages.select(key, F.coalesce(markdown, F.lit("")).alias("_md"), F.coalesce(html, F.lit("")).alias("_html"))
    rest = T.filtered(own, key, "_md").select(F.col(key).alias("_of"), F.struct(F.size(_shown_lines(F.col("text"))).alias("line_count"), F.length("text").alias("char_count"), F.map_from_entries("removed").alias("removed_sections")).alias("filtered"))
    out = own.select(key, markdown_metrics(F.col("_md")).alias("markdown"), html_metrics(F.col("_html")).alias("html"))
    return out.join(rest, F.col(key) == F.col("_of"), "left").drop("_of")


def _leaves(name: str, value: Column, kind) -> list[Column]:
    """Arrays of (metric, value, truth), one for each part of a record."""
    row = lambda m, v, t: F.struct(m.alias("metric"), v.cast("double").alias("value"), t.cast("boolean").alias("truth"))
    if isinstance(kind, StructType):
        return [x for f in kind for x in _leaves(f"{name}.{f.name}" if name else f.name, value[f.name], f.dataType)]
    if isinstance(kind, BooleanType):
        return [F.array(row(F.lit(name), F.lit(None), value))]
    if isinstance(kind, NumericType):
        return [F.array(row(F.lit(name), value, F.lit(None)))]
    if isinstance(kind, MapType) and isinstance(kind.valueType, NumericType):
        entries = F.coalesce(F.map_entries(value), F.array().cast(f"array<struct<key:string,value:{kind.valueType.simpleString()}>>"))
        return [F.transform(entries, lambda e: row(F.concat(F.lit(name + "."), e["key"]), e["value"], F.lit(None)))]
    return []


def unpivoted(pages: DataFrame, path: str) -> DataFrame:
    """path, metric (dotted), value (numbers) or truth (booleans) of all fields of nested records; other types have none."""
    fields = [f for f in pages.schema if f.name != path]
    every = [x for f in fields for x in _leaves(f.name, F.col(f"`{f.name}`"), f.dataType)]
    return pages.select(F.col(path).cast("string").alias("path"), F.inline(F.concat(*every)))


def compared(before: DataFrame, after: DataFrame, checks: DataFrame) -> DataFrame:
    """path, metric, before, after, delta, reason: of two runs in long form.

    checks: metric, tolerance, direction (null: any change, up or down: only one that way).  A metric that
    isn't there counts 0, a boolean false; a number matters beyond the tolerance, relative to what it was
    (1 at least); a boolean metric matters when it flips.  A page of one run only is `added` or `removed`.
    """
    # Each run is made once: its joined rows tell whether a page is in both, and one row stands for a page that isn't.
    side = lambda run, s: run.select("path", "metric", F.col("value").alias(f"{s}_value"), F.col("truth").alias(f"{s}_truth"), F.lit(True).alias(f"_{s}"))
    both = side(before, "a").join(side(after, "b"), ["path", "metric"], "full_outer").join(F.broadcast(checks.withColumn("_known", F.lit(True))), "metric", "left")
    w = Window.partitionBy("path", F.when(F.col("path").isNull(), F.col("_a").isNull()))
    both = both.withColumns({"_in_a": F.max("_a").over(w), "_in_b": F.max("_b").over(w), "_n": F.row_number().over(w.orderBy("metric"))})
    is_truth = F.col("a_truth").isNotNull() | F.col("b_truth").isNotNull()
    number = lambda s: F.when(is_truth, F.coalesce(f"{s}_truth", F.lit(False)).cast("double")).otherwise(F.coalesce(f"{s}_value", F.lit(0.0)))
    rows = both.withColumns({"before": number("a"), "after": number("b"), "_t": is_truth, "_apart": F.col("_in_a").isNull() | F.col("_in_b").isNull()})
    rows = rows.withColumn("delta", F.col("after") - F.col("before"))
    that_way = F.col("direction").isNull() | ((F.col("direction") == "up") & (F.col("delta") > 0)) | ((F.col("direction") == "down") & (F.col("delta") < 0))
    beyond = F.col("_t") | (F.abs("delta") / F.greatest(F.abs("before"), F.lit(1.0)) > F.col("tolerance"))
    found = rows.where(F.when(F.col("_apart"), F.col("_n") == 1).otherwise(F.col("_known") & (F.col("delta") != 0) & that_way & beyond))
    shown = lambda c: F.when(~F.col("_apart"), F.col(c)).alias(c)
    reason = F.when(F.col("_in_a").isNull(), "added").when(F.col("_in_b").isNull(), "removed").when(F.col("_t"), "flipped").otherwise("changed")
    return found.select("path", *map(shown, ("metric", "before", "after", "delta")), reason.alias("reason"))


def removed_sections_changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """path: pages of both runs whose removed sections, names or counts, aren't the same (metrics below filtered.removed_sections)."""
    own = lambda run: run.where(F.col("metric").startswith("filtered.removed_sections.")).select("path", "metric", "value")
    paths = before.select("path").distinct().join(after.select("path").distinct(), "path")
    apart = own(before).exceptAll(own(after)).unionByName(own(after).exceptAll(own(before))).select("path").distinct()
    return apart.join(paths, "path", "left_semi")


def totals(run: DataFrame) -> DataFrame:
    """metric, value: numbers added up over all pages, booleans counted."""
    return run.groupBy("metric").agg(F.sum(F.coalesce("value", F.col("truth").cast("double"))).alias("value"))


def total_checks(before: DataFrame, after: DataFrame, checks: DataFrame) -> DataFrame:
    """metric, before, after, delta of totals that changed the way that matters."""
    one = lambda run: totals(run).select(F.lit("all").alias("path"), "metric", "value", F.lit(None).cast("boolean").alias("truth"))
    return compared(one(before), one(after), checks.select("metric", F.lit(0.0).alias("tolerance"), "direction")).where("metric is not null").select("metric", "before", "after", "delta")


def render_checks(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(m, t, None) for m, t in RENDER_CHECKS], "metric string, tolerance double, direction string")


def read_run(spark: SparkSession, folder: str, path: str = "path") -> DataFrame:
    """A run written as JSON lines of nested records, in long form."""
    return unpivoted(spark.read.json(folder), path)


def compare_folders(spark: SparkSession, before: str, after: str, checks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages' changes, totals' changes) of two run folders."""
    a, b = read_run(spark, before), read_run(spark, after)
    checks = render_checks(spark) if checks is None else checks
    return compared(a, b, checks), total_checks(a, b, checks)
