"""Explains command lines with a catalog: one join for all names, then matching in Arrow batches."""

from __future__ import annotations

import html
from collections.abc import Iterator
from urllib.parse import quote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..shell.match import UnknownProgram, lookup_keys, match
from ..shell.parse import ParseError, Unsupported
from .catalog import find_pages

OPTION = "struct<text:string,short:array<string>,long:array<string>,has_arg:boolean,arg_values:array<string>,positional:string,prefix:string,nested:boolean,nested_end:array<string>>"
PAGE = f"struct<source:string,name:string,section:string,synopsis:string,dashless:boolean,subcommands:array<string>,nested:boolean,nested_end:array<string>,options:array<{OPTION}>>"
SPANS = "group_no int, group_name string, source string, start int, end int, text string, match string, kind string, error string"


def guarded(cmd: Column) -> Column:
    """Trimmed, at most 1000 characters; null where it is empty or holds a newline."""
    t = F.substring(F.trim(cmd), 1, 1000)
    return F.when((t != "") & ~t.contains("\n"), t)


@F.pandas_udf(ArrayType(StringType()))
def names_in(lines: pd.Series) -> pd.Series:
    return lines.map(lambda x: lookup_keys(x) if x else [])


def _page(row: dict) -> dict:
    ends = row.get("nested_end")
    options = [
        {"text": o["text"], "short": list(o["short"] if o["short"] is not None else []), "long": list(o["long"] if o["long"] is not None else []), "positional": o["positional"], "prefix": o["prefix"],
         "has_arg": list(o["arg_values"]) if o["arg_values"] is not None and len(o["arg_values"]) else bool(o["has_arg"]), "nested": list(o["nested_end"]) if o["nested_end"] is not None and len(o["nested_end"]) else bool(o["nested"])}
        for o in (row["options"] if row["options"] is not None else [])
    ]
    return {"source": row["source"], "synopsis": row["synopsis"], "dashless": row["dashless"], "subcommands": list(row["subcommands"] if row["subcommands"] is not None else []), "nested": list(ends) if ends is not None and len(ends) else bool(row["nested"]), "options": options}


def _explained(line: str, pages: dict[str, dict]) -> list[tuple]:
    nothing = lambda error: [(None, None, None, None, None, None, None, None, error)]
    try:
        m = match(line, pages.get)
    except ParseError as e:
        return nothing(f"parse: {e}")
    except Unsupported as e:
        return nothing(f"unsupported: {e}")
    except UnknownProgram as e:
        return nothing(f"unknown: {e}")
    out = [(n, g.name, g.page["source"] if g.page else None, a, b, t, line[a:b], k, g.error) for n, g in enumerate(m.groups) for a, b, t, k in g.spans]
    return out + [(-1, "expansion", None, a, b, None, line[a:b], k, None) for a, b, k in m.expansions]


def explain(commands: DataFrame, pages: DataFrame, mappings: DataFrame, distro: str | None = None, release: str | None = None, scope: Column | None = None) -> DataFrame:
    """commands: query_id, cmd; pages: the columns of PAGE.  A row for each span; group_no -1 are expansions, 0 the shell.

    `scope` is what the sources of a line's pages have to start with; null or empty: anything.
    Equal lines of one scope are explained once.  Whole pages are read for the
    winners alone, and travel once to each set of names that lines have.
    """
    within = F.coalesce(scope, F.lit("")) if scope is not None else F.lit("")
    asked = commands.select(F.col("query_id").cast("long").alias("query_id"), within.alias("scope"), guarded(F.col("cmd")).alias("line")).where("line is not null")
    lines = asked.select("scope", "line").distinct().withColumn("names", F.array_sort(F.array_distinct(names_in("line"))))
    keys = lines.select("scope", "names").distinct().withColumn("name", F.explode("names"))
    each = keys.select("scope", "name").distinct().withColumn("query_id", F.struct("scope", "name"))
    won = find_pages(each, pages, mappings, distro, release, "scope").where("rank = 1").select("query_id.scope", "query_id.name", "source")
    full = won.join(pages.select("source", F.struct(*(F.col(c) for c in ("source", "name", "section", "synopsis", "dashless", "subcommands", "nested", "nested_end", "options"))).cast(PAGE).alias("page")), "source").drop("source")
    held = keys.join(full, ["scope", "name"]).groupBy("scope", "names").agg(F.collect_list(F.struct("name", "page")).alias("pages"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows: list[tuple] = []
            for scope, line, found in zip(batch["scope"], batch["line"], batch["pages"], strict=True):
                rows += [(scope, line, *r) for r in _explained(line, {p["name"]: _page(p["page"]) for p in (found if found is not None else [])})]
            out = pd.DataFrame(rows, columns=["scope", "line", *(c.split()[0] for c in SPANS.split(", "))])
            for c in ("group_no", "start", "end"):
                out[c] = out[c].astype("Int32")
            yield out

    spans = lines.join(held, ["scope", "names"], "left").select("scope", "line", "pages").mapInPandas(run, "scope string, line string, " + SPANS)
    return asked.join(spans, ["scope", "line"]).drop("scope", "line")


def help_dictionary(spans: DataFrame) -> DataFrame:
    """Spans with help_id: texts numbered by first occurrence within a line, and `first`, where each text first stands."""
    first = F.min(F.struct("group_no", "start")).over(Window.partitionBy("query_id", "text"))
    rows = spans.where("group_no >= 0").withColumn("_f", F.when(F.col("text").isNotNull(), first))
    place = F.dense_rank().over(Window.partitionBy("query_id").orderBy(F.col("_f").asc_nulls_last())) - 1
    return rows.withColumn("help_id", F.when(F.col("_f").isNotNull(), place)).withColumn("first", F.col("_f.start")).drop("_f")


def with_spaces(spans: DataFrame) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy("start")
    return spans.where("group_no >= 0").withColumn("spaces", F.coalesce(F.lead("start").over(w) - F.col("end"), F.lit(0)))


def group_heads(spans: DataFrame) -> DataFrame:
    """The first span of each command."""
    w = Window.partitionBy("query_id", "group_no").orderBy("start")
    return spans.where("group_no > 0").withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def respelled(cmd: Column, start: Column, end: Column, name: Column, section: Column) -> Column:
    """The line with another section of its program, as a suggestion."""
    return F.concat(F.substr(cmd, F.lit(1), start), name, F.lit("."), section, F.substr(cmd, end + 1))


def markup(text: str, start: int, expansions: list[tuple[int, int, str]], link: str = "/explain?cmd=") -> str:
    """A span as HTML: escaped, blanks kept, expansions wrapped, substitutions linked."""
    show = lambda x: html.escape(x).replace(" ", "&nbsp;")
    out, at = [], 0
    for a, b, kind in sorted(expansions):
        a, b = a - start, b - start
        if a < at or b > len(text):
            continue
        inner = show(text[a:b])
        out += [show(text[at:a]), f'<a href="{link}{quote_plus(text[a:b])}">{inner}</a>' if kind == "substitution" else f'<span class="expansion-{kind}">{inner}</span>']
        at = b
    return "".join(out) + show(text[at:])
