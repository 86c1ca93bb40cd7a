"""Text structure of pages: sections, numbering, chunks, slices, line metrics and rendering rules."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sections that hardly ever document options.
SKIPPED = (
    "AUTHOR", "AUTHORS", "AVAILABILITY", "BUGS", "COLOPHON", "COPYING", "COPYRIGHT", "COPYRIGHT AND LICENSE", "ENVIRONMENT", "ENVIRONMENT VARIABLES", "EXIT STATUS", "HISTORY", "LICENSE",
    "REPORTING BUGS", "SEE ALSO", "VERSION",
)
#: Characters of a chunk, of a page, of the preamble; chunks of a page.
CHUNK, LONGEST, PREAMBLE, MOST_CHUNKS = 60_000, 500_000, 30_000, 16
CONTINUED = "[The page goes on; it began with:]\n\n"


def sections(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, section (from 0), start (line, from 1), text: parted at lines that begin with # or ##, but for a page's first line."""
    lines = pages.select(key, F.posexplode(F.split(text, "\n", -1)).alias("i", "line"))
    w = Window.partitionBy(key).orderBy("i")
    begins = (F.col("line").rlike("^#{1,2} ") & (F.col("i") > 0)).cast("int")
    numbered = lines.withColumn("_b", begins).withColumn("section", F.sum("_b").over(w))
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n")
    return numbered.groupBy(key, "section").agg((F.min("i") + 1).alias("start"), body.alias("text"))


def kept_sections(parts: DataFrame, key: str) -> DataFrame:
    """With `heading` (of top-level sections) and `skipped`: a skipped section takes those under it along."""
    first = F.trim(F.split_part("text", F.lit("\n"), F.lit(1)))
    top = first.startswith("# ")
    heading = F.when(top, F.upper(F.trim(F.substr(first, F.lit(3)))))
    bad = F.when(top, heading.isin(*SKIPPED))
    w = Window.partitionBy(key).orderBy("section").rowsBetween(Window.unboundedPreceding, 0)
    return parts.withColumn("heading", heading).withColumn("skipped", F.coalesce(F.last(bad, ignorenulls=True).over(w), F.lit(False)))


def filtered(pages: DataFrame, key: str, text: str) -> DataFrame:
    """key, text without skipped sections, removed (names and counts, in the order of names)."""
    marked = kept_sections(sections(pages, key, text), key)
    kept = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("skipped"), F.struct("section", "text")))), lambda x: x["text"]), "\n")
    names = F.sort_array(F.collect_list(F.when(F.col("skipped"), F.col("heading"))))
    out = marked.groupBy(key).agg(kept.alias("text"), names.alias("_n"))
    return out.withColumn("removed", F.transform(F.array_distinct("_n"), lambda x: F.struct(x.alias("heading"), F.size(F.filter("_n", lambda y: y == x)).alias("n")))).drop("_n")


def numbered(text: Column) -> Column:
    """Each line behind its number, right-aligned to the widest."""
    lines = F.split(text, "\n", -1)
    width = F.length(F.size(lines).cast("string"))
    return F.array_join(F.transform(lines, lambda x, i: F.concat(F.lpad((i + 1).cast("string"), width, F.lit(" ")), F.lit("| "), x)), "\n")


def line_slice(lines: Column, start: Column, end: Column) -> Column:
    """Lines start to end without quote marks: the first one, a blank line, then the others without blank ones at their edges."""
    n = F.size(lines)
    part = F.transform(F.when((start >= 1) & (end >= start), F.sequence(start, end)), lambda i: F.regexp_replace(F.coalesce(F.get(lines, i - 1), F.lit("")), "^> ?", ""))
    body = F.slice(part, 2, F.greatest(F.size(part), F.lit(1)))
    body = F.regexp_replace(F.array_join(body, "\n"), r"^(?:[ \t]*\n)+|(?:\n[ \t]*)+$", "")
    text = F.when(F.trim(body) == "", F.get(part, F.lit(0))).otherwise(F.concat(F.get(part, F.lit(0)), F.lit("\n\n"), body))
    return F.when((start < 1) | (end < start) | (start > n), "").otherwise(text)


def multipart_prompt(text: Column, part: Column, parts: Column) -> Column:
    return F.when(parts > 1, F.concat(F.format_string("Part %d of %d of a manual page:\n\n", part, parts), text)).otherwise(F.concat(F.lit("A manual page:\n\n"), text))


def size_verdict(text: Column) -> Column:
    """Why a page isn't prepared, or null."""
    return F.when(F.trim(text) == "", "empty").when(F.length(text) > LONGEST, "oversize")


# Chunks.  Lines are laid end to end on an axis, each as long as it is in print (number and newline
# included), so whether a run of lines fits is a difference of two places, and where it ends is found
# by bisection.  Sections are the items, paragraphs where a section doesn't fit, lines where a
# paragraph doesn't; these blocks are then the items of chunks.

#: How many paragraphs of a section later chunks repeat (None: all).
_LEADS = {"# NAME": None, "# SYNOPSIS": None, "# DESCRIPTION": 2}


def _section_bounds(lines: list[str]) -> list[int]:
    return [0, *(i for i, x in enumerate(lines) if i and re.match("#{1,2} ", x)), len(lines)]


def preamble(text: str) -> str:
    """Name, synopsis and the first paragraph of the description, at most `PREAMBLE` characters."""
    lines = text.split("\n")
    bounds = _section_bounds(lines)
    wanted = [("\n".join(lines[a:b]), lines[a].strip()) for a, b in zip(bounds, bounds[1:], strict=False) if lines[a].strip() in _LEADS]
    out = "\n\n".join("\n\n".join(body.split("\n\n")[: _LEADS[head]]) for body, head in wanted)
    cut = out.rfind("\n", 0, PREAMBLE)
    return out if len(out) <= PREAMBLE else out[: cut if cut >= 0 else PREAMBLE] + "\n[…truncated]"


def _runs(begins: np.ndarray, ends: np.ndarray, room: int, waits: list[bool], least: int) -> list[tuple[int, int]]:
    """Runs of items as long as fit into `room`, where item k lies from begins[k] to ends[k].

    Items that wait for what follows don't end a run that something follows, but `least` items
    of it stay; the item that they wait for goes with them whatever its length.
    """
    out, at, bound = [], 0, 1
    while at < len(ends):
        stop = max(bound, int(np.searchsorted(ends, begins[at] + room, "right")))
        back = stop
        while stop < len(ends) and back - at > least and waits[back - 1]:
            back -= 1
        if back > at:
            out.append((at, min(back, len(ends))))
        at, bound = back, stop + 1
    return out


def _paragraphs(lines: list[str], a: int, b: int) -> list[tuple[int, int]]:
    """Lines a to b parted by single blank lines, which belong to no paragraph."""
    out = []
    while True:
        blank = next((i for i in range(a + 1, b - 1) if not lines[i]), b)
        out.append((a, blank))
        if blank == b:
            return out
        a = blank + 1


def _heading(lines: list[str]) -> bool:
    """An option's heading and nothing else."""
    worded = [x for x in lines if x.strip()]
    return len(worded) == 1 and worded[0].lstrip().startswith(("**-", "**+"))


def _blocks(lines: list[str], places: np.ndarray, room: int) -> list[tuple[int, int]]:
    bounds = _section_bounds(lines)
    out = []
    for a, b in zip(bounds, bounds[1:], strict=False):
        parts = [(a, b)]
        if places[b] - places[a] > room + 1:
            items = _paragraphs(lines, a, b)
            first, last = (np.array(x) for x in zip(*items, strict=True))
            runs = _runs(places[first], places[last] - 1, room, [_heading(lines[i:j]) for i, j in items], 1)
            parts = [(items[i][0], items[j - 1][1]) for i, j in runs]
        for i, j in parts:
            if places[j] - places[i] <= room + 1:
                out.append((i, j))
            else:
                out += [(i + x, i + y) for x, y in _runs(places[i:j], places[i + 1 : j + 1] - 1, room, [False] * (j - i), 1)]
    return out


def chunk(text: str, size: int = CHUNK) -> list[str]:
    """Numbered chunks of at most `size` characters; later ones repeat the preamble; an option's heading stays with its body."""
    lines = text.split("\n")
    width = len(str(len(lines)))
    show = lambda a, b: "\n".join(f"{i + 1:>{width}}| {lines[i]}" for i in range(a, b))
    places = np.concatenate(([0], np.cumsum([len(x) + width + 3 for x in lines])))
    if places[-1] <= size + 1:
        return [show(0, len(lines))]
    lead = preamble(text)
    lead = f"{CONTINUED}{lead}\n\n---\n\n" if lead else ""
    blocks = _blocks(lines, places, size - len(lead))
    sizes = np.concatenate(([0], np.cumsum([places[b] - places[a] for a, b in blocks])))
    runs = _runs(sizes[:-1], sizes[1:], size - len(lead), [b - a == 1 and _heading(lines[a:b]) for a, b in blocks], 0)
    return [(lead if k else "") + "\n".join(show(a, b) for a, b in blocks[i:j]) for k, (i, j) in enumerate(runs)]


def chunks(pages: DataFrame, key: str, text: str, size: int = CHUNK) -> DataFrame:
    """key, part, parts, text: a row for each chunk, made by Arrow batches."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, len(c), x) for k, t in zip(batch[key], batch[text], strict=True) for c in [chunk(t or "", size)] for i, x in enumerate(c)]
            yield pd.DataFrame(rows, columns=[key, "part", "parts", "text"])

    kind = dict(pages.dtypes)[key]
    return pages.select(key, text).mapInPandas(run, f"{key} {kind}, part int, parts int, text string")


# Measures and rules.


def line_metrics(pages: DataFrame, key: str, text: str) -> DataFrame:
    """Counts over a text's lines."""
    lines = pages.select(key, F.explode(F.split(text, "\n", -1)).alias("l"))
    n = F.length("l")
    return lines.groupBy(key).agg(
        F.count("*").alias("n_lines"), F.sum(n).alias("n_chars"), F.max(n).alias("longest"), F.round(F.avg(n), 2).alias("mean_length"), F.count_if(F.trim("l") == "").alias("blank_lines"),
        F.count_if(n > 2000).alias("giant_lines"), F.count_if(F.col("l").rlike("^#{1,6} ")).alias("headings"), F.count_if(F.col("l").rlike(r"^\s*[-*] ")).alias("bullets"), F.count_if(F.startswith("l", F.lit("> "))).alias("quotes"),
        F.sum(F.regexp_count("l", F.lit(r"--?[A-Za-z][A-Za-z0-9-]*"))).alias("option_like"), F.sum(F.regexp_count("l", F.lit(r"\*\*"))).alias("bold_marks"), F.count_if(F.col("l").rlike(r"\*{4,}")).alias("star_runs"),
    )


def tag_counts(pages: DataFrame, key: str, html: str) -> DataFrame:
    """key, tag, n: opening tags of a page."""
    return pages.select(key, F.explode(F.regexp_extract_all(html, F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), F.lit(1))).alias("t")).groupBy(key, F.lower("t").alias("tag")).agg(F.count("*").alias("n"))


#: Rules over Markdown lines (md), rendered lines (raw) or those without tags (html): name, arm, pattern.
RULES = (
    ("quad_star_run", "md", r"(?<!\\)\*{4,}"), ("roff_named_escape", "md", r"\\\[[A-Za-z0-9_-]+\]"), ("roff_two_letter_escape", "md", r"\\\([A-Za-z0-9]{2}"), ("roff_font_escape", "md", r"\\f[BIRP]\b"),
    ("visible_open_double_backtick", "md", r"\\`\\`"), ("giant_markdown_line", "md", r"^.{2001,}$"), ("empty_emphasis_tag", "raw", r"<em\b[^>]*>\s*</em>|<strong\b[^>]*>\s*</strong>"),
    ("visible_zwnj_entity", "html", r"&zwnj;"), ("visible_nbsp_entity", "html", r"&nbsp;"), ("visible_double_amp", "html", r"&amp;amp;"),
)


def _shown(pattern: str):
    """What a pattern finds in a line, as (found, shown with what is beside it)."""
    return lambda line: F.transform(F.regexp_extract_all(line, F.lit(pattern), F.lit(0)), lambda x: F.struct(x.alias("found"), padded(line, x).alias("shown")))


def audit(pages: DataFrame, key: str, markdown: str, html: str, rules=RULES, known_escapes: Column | None = None) -> DataFrame:
    """key, rule, hits, snippets (the first three, with what is beside them): lines against each rule, and the synopsis rule.

    `known_escapes`, an array of names, keeps bracketed escapes to names that are in it.
    """
    arms = {"md": F.col(markdown), "raw": F.col(html), "html": F.regexp_replace(F.col(html), "<[^>]+>", "")}
    each = []
    for name, arm, pattern in rules:
        found = F.flatten(F.transform(F.split(arms[arm], "\n", -1), _shown(pattern)))
        if name == "roff_named_escape" and known_escapes is not None:
            found = F.filter(found, lambda x: F.array_contains(known_escapes, F.regexp_extract(x["found"], r"\\\[(.*)\]", 1)) | x["found"].rlike(r"^\\\[u[0-9A-Fa-f]{4,6}\]$"))
        each.append(F.struct(F.lit(name).alias("rule"), found.alias("f")))
    runs = sections(pages, key, markdown).where(F.split_part("text", F.lit("\n"), F.lit(1)).rlike(r"(?i)^#+\s+SYNOPSIS\s*$"))
    out = runs.select(key, F.lit("synopsis_no_spaces_run").alias("rule"), F.flatten(F.transform(F.split("text", "\n", -1), _shown(r"\S{201,}"))).alias("f"))
    if each:
        out = out.unionByName(pages.select(key, F.inline(F.array(*each))))
    return out.where(F.size("f") > 0).select(key, "rule", F.size("f").alias("hits"), F.slice(F.transform("f", lambda x: x["shown"]), 1, 3).alias("snippets"))


def padded(text: Column, found: Column, pad: int = 12) -> Column:
    """The first place of `found` in a text with up to `pad` characters on either side; empty where it isn't there."""
    at = F.instr(text, found)
    first = F.greatest(at - pad, F.lit(1))
    return F.when(at > 0, F.substr(text, first, at - first + F.length(found) + pad)).otherwise("")


def suspicious(pages: DataFrame, key: str, found: DataFrame) -> DataFrame:
    """Pages that some rule found something in."""
    return pages.join(found.select(key).distinct(), key, "left_semi")


def audit_summary(found: DataFrame, key: str, most: int = 10) -> DataFrame:
    """rule, pages, hits, top (the pages with most hits)."""
    w = Window.partitionBy("rule").orderBy(F.desc("hits"), key)
    ranked = found.withColumn("_n", F.row_number().over(w))
    top = F.transform(F.sort_array(F.collect_list(F.when(F.col("_n") <= most, F.struct("_n", key)))), lambda x: x[key])
    return ranked.groupBy("rule").agg(F.count("*").alias("pages"), F.sum("hits").alias("hits"), top.alias("top"))
