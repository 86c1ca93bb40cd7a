"""Differences between pages, runs and extractors, and the sorting of input files."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import strings as S

#: The fields compared.
PAGE_FIELDS = ("name", "synopsis", "aliases", "dashless", "subcommands", "nested", "extractor", "updated")
OPTION_FIELDS = ("text", "has_arg", "positional", "prefix", "nested")


def option_key() -> Column:
    """Flags sorted, or a positional's name."""
    bare = (F.size("short") == 0) & (F.size("long") == 0)
    return F.when(bare, F.concat(F.lit("positional:"), F.coalesce("positional", F.lit("")))).otherwise(F.concat_ws("|", F.array_join(F.array_sort("short"), ","), F.array_join(F.array_sort("long"), ",")))


def agreement_key() -> Column:
    """All positionals are one key."""
    return F.concat_ws("|", F.array_join(F.array_sort("short"), ","), F.array_join(F.array_sort("long"), ","))


def falsy_null(c: Column) -> Column:
    return F.nullif(F.nullif(c.cast("string"), F.lit("")), F.lit("false"))


def compare_fields(stored: DataFrame, fresh: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """key, field, before, after: fields that differ, empty and false being the same as missing."""
    a = stored.select(F.col(key), *(falsy_null(F.col(f)).alias(f"a_{f}") for f in fields))
    b = fresh.select(F.col(key), *(falsy_null(F.col(f)).alias(f"b_{f}") for f in fields))
    rows = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"a_{f}").alias("before"), F.col(f"b_{f}").alias("after")) for f in fields))
    return a.join(b, key).select(key, F.inline(rows)).where(~F.col("before").eqNullSafe(F.col("after")))


def compare_options(stored: DataFrame, fresh: DataFrame, page: str, idx: str, fields: tuple[str, ...] = ("text",)) -> DataFrame:
    """page, key, change (added, removed, changed), place: of options with one key the last counts; stored places first."""
    last = lambda df, s: df.withColumn("key", option_key()).groupBy(page, "key").agg(F.max_by(F.struct(idx, *fields), idx).alias(s))
    j = last(stored, "a").join(last(fresh, "b"), [page, "key"], "full_outer")
    differs = ~F.struct(*(falsy_null(F.col(f"a.{f}")) for f in fields)).eqNullSafe(F.struct(*(falsy_null(F.col(f"b.{f}")) for f in fields)))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(differs, "changed")
    return j.select(page, "key", change.alias("change"), F.coalesce(F.col(f"a.{idx}"), F.col(f"b.{idx}") + 1_000_000).alias("place")).where("change is not null")


def agreement(left: DataFrame, right: DataFrame, page: str, idx: str | None = None, fields: tuple[str, ...] = ()) -> DataFrame:
    """page, only_left, only_right, common, agreement, and for each of `fields` in how many common keys it differs (of one key's options the last by `idx` counts)."""
    last = [F.max(F.struct(idx, *fields)) if fields else F.lit(1)]
    keys = lambda df, s: df.select(page, agreement_key().alias("key"), *([idx, *fields] if fields else [])).groupBy(page, "key").agg(*(c.alias(s) for c in last))
    j = keys(left, "l").join(keys(right, "r"), [page, "key"], "full_outer")
    both = F.col("l").isNotNull() & F.col("r").isNotNull()
    differ = [F.count_if(both & ~F.col(f"l.{f}").eqNullSafe(F.col(f"r.{f}"))).alias(f"diff_{f}") for f in fields]
    out = j.groupBy(page).agg(F.count_if(F.col("r").isNull()).alias("only_left"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(both).alias("common"), *differ)
    return out.withColumn("agreement", S.guarded_ratio(F.col("common"), F.col("common") + F.col("only_left"), F.col("common") + F.col("only_right")))


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, metric, value, direction, tolerance) of two runs: path, metric, change.

    Direction up or down says which way is better; equal wants equality.  A
    number counts as changed beyond the tolerance, relative to what it was.
    """
    j = before.select("path", "metric", F.col("value").alias("a"), "direction", "tolerance").join(after.select("path", "metric", F.col("value").alias("b")), ["path", "metric"], "full_outer")
    beyond = S.relative_change(F.col("b"), F.col("a")) > F.col("tolerance")
    worse = F.when(F.col("direction") == "up", F.col("b") < F.col("a")).when(F.col("direction") == "down", F.col("b") > F.col("a")).otherwise(F.lit(True))
    change = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").when(beyond & worse, "worse").when(beyond, "better")
    return j.select("path", "metric", "a", "b", change.alias("change")).where("change is not null")


def change_lines(changes: DataFrame) -> DataFrame:
    """path, line: what `compare_runs` found, in print."""
    number = lambda c: F.coalesce(F.format_number(c, 2), F.lit("none"))
    return changes.select("path", F.concat("metric", F.lit(": "), number("a"), F.lit(" -> "), number("b"), F.lit(" ("), "change", F.lit(")")).alias("line"))


def flags(short: Column, long: Column, positional: Column) -> Column:
    """An option's flags, or its positional in angle brackets."""
    every = F.concat(F.coalesce(short, F.array().cast("array<string>")), F.coalesce(long, F.array().cast("array<string>")))
    return F.when(F.size(every) > 0, F.array_join(every, ", ")).otherwise(F.coalesce(F.concat(F.lit("<"), positional, F.lit(">")), F.lit("(no flags)")))


def option_lines(option: Column) -> Column:
    """An option in print: its flags, what it takes, its text."""
    shown = lambda f: F.coalesce(F.array_join(option[f], ", "), F.lit(""))
    lines = F.array(F.concat(F.lit("short: "), shown("short")), F.concat(F.lit("long: "), shown("long")), F.concat(F.lit("takes a value: "), F.coalesce(option["has_arg"], F.lit(False)).cast("string")))
    named = F.when(F.coalesce(option["positional"], F.lit("")) != "", F.array(F.concat(F.lit("positional: "), option["positional"]))).otherwise(F.array().cast("array<string>"))
    return F.concat(lines, named, F.split(F.trim(F.coalesce(option["text"], F.lit(""))), "\n", -1))


def diff_lines(stored: DataFrame, fresh: DataFrame, page: str, idx: str, fields: tuple[str, ...] = ("text", "has_arg")) -> DataFrame:
    """page, lines: options of two versions in print, stored ones in order, then what was added.

    A kept option has a line, and two for each of `fields` that differs; added and removed ones are shown whole, marked + and -.
    Of options with one key the last counts.
    """
    whole = ("short", "long", "positional", "has_arg", "text")
    last = lambda df, s: df.withColumn("key", option_key()).groupBy(page, "key").agg(F.max_by(F.struct(idx, *dict.fromkeys((*whole, *fields))), idx).alias(s))
    j = last(stored, "a").join(last(fresh, "b"), [page, "key"], "full_outer")
    a, b = F.col("a"), F.col("b")
    name = lambda o: flags(o["short"], o["long"], o["positional"])
    marked = lambda mark, o: F.concat(F.array(F.concat(F.lit(f"{mark} "), name(o))), F.transform(option_lines(o), lambda x: F.concat(F.lit(f"{mark}     "), x)))
    none = F.array().cast("array<string>")
    value = lambda o, f: F.coalesce(falsy_null(o[f]), F.lit("none"))
    differ = [F.when(~falsy_null(a[f]).eqNullSafe(falsy_null(b[f])), F.array(F.concat(F.lit(f"    - {f}: "), value(a, f)), F.concat(F.lit(f"    + {f}: "), value(b, f)))).otherwise(none) for f in fields]
    details = F.concat(*differ)
    kept = F.when(F.size(details) == 0, F.array(F.concat(F.lit("  "), name(a), F.lit(" (unchanged)")))).otherwise(F.concat(F.array(F.concat(F.lit("  "), name(a))), details))
    lines = F.when(a.isNull(), marked("+", b)).when(b.isNull(), marked("-", a)).otherwise(kept)
    each = j.select(page, F.struct(a.isNull().alias("added"), F.coalesce(a[idx], b[idx]).alias("at"), "key", lines.alias("lines")).alias("o"))
    return each.groupBy(page).agg(F.flatten(F.transform(F.array_sort(F.collect_list("o")), lambda o: o["lines"])).alias("lines"))


def paired_outcomes(left: DataFrame, right: DataFrame) -> DataFrame:
    """source, outcome, reason, tokens of two extractors (outcome success, skipped or failed).

    A failure outranks a skip, a skip a success; a page that one side lacks is skipped. Tokens are those of the sides that succeeded, null where none did.
    """
    rank = lambda s: F.when(F.col(f"{s}.outcome") == "failed", 2).when(F.col(f"{s}.outcome") == "success", 0).otherwise(1)
    side = lambda df, s: df.select("source", F.struct("outcome", "reason", "tokens").alias(s))
    j = side(left, "l").join(side(right, "r"), "source", "full_outer")
    worst = F.greatest(rank("l"), rank("r"))
    reason = lambda s: F.when(F.col(s).isNull(), "missing").otherwise(F.col(f"{s}.reason"))
    used = lambda s: F.when(F.col(f"{s}.outcome") == "success", F.col(f"{s}.tokens"))
    tokens = F.when(used("l").isNotNull() | used("r").isNotNull(), F.coalesce(used("l"), F.lit(0)) + F.coalesce(used("r"), F.lit(0)))
    names = F.element_at(F.array(F.lit("success"), F.lit("skipped"), F.lit("failed")), worst + 1)
    return j.select("source", names.alias("outcome"), F.when(worst > 0, F.when(rank("l") == worst, reason("l")).otherwise(reason("r"))).alias("reason"), tokens.cast("long").alias("tokens"))


def both_succeeded(sampled: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of `sampled` (source) whose page both sides extracted."""
    good = lambda df: df.where("outcome = 'success'").select("source")
    return sampled.join(good(left), "source", "left_semi").join(good(right), "source", "left_semi")


@F.udf(StringType(), useArrow=True)
def text_diff(before: str, after: str) -> str:
    """Unified, one line of context, blank edges trimmed."""
    a, b = ((x or "").strip("\n").split("\n") for x in (before, after))
    return "\n".join(list(difflib.unified_diff(a, b, n=1, lineterm=""))[2:])


def classify(files: DataFrame, stored: DataFrame, known: DataFrame, overwrite: bool = False, filters: list[tuple[str, str | None]] | None = None, size: str = "both") -> DataFrame:
    """files: pos, source, sha, length, canonical; stored: source, extractor, model; known: key, source.

    kind is, in this order: size_skip, symlink, filter_skip or work (where a
    filter is given and the page is to be overwritten), stored, content_dup, work.
    Content counts as seen from the first file on that gets as far as `work` without a filter, or from the store.
    A file without a hash is like no other.
    """
    f = files.join(stored.select("source", F.col("extractor").alias("_e"), F.col("model").alias("_m"), F.lit(True).alias("_stored")), "source", "left")
    f = f.withColumn("_key", S.dedup_key("sha", "source"))
    if not overwrite:
        f = f.join(known.select(F.col("key").alias("_key"), F.col("source").alias("_db")), "_key", "left")
    else:
        f = f.withColumn("_db", F.lit(None).cast("string"))
    wrong = {"small": F.col("length") > 2048, "large": F.col("length") <= 2048}.get(size, F.lit(False))
    match = F.lit(False)
    for mode, model in filters or []:
        match = match | ((F.col("_e") == mode) & (F.lit(mode != "llm") | F.col("_m").eqNullSafe(F.lit(model))))
    filtered = F.lit(bool(filters and overwrite)) & F.col("_stored").isNotNull()
    early = F.when(wrong, "size_skip").when(F.col("canonical").isNotNull() & (F.col("canonical") != F.col("source")), "symlink").when(filtered, F.when(F.coalesce(match, F.lit(False)), "work").otherwise("filter_skip")).when(F.col("_stored").isNotNull() & ~F.lit(overwrite), "stored")
    f = f.withColumn("_early", early)
    open_rows = f.where("_early is null")
    firsts = open_rows.groupBy("_key").agg(F.min(F.struct("pos", "source")).alias("_first"), F.count("*").alias("_n")).where("_n > 1 and _key is not null").drop("_n")
    open_rows = open_rows.join(firsts, "_key", "left")
    canonical = F.coalesce("_db", F.when(F.col("pos") > F.col("_first.pos"), F.col("_first.source")))
    late = open_rows.select("pos", "source", F.when(canonical.isNotNull() & (canonical != F.col("source")), "content_dup").otherwise("work").alias("kind"), F.when(canonical != F.col("source"), canonical).alias("of"))
    return f.where("_early is not null").select("pos", "source", F.col("_early").alias("kind"), F.when(F.col("_early") == "symlink", F.col("canonical")).alias("of")).unionByName(late)


def applied(decisions: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions with a message, pages that stay): a stored page that is now a link goes from the store."""
    given = decisions.select(F.col("source").alias("of"), F.lit(True).alias("_given")).distinct()
    at = decisions.join(given, "of", "left")
    link = F.concat(F.lit("link to "), "of", F.when(F.col("_given"), " (given too)").otherwise(" (give that file to extract it)"))
    message = F.when(F.col("kind") == "symlink", link).when(F.col("kind") == "content_dup", F.concat(F.lit("same content as "), "of")).when(F.col("kind") == "size_skip", "not of the size asked for").when(F.col("kind") == "stored", "already stored").when(F.col("kind") == "filter_skip", "stored by another extractor")
    return at.select(*decisions.columns, message.alias("message")), pages.join(decisions.where("kind = 'symlink'").select("source"), "source", "left_anti")


def plan_counts(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def run_summary(results: DataFrame) -> DataFrame:
    """results: outcome.  added counts pages, symlinks and content duplicates; rc is 0 if nothing failed."""
    n = lambda *k: F.count_if(F.col("outcome").isin(*k))
    return results.agg(n("success").alias("succeeded"), n("skipped").alias("skipped"), n("failed").alias("failed"), n("success", "symlink", "content_dup").alias("added")).withColumn("rc", (F.col("failed") > 0).cast("int"))
