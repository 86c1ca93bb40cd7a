"""Options of pages: normalising, checking, converting and removing duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written

#: The signs that mark a prefixed positional.
SIGILS = ("@", "+", ":")
#: Fixed value: spans over this many times the page's lines are nonsense.
MOST_COVERAGE = 3.0


def normalise(raw: DataFrame) -> DataFrame:
    """raw: has_arg (JSON text or null), positional, prefix, ...: nulls to false, strings to true, lists to lists of strings; a sigil in front of a positional becomes its prefix."""
    v = F.try_parse_json("has_arg")
    values = F.try_variant_get(v, "$", "array<string>")
    flag = F.try_variant_get(v, "$", "boolean")
    text = F.schema_of_variant(v) == "STRING"
    p = F.col("positional")
    sigil = F.substring(p, 1, 1)
    split = sigil.isin(*SIGILS) & (F.length(p) > 1) & F.col("prefix").isNull()
    return raw.withColumns({
        "arg_values": F.coalesce(values, F.array().cast("array<string>")),
        "has_arg": F.coalesce(F.size(values) > 0, F.coalesce(text, F.lit(False)) | F.coalesce(flag, F.lit(False))),
        "prefix": F.when(split, sigil).otherwise(F.col("prefix")),
        "positional": F.when(split, F.substr(p, F.lit(2))).otherwise(p),
    })


def sanitise(options: DataFrame) -> DataFrame:
    """Flags beat a positional; a prefix needs a positional and a known sigil; a nested command is an argument."""
    flags = (F.size("short") > 0) | (F.size("long") > 0)
    positional = F.when(~flags, F.nullif(F.col("positional"), F.lit("")))
    return (
        options.withColumn("positional", positional).withColumn("prefix", F.when(F.col("positional").isNotNull() & F.col("prefix").isin(*SIGILS), F.col("prefix")))
        .withColumn("has_arg", F.col("has_arg") | (F.col("nested") & flags))
    )


def malformed(options: DataFrame) -> Column:
    """Whether a raw option can't be converted: no lists of flags, or no span of two lines."""
    return F.col("short").isNull() | F.col("long").isNull() | F.col("line_start").isNull() | F.col("line_end").isNull()


def flags() -> Column:
    return F.concat("short", "long")


def find_flag(options: Column, flag: str) -> Column:
    return F.try_element_at(F.filter(options, lambda o: F.array_contains(F.concat(o["short"], o["long"]), flag)), F.lit(1))


def chunk_dedup(options: DataFrame, by: str, idx: str, size: Column) -> DataFrame:
    """Of options with the same sorted flags the largest, of equal ones the first; those without flags stay."""
    key = F.struct(F.array_sort("short"), F.array_sort("long"))
    bare = (F.size("short") == 0) & (F.size("long") == 0)
    w = Window.partitionBy(by, "_k").orderBy(F.desc(size), idx)
    keyed = options.where(~bare).withColumn("_k", key).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_k", "_n")
    return keyed.unionByName(options.where(bare))


def exact_dedup(options: DataFrame, by: str, idx: str, text: str) -> DataFrame:
    """Of options with the same set of flags: the first place, the first of the longest texts."""
    bare = (F.size("short") == 0) & (F.size("long") == 0)
    w = Window.partitionBy(by, "_k")
    keyed = options.where(~bare).withColumn("_k", F.array_sort(F.array_distinct(flags())))
    keyed = keyed.withColumn("_first", F.min(idx).over(w)).withColumn("_n", F.row_number().over(w.orderBy(F.desc(F.length(text)), idx))).where("_n = 1")
    return keyed.withColumn(idx, F.col("_first")).drop("_k", "_n", "_first").unionByName(options.where(bare))


def mentions(text: Column, flag: Column) -> Column:
    """Whether a text names a flag with nothing of a flag's letters around it."""
    return F.rlike(text, F.concat(F.lit(r"(?<![a-zA-Z0-9\-])\Q"), F.replace(flag, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E(?![a-zA-Z0-9\-])")))


def containments(options: DataFrame, by: str, idx: str) -> DataFrame:
    """by, sub, sup, extra (flags): the pairs of a page whose first option's flags are a part of the second's.

    A larger set holds the smaller one's rarest flag, so options meet by that flag only, not each with each.
    All sides grow with the options, and files of repeated texts say little of a table's size in memory: no side is broadcast.
    """
    sets = options.select(by, F.col(idx).alias("sub"), F.array_distinct(flags()).alias("_f")).where(F.size("_f") > 0)
    each = sets.select(by, "sub", F.explode("_f").alias("_flag"))
    counts = each.groupBy(by, "_flag").agg(F.count("*").alias("_c"))
    rarest = each.join(counts.hint("merge"), [by, "_flag"]).groupBy(by, "sub").agg(F.min(F.struct("_c", "_flag"))["_flag"].alias("_flag"))
    small = sets.join(rarest.hint("merge"), [by, "sub"])
    large = sets.select(by, F.col("sub").alias("sup"), F.col("_f").alias("_g"), F.explode("_f").alias("_flag"))
    met = small.join(large.hint("merge"), [by, "_flag"]).where((F.size("_g") > F.size("_f")) & (F.size(F.array_except("_f", "_g")) == 0))
    return met.select(by, "sub", "sup", F.array_except("_g", "_f").alias("extra"))


def superset_dedup(options: DataFrame, by: str, idx: str) -> DataFrame:
    """An option whose text names a further flag of a larger one merges into the larger one with the fewest further flags (of equal ones the first); a longer text goes along.

    Options are settled in order, each seeing what those before it did, and that is all that
    holds up a round: an option waits for those before it whose flags hold its own or are held
    by them.  So a page takes as many rounds as its longest chain of nested options, and all
    pages take them together.  As in `containments`, no side of a join is broadcast.
    """
    options = written(options, "all-options")  # it is read for each step below
    pairs = written(containments(options, by, idx), "pairs")
    moved = ["text", "line_start", "line_end"]
    ends = pairs.select(by, F.col("sub").alias(idx)).unionByName(pairs.select(by, F.col("sup").alias(idx))).distinct()
    state = options.join(ends.hint("merge"), [by, idx]).select(by, idx, F.struct(*moved).alias("held"), F.lit(False).alias("gone"), F.lit(False).alias("settled"))
    touching = pairs.select(by, F.col("sub").alias(idx), F.col("sup").alias("_other")).unionByName(pairs.select(by, F.col("sup").alias(idx), F.col("sub").alias("_other")))
    touching = touching.where(F.col("_other") < F.col(idx))
    while True:
        state = written(state, "options")
        open_ = state.where("not settled").select(by, idx)
        if open_.isEmpty():
            break
        waits = touching.join(open_.withColumnRenamed(idx, "_other").hint("merge"), [by, "_other"], "left_semi").select(by, idx)
        ready = open_.join(waits.hint("merge"), [by, idx], "left_anti")
        live = state.where("not gone").select(by, F.col(idx).alias("sup"))
        texts = state.join(ready.hint("merge"), [by, idx], "left_semi").select(by, F.col(idx).alias("sub"), "held")
        named = F.exists("extra", lambda f: mentions(F.col("held.text"), f))
        goes = pairs.join(texts.hint("merge"), [by, "sub"]).join(live.hint("merge"), [by, "sup"], "left_semi").where(named)
        goes = goes.groupBy(by, "sub").agg(F.min(F.struct(F.size("extra").alias("n"), "sup"))["sup"].alias("sup"), F.any_value("held").alias("held"))
        # Of several that merge into one the longest text, the first of equally long ones.
        come = goes.groupBy(by, F.col("sup").alias(idx)).agg(F.max_by("held", F.struct(F.length("held.text"), -F.col("sub"))).alias("_new"))
        state = state.join(ready.withColumn("_ready", F.lit(True)).hint("merge"), [by, idx], "left").join(goes.select(by, F.col("sub").alias(idx), F.lit(True).alias("_goes")).hint("merge"), [by, idx], "left").join(come.hint("merge"), [by, idx], "left")
        held = F.when(F.coalesce(F.length("_new.text") > F.length("held.text"), F.lit(False)), F.col("_new")).otherwise(F.col("held"))
        state = state.select(by, idx, held.alias("held"), (F.col("gone") | F.col("_goes").isNotNull()).alias("gone"), (F.col("settled") | F.col("_ready").isNotNull()).alias("settled"))
    out = options.join(state.select(by, idx, "held", "gone").hint("merge"), [by, idx], "left").where("not coalesce(gone, false)")
    put = {c: F.when(F.col("held").isNull(), F.col(c)).otherwise(F.col(f"held.{c}")).alias(c) for c in moved}
    return out.select(*(put.get(c, F.col(c)) for c in options.columns))


def drop_empty(options: DataFrame) -> DataFrame:
    return options.where((F.size("short") > 0) | (F.size("long") > 0) | F.coalesce(F.col("positional") != "", F.lit(False)))


def span_sanity(options: DataFrame, by: str) -> DataFrame:
    """by, coverage, failed: the sum of the spans over the last line."""
    total = F.sum(F.greatest(F.col("line_end") - F.col("line_start") + 1, F.lit(0)))
    return options.groupBy(by).agg((total / F.max("line_end")).alias("coverage")).withColumn("failed", F.coalesce(F.col("coverage") > MOST_COVERAGE, F.lit(False)))


def postprocess(options: DataFrame, by: str, idx: str, steps: tuple[str, ...] = ("sanitise", "strip", "dedup", "empty")) -> DataFrame:
    out = options
    if "sanitise" in steps:
        out = sanitise(out)
    if "strip" in steps:
        out = out.withColumn("text", F.regexp_replace("text", r"[\n ]+$", ""))
    if "dedup" in steps:
        out = superset_dedup(exact_dedup(out, by, idx, "text"), by, idx)
    return drop_empty(out) if "empty" in steps else out
