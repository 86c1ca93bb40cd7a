"""Synopses, aliases, model names, replies of batch jobs, ages and exported paragraphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import strings as S

#: Providers whose models may carry an effort.
EFFORT_PROVIDERS = ("openai", "azure", "gemini", "codex")


def synopsis_and_aliases(programs: DataFrame, key: str = "source", own: str = "name", program: str = "program", text: str = "text", order: str = "pos") -> DataFrame:
    """key, synopsis, aliases: the first text of a page, its name at score 10 and the other programs at 1."""
    first = F.min_by(text, order)
    others = F.array_sort(F.array_distinct(F.collect_list(F.when(F.col(program) != F.col(own), F.col(program)))))
    out = programs.groupBy(key, own).agg(first.alias("synopsis"), others.alias("_o"))
    pair = lambda n, s: F.struct(n.alias("name"), F.lit(s).alias("score"))
    return out.select(key, "synopsis", F.concat(F.array(pair(F.col(own), 10)), F.transform("_o", lambda x: pair(x, 1))).alias("aliases"))


def parse_model(c: Column | str) -> Column:
    """Struct of base and effort: provider/model/effort of the providers that have one."""
    parts = F.split(S.col(c), "/")
    has = parts[0].isin(*EFFORT_PROVIDERS) & (F.size(parts) == 3)
    return F.struct(F.when(has, F.array_join(F.slice(parts, 1, 2), "/")).otherwise(S.col(c)).alias("base"), F.when(has, F.get(parts, F.lit(2))).alias("effort"))


def last_messages(lines: DataFrame, key: str = "run", order: str = "pos", line: str = "line") -> DataFrame:
    """key, message, tokens: of an agent's JSON lines, the last message and the sum of the usage."""
    j = F.from_json(line, "struct<type:string,text:string,usage:struct<input_tokens:bigint,output_tokens:bigint>>")
    rows = lines.withColumn("_j", j)
    said = F.col("_j.type") == "agent_message"
    return rows.groupBy(key).agg(F.max_by(F.when(said, F.col("_j.text")), F.when(said, F.col(order))).alias("message"), F.coalesce(F.sum(F.coalesce("_j.usage.input_tokens", F.lit(0)) + F.coalesce("_j.usage.output_tokens", F.lit(0))), F.lit(0)).alias("tokens"))


def batch_replies(requests: DataFrame, output: DataFrame) -> DataFrame:
    """requests: custom_id `item:chunk`; output: line, a JSON line for each answered request.  Every request with its reply or why there is none."""
    j = F.from_json("line", "struct<custom_id:string,response:struct<status_code:int,body:string>,error:struct<message:string>>")
    got = output.withColumn("_j", j).where("_j.custom_id is not null").select(F.col("_j.custom_id").alias("custom_id"), F.when(F.col("_j.response.status_code") == 200, F.col("_j.response.body")).alias("reply"), F.coalesce("_j.error.message", F.when(F.col("_j.response.status_code") != 200, F.concat(F.lit("status "), F.col("_j.response.status_code").cast("string")))).alias("error"))
    out = requests.join(got.dropDuplicates(["custom_id"]), "custom_id", "left")
    return out.withColumn("error", F.when(F.col("reply").isNull(), F.coalesce("error", F.lit("missing")))).withColumn("item", F.substring_index("custom_id", ":", 1)).withColumn("chunk", F.substring_index("custom_id", ":", -1).try_cast("int"))


def age(then: Column, now: Column) -> Column:
    """just now, 5 minutes ago, 3 hours ago, 2 days ago"""
    s = F.unix_timestamp(now) - F.unix_timestamp(then)
    n = lambda unit: F.floor(s / unit).cast("int")
    shown = lambda k, word: F.concat(k.cast("string"), F.lit(f" {word}"), F.when(k == 1, "").otherwise("s"), F.lit(" ago"))
    return F.when(s < 60, "just now").when(s < 3600, shown(n(60), "minute")).when(s < 86400, shown(n(3600), "hour")).otherwise(shown(n(86400), "day"))


def exported_options(paragraphs: Column) -> Column:
    """Paragraphs of an export as options: those with flags, flags as lists, absent keys as false or null."""
    keep = F.filter(paragraphs, lambda p: (F.size(F.coalesce(p["short"], F.array().cast("array<string>"))) > 0) | (F.size(F.coalesce(p["long"], F.array().cast("array<string>"))) > 0) | p["argument"].isNotNull())
    empty = F.array().cast("array<string>")
    return F.transform(keep, lambda p: F.struct(p["text"].alias("text"), F.coalesce(p["short"], empty).alias("short"), F.coalesce(p["long"], empty).alias("long"), F.coalesce(p["expectsarg"], F.lit(False)).alias("has_arg"), p["argument"].alias("positional"), F.coalesce(p["nestedcommand"], F.lit(False)).alias("nested")))


def uncovered(spans: DataFrame, key: str, start: str, end: str, length: str) -> DataFrame:
    """key, start, end: the gaps that a text's spans leave, from a sweep over them in order of their starts.

    A gap opens where a span begins behind all ends before it; an empty span, one whose bounds
    are null, or what lies outside the text covers nothing.  `length` is the same in a text's rows.
    """
    s, e = F.greatest(F.col(start), F.lit(0)), F.least(F.col(end), F.col(length))
    ends = F.struct(F.col(length).alias("s"), F.col(length).alias("e"))  # closes the last gap
    rows = spans.where(F.col(start) < F.col(end)).select(key, s.alias("s"), e.alias("e")).where("s < e")
    rows = rows.unionByName(spans.select(key, F.inline(F.array(ends))).distinct())
    w = Window.partitionBy(key).orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_from", F.coalesce(F.max("e").over(w), F.lit(0))).where("_from < s").select(key, F.col("_from").cast("long").alias("start"), F.col("s").cast("long").alias("end"))


def first_of_group(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")
