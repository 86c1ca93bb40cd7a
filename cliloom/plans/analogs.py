"""Stand-ins for a catalog of pages, made from the driver's tables, for Spark and for the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import strings as S
from ..shipping import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, name, distro, release, section, score, price"""
    p = table(spark, sf_dir, "part")
    stem = F.replace(F.col("p_name"), F.lit(" "), F.lit("-"))
    source = F.concat_ws("/", F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))), F.lower("p_type"), (F.col("p_size") % 9).cast("string"), F.concat(stem, F.lit("-"), F.col("p_partkey"), F.lit("."), F.col("p_size") % 9, F.lit(".gz")))
    p = p.withColumn("source", source)
    return p.select("source", S.page_name("source").alias("name"), S.distro("source").alias("distro"), S.release("source").alias("release"), S.section_of("source").alias("section"), (1 + F.col("p_size") % 10).alias("score"), F.col("p_name"), F.col("p_partkey"), F.col("p_size"), F.col("p_retailprice"))


def mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """src, dst, score: a name leads to several pages; names hold a blank, as subcommands do."""
    return pages(spark, sf_dir).select(F.col("p_name").alias("src"), F.col("source").alias("dst"), "score")


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts, ip, ua, status, uri, event_id, json from the event log."""
    e = table(spark, sf_dir, "events")
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "signup", 404).when(F.col("event_type") == "view", 304).otherwise(200)
    ip = F.concat_ws(".", F.lit("10"), (F.col("user_id") % 7).cast("string"), (F.col("user_id") % 11).cast("string"), F.col("user_id").cast("string"))
    k = F.get_json_object("props", "$.k")
    uri = F.when(F.col("event_type") == "signup", F.concat(F.lit("/explain?cmd=tar+-x%20"), k)).when(F.col("event_type") == "click", F.concat(F.lit("/explain?cmd=ls+%7C+wc+-l&n="), k)).otherwise(F.concat(F.lit("/page/"), k))
    return e.select("event_id", "ts", ip.alias("ip"), F.concat(F.lit("agent"), F.col("user_id") % 13).alias("ua"), status.alias("status"), uri.alias("uri"), "value", F.col("props").alias("json"), "user_id", "event_type")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, line of all documents."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    return d.select("doc_id", (F.col("i") + 1).alias("n"), "line")


def options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, idx, short, long, text, line_start, line_end, qty, positional: the lines of an order as the options of a page."""
    l = table(spark, sf_dir, "lineitem")
    short = F.array_sort(F.array_distinct(F.array(F.concat(F.lit("-"), F.lower("l_returnflag")), F.concat(F.lit("-"), F.lower("l_linestatus")))))
    long = F.when(F.col("l_partkey") % 3 == 0, F.array(F.concat(F.lit("--opt"), F.col("l_suppkey") % 4))).otherwise(F.array().cast("array<string>"))
    text = F.repeat(F.lit("x"), F.col("l_quantity").cast("int"))
    return l.select(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("idx"), short.alias("short"), long.alias("long"), text.alias("text"), (F.col("l_linenumber") * 2).alias("line_start"), (F.col("l_linenumber") * 2 + F.col("l_quantity").cast("int") % 9).alias("line_end"), F.col("l_quantity").cast("int").alias("qty"), F.lit(None).cast("string").alias("positional"))


#: The same tables for the checking SQL.
SQL = {
    "a_page": """a_page AS (
  SELECT source, regexp_replace(regexp_extract(source, '[^/]*$'), '\\.[^.]*\\.[^.]*$', '') AS name, split_part(source, '/', 1) AS distro, split_part(source, '/', 2) AS release,
    regexp_extract(source, '\\.([^.]*)\\.gz$', 1) AS section, CAST(1 + p_size % 10 AS BIGINT) AS score, p_name, p_partkey, p_size, p_retailprice
  FROM (SELECT *, lower(replace(p_brand, '#', '')) || '/' || lower(p_type) || '/' || (p_size % 9) || '/' || replace(p_name, ' ', '-') || '-' || p_partkey || '.' || (p_size % 9) || '.gz' AS source FROM part))""",
    "a_map": "a_map AS (SELECT p_name AS src, source AS dst, score FROM a_page)",
    "a_request": """a_request AS (
  SELECT event_id, ts, '10.' || (user_id % 7) || '.' || (user_id % 11) || '.' || user_id AS ip, 'agent' || (user_id % 13) AS ua,
    CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 404 WHEN 'view' THEN 304 ELSE 200 END AS status,
    CASE event_type WHEN 'signup' THEN '/explain?cmd=tar+-x%20' || (props->>'$.k') WHEN 'click' THEN '/explain?cmd=ls+%7C+wc+-l&n=' || (props->>'$.k') ELSE '/page/' || (props->>'$.k') END AS uri,
    value, props AS json, user_id, event_type
  FROM events)""",
    "a_line": "a_line AS (SELECT doc_id, generate_subscripts(l, 1) AS n, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))",
    "a_option": """a_option AS (
  SELECT l_orderkey AS page, CAST(l_linenumber AS BIGINT) AS idx, list_sort(list_distinct(['-' || lower(l_returnflag), '-' || lower(l_linestatus)])) AS short,
    CASE WHEN l_partkey % 3 = 0 THEN ['--opt' || (l_suppkey % 4)] ELSE CAST([] AS VARCHAR[]) END AS long, repeat('x', CAST(trunc(l_quantity) AS INT)) AS text,
    l_linenumber * 2 AS line_start, l_linenumber * 2 + CAST(trunc(l_quantity) AS INT) % 9 AS line_end, CAST(trunc(l_quantity) AS BIGINT) AS qty
  FROM lineitem)""",
}


def sql(needs: str, body: str) -> str:
    """The checking SQL with the stand-ins that it needs in front."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in needs.split()) + "\n" + body
