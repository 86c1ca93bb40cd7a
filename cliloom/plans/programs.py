"""Queries that end in a fold or a stream: explaining lines, extraction, log streams, load."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import analytics as O
from ..operators import batches as B
from ..operators import explain as E
from ..operators import extract as X
from ..operators import layout as Y
from ..operators import loadgen as L
from ..operators import running as Z
from ..sources import logsource, pagefiles
from ..sources import readers as R
from ..sources.folders import new_folder
from ..sources.sinks import contents_and_aliases, newest_entries
from ..streaming import logs
from ..streaming import sessions as N
from . import analogs as A
from .registry import query


def _pages(spark, d):
    """The stand-in pages with two options, a positional and, for some, subcommands."""
    empty = F.array().cast("array<string>")
    flag = lambda text, short, arg: F.struct(F.lit(text).alias("text"), F.array(F.lit(short)).alias("short"), empty.alias("long"), F.lit(arg).alias("has_arg"), empty.alias("arg_values"), F.lit(None).cast("string").alias("positional"), F.lit(None).cast("string").alias("prefix"), F.lit(False).alias("nested"), empty.alias("nested_end"))
    file = F.struct(F.lit("files").alias("text"), empty.alias("short"), empty.alias("long"), F.lit(False).alias("has_arg"), empty.alias("arg_values"), F.lit("FILE").alias("positional"), F.lit(None).cast("string").alias("prefix"), F.lit(False).alias("nested"), empty.alias("nested_end"))
    p = A.pages(spark, d)
    return p.select("source", "name", "section", F.concat(F.lit("about "), "p_name").alias("synopsis"), (F.col("p_size") % 2 == 0).alias("dashless"), F.array(F.split_part("p_name", F.lit(" "), F.lit(2))).alias("subcommands"), F.lit(False).alias("nested"), empty.alias("nested_end"), F.array(flag("all of it", "-a", False), flag("to a file", "-o", True), file).alias("options"), "p_name", "score")


def _lines(spark, d):
    """Lines of words that are page names, with options."""
    c = A.table(spark, d, "conversations")
    first = F.element_at(F.array(*map(F.lit, ["small", "red", "steel", "blue"])), (1 + F.col("turn") % 4).cast("int"))
    second = F.element_at(F.array(*map(F.lit, ["ring", "widget", "bolt", "gear"])), (1 + F.col("conv_id") % 4).cast("int"))
    return c.select((F.col("conv_id") * 100 + F.col("turn")).alias("query_id"), F.concat_ws(" ", first, second, F.lit("-a -o out in | wc -l > n; # done")).alias("cmd"))


def _maps(spark, d, pages):
    whole = pages.select(F.col("p_name").alias("src"), F.col("source").alias("dst"), "score")
    head = pages.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("src")).agg(F.min("source").alias("dst")).withColumn("score", F.lit(5))
    return whole.unionByName(head)


@query("mat_explain")
def _(spark, d):
    pages = _pages(spark, d)
    return E.explain(_lines(spark, d), pages, _maps(spark, d, pages))


@query("exp_dictionary")
def _(spark, d):
    pages = _pages(spark, d)
    return E.help_dictionary(E.explain(_lines(spark, d), pages, _maps(spark, d, pages))).select("query_id", "group_no", "start", "end", "help_id", "first")


@query("exp_group_heads")
def _(spark, d):
    pages = _pages(spark, d)
    return E.group_heads(E.explain(_lines(spark, d), pages, _maps(spark, d, pages))).select("query_id", "group_no", "source", "match")


@query("exp_guard", "", "SELECT doc_id, CASE WHEN substr(trim(text), 1, 1000) <> '' AND NOT contains(substr(trim(text), 1, 1000), chr(10)) THEN substr(trim(text), 1, 1000) END AS line FROM documents")
def _(spark, d):
    return A.table(spark, d, "documents").select("doc_id", E.guarded(F.col("text")).alias("line"))


@query("exp_respell", "a_page", "SELECT source, 'run ' || name || '.' || section || ' -x' AS cmd FROM a_page")
def _(spark, d):
    line = F.lit("run tool -x")
    return A.pages(spark, d).select("source", E.respelled(line, F.lit(4), F.lit(8), F.col("name"), F.col("section")).alias("cmd"))


@query("exe_extract")
def _(spark, d):
    docs = A.table(spark, d, "documents").where("text is not null")
    flagged = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.when(i % 4 == 0, F.concat(F.lit("-"), F.lower(F.substring(x, 1, 1)), F.lit(", --"), F.lower(F.substring(x, 1, 3)), F.lit(" "), x)).otherwise(x)), "\n")
    outcomes, _ = X.extract(docs.select(F.col("doc_id").cast("string").alias("source"), flagged.alias("text")), "reader", 20_000)
    return outcomes.select("source", "outcome", "reason", "dashless")


@query("src_log_window", "", """SELECT 'row' AS what, CAST(user_id AS VARCHAR) AS user, count(*) AS n FROM events WHERE event_id % 50 > 0 AND event_id % 7 > 0 AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 12:00:00' GROUP BY 2
UNION ALL SELECT 'rejected', NULL, count(*) FROM events WHERE event_id % 50 = 0""")
def _(spark, d):
    """The event log as JSON lines, some of them broken, some without an address: a window of it through the log source."""
    e, n = A.table(spark, d, "events"), F.col("event_id")
    line = F.when(n % 50 == 0, "{broken").otherwise(F.to_json(F.struct(F.col("ts").cast("string").alias("at"), F.when(n % 7 > 0, F.col("user_id").cast("string")).alias("user"), n.alias("id"))))
    folder = new_folder(spark, "log")
    e.select(line.alias("value")).write.text(folder)
    log = logsource.register(spark).read.format("cliloom_log").option("time", "at")
    window = log.schema("at timestamp, user string, id long").load(folder).where("at >= timestamp '2024-01-05 00:00:00' and at < timestamp '2024-01-20 12:00:00' and user is not null")
    rejected = spark.read.format("cliloom_log").options(time="at", rejects="true").load(folder)
    return window.groupBy(F.lit("row").alias("what"), "user").agg(F.count("*").alias("n")).unionByName(rejected.agg(F.count("*").alias("n")).select(F.lit("rejected").alias("what"), F.lit(None).cast("string").alias("user"), "n"))


@query("snk_page_files", "", """SELECT 'page' AS what, 'doc/' || lang || '/1/d' || doc_id || '.1' AS source, length(text) AS n FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'alias', 'doc/' || lang || '/1/d' || doc_id || '.1', count(*) FROM documents WHERE doc_id % 3 = 0 GROUP BY 2""")
def _(spark, d):
    """Documents as page files, every third with an alias, written in one commit and read back."""
    docs = A.table(spark, d, "documents")
    source = F.concat(F.lit("doc/"), "lang", F.lit("/1/d"), "doc_id", F.lit(".1.gz"))
    rows = docs.select(source.alias("source"), "text", F.when(F.col("doc_id") % 3 == 0, F.array(F.concat(F.lit("other"), "doc_id"))).otherwise(F.array().cast("array<string>")).alias("aliases"))
    folder = new_folder(spark, "pages")
    pagefiles.register(spark)
    rows.write.format("cliloom_pages").mode("append").save(folder)
    pages = pagefiles.read_pages(spark, folder).select(F.lit("page").alias("what"), "source", F.col("length").alias("n"))
    return pages.unionByName(pagefiles.read_aliases(spark, folder).groupBy(F.lit("alias").alias("what"), "source").agg(F.count("*").alias("n")))


@query("exe_batch_job", "", """WITH c AS (SELECT doc_id, length(substr(text, 4000 * k + 1, 4000)) AS n FROM (SELECT doc_id, text, unnest(range(0, greatest(1, (length(text) + 3999) // 4000))) AS k FROM documents WHERE text IS NOT NULL))
SELECT CAST(doc_id AS VARCHAR) AS item, CASE WHEN bool_or(n % 14 = 0) THEN 'failed' ELSE 'success' END AS outcome, count(*) AS chunks, count(*) FILTER (n % 14 > 0) AS done, CASE WHEN bool_or(n % 14 = 0) THEN 'missing' END AS error FROM c GROUP BY 1""")
def _(spark, d):
    """Documents by pieces of 4000 characters; a service that at first loses some and is too busy for others, and loses fewer when asked again."""
    docs = A.table(spark, d, "documents").where("text is not null")
    pieces = docs.select(F.col("doc_id").alias("item"), "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.ceil(F.length("text") / 4000)).cast("int") - 1)).alias("chunk"))
    wanted = pieces.select("item", "chunk", F.substr("text", F.col("chunk") * 4000 + 1, F.lit(4000)).alias("body"))

    def answers(lost, busy):
        return lambda key, body: {"status": F.when(F.length(body) % busy == 0, 503).otherwise(200), "body": F.upper(body), "message": F.lit(None).cast("string"), "present": F.length(body) % lost != 0}

    folder = new_folder(spark, "batches")
    service = B.FolderService(spark, f"{folder}/inbox", answers(7, 11))
    job = B.BatchJob(spark, f"{folder}/job", service)
    job.prepare(wanted)
    for later in (answers(14, 1 << 20), None):
        job.submit()
        service.serve()
        job.collect()
        if later:
            service.answer = later
            job.retry()
    return job.outcomes()


def _streamed(spark, d, make, name, keys=None):
    """The stream's whole output on bounded input, in the sink's folder: rows that are final, or the newest of each key."""
    folder = new_folder(spark, name)
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    log = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)
    out = make(log.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("ip", F.col("user_id").cast("string")))
    if keys:
        logs.upsert_batches(out, f"{folder}/out", keys, f"{folder}/state").awaitTermination()
        return logs.upserted(spark, f"{folder}/out", out.schema, keys)
    logs.append_events(out, f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


@query("stm_minute_burst", "", "SELECT date_trunc('minute', CAST(ts AS TIMESTAMP)) AS minute, CAST(user_id AS VARCHAR) AS ip, count(*) AS hits FROM events GROUP BY 1, 2")
def _(spark, d):
    A.table(spark, d, "events")
    return _streamed(spark, d, logs.minute_bursts, "bursts", ["minute", "ip"]).withColumn("minute", F.col("minute").cast("timestamp_ntz"))


@query("stm_without_overlap", "", "SELECT event_id, user_id FROM events")
def _(spark, d):
    A.table(spark, d, "events")
    return _streamed(spark, d, lambda log: logs.without_overlap(log.unionByName(log), "event_id"), "overlap").select("event_id", "user_id")


@query("stm_running_bursts", "", "SELECT CAST(user_id AS VARCHAR) AS ip, n AS hits FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS n FROM events) WHERE n % 10 = 0")
def _(spark, d):
    A.table(spark, d, "events")
    return _streamed(spark, d, lambda log: logs.running_bursts(log, 10), "running").select("ip", "hits")


@query("exe_resumed", "", """SELECT 'd/' || lang || '/1/p' || doc_id || '.1.gz' AS source, 'success' AS outcome, doc_id % 3 = 0 AS nested FROM documents""")
def _(spark, d):
    """An extraction of a page for each document in two parts, of which one run does the first and another goes on."""
    docs = A.table(spark, d, "documents")
    text = F.concat(F.lit("# SYNOPSIS\ntool "), F.when(F.col("doc_id") % 3 == 0, "command").otherwise("file"), F.lit("\n# OPTIONS\n-a, --all "), F.coalesce("source", F.lit("none")))
    pages = docs.select(F.concat(F.lit("d/"), "lang", F.lit("/1/p"), "doc_id", F.lit(".1.gz")).alias("source"), text.alias("text"))
    folder = new_folder(spark, "extraction")
    Z.run_extraction(pages, "reader", folder, folder, parts=2, most=1)
    Z.run_extraction(pages, "reader", folder, folder, parts=2)
    return Z.extracted(spark, folder)[0].select("source", "outcome", "nested")


@query("lod_layout", "a_page a_map", """SELECT 'point' AS shape, count(*) AS n FROM a_map WHERE src = (SELECT min(p_name) FROM part) UNION ALL SELECT 'in_list', count(*) FROM a_map WHERE src IN (SELECT p_name FROM part ORDER BY p_partkey LIMIT 20)
UNION ALL SELECT 'prefix', count(*) FROM a_map WHERE starts_with(src, 'blue ') UNION ALL SELECT 'by_page', count(*) FROM a_map WHERE dst = (SELECT min(source) FROM a_page)""")
def _(spark, d):
    """Four shapes of lookup on mappings in any order and laid out by name; a shape whose rows aren't the same in both isn't given."""
    maps, part = A.mappings(spark, d), A.table(spark, d, "part")
    names = [r["p_name"] for r in part.orderBy("p_partkey").limit(20).collect()]
    shapes = Y.lookups(part.agg(F.min("p_name")).first()[0], names, "blue ", A.pages(spark, d).agg(F.min("source")).first()[0])
    laid = Y.laid_out(maps, new_folder(spark, "laid"), files=8)
    summary = lambda table, condition: table.where(condition).agg(F.count("*").alias("n"), F.sum(F.xxhash64("src", "dst", "score").cast("decimal(20)")).alias("h"))
    rows = [summary(maps, c).intersect(summary(laid, c)).select(F.lit(shape).alias("shape"), "n") for shape, c in shapes.items()]
    return reduce(DataFrame.unionByName, rows)


@query("stm_sessions", "", """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS ip, epoch_us(ts) // 1000 AS ms FROM events), n AS (SELECT *, coalesce(ms - lag(ms) OVER (PARTITION BY ip ORDER BY ms) >= 7200000, true) AS opens FROM e),
s AS (SELECT *, sum(CAST(opens AS INT)) OVER (PARTITION BY ip ORDER BY ms ROWS UNBOUNDED PRECEDING) AS k FROM n), g AS (SELECT ip, min(ms) AS a, max(ms) AS b, count(*) AS hits FROM s GROUP BY ip, k)
SELECT 'session' AS kind, ip, a AS start, b AS "end", hits FROM g WHERE b + 7200000 <= (SELECT max(ms) FROM e) - 1500000""")
def _(spark, d):
    """Sessions that two hours without a request end, those that are over for sure."""
    A.table(spark, d, "events")
    out = _streamed(N.with_state(spark), d, lambda log: N.sessions(log, gap=120 * N.MINUTE), "sessions")
    return out.select("kind", "ip", F.unix_millis("start").alias("start"), F.unix_millis("end").alias("end"), "hits")


@query("stm_look_back", "", """SELECT u AS until, CAST(user_id AS VARCHAR) AS ip, count(*) AS hits FROM (SELECT user_id, unnest(list_transform(range(1, 6), lambda k: time_bucket(INTERVAL 5 MINUTE, ts) + k * INTERVAL 5 MINUTE)) AS u FROM events) GROUP BY 1, 2""")
def _(spark, d):
    A.table(spark, d, "events")
    return _streamed(spark, d, N.look_back, "lookback", ["until", "ip"]).withColumn("until", F.col("until").cast("timestamp_ntz"))


@query("lod_commands", "", L.commands_sql("events", "event_id"))
def _(spark, d):
    return L.commands(A.table(spark, d, "events"), "event_id")


@query("src_basenames", "a_page", "SELECT DISTINCT name || '.' || section AS name FROM a_page")
def _(spark, d):
    return R.basenames(A.pages(spark, d))


@query("snk_newest_entries", "", "SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def _(spark, d):
    return newest_entries(A.table(spark, d, "events").select("user_id", "event_id"), "user_id", "event_id")


@query("snk_aliases", "a_page", "SELECT source AS alias, first AS source FROM (SELECT source, first_value(source) OVER (PARTITION BY p_name ORDER BY source) AS first, row_number() OVER (PARTITION BY p_name ORDER BY source) AS n FROM a_page) WHERE n > 1")
def _(spark, d):
    return contents_and_aliases(A.pages(spark, d).select(F.col("p_name").alias("hash"), "source"))[1]


@query("stm_batch_window", "a_request", "SELECT event_id, ts FROM a_request WHERE ts >= TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 25 MINUTE")
def _(spark, d):
    return O.in_window(A.requests(spark, d), "ts", 25, F.lit("2024-01-20 00:00:00").cast("timestamp_ntz")).select("event_id", "ts")
