"""Lookups, joins, aggregates, windows and sorts over the stand-in catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import strings as S
from ..operators import analytics as O
from ..operators import catalog as C
from ..sources.folders import new_folder
from ..sources.snapshots import Snapshots
from . import analogs as A
from .registry import query

# Filters.


@query("flt_point", "a_page", "SELECT source, name FROM a_page WHERE source = (SELECT min(source) FROM a_page)")
def _(spark, d):
    p = A.pages(spark, d)
    return C.in_set(p, "source", p.agg(F.min("source").alias("k")), "k").select("source", "name")


@query("flt_prefix", "a_page", "SELECT source, name FROM a_page WHERE starts_with(source, 'brand2/economy/')")
def _(spark, d):
    return C.with_prefix(A.pages(spark, d), "source", "brand2/economy/").select("source", "name")


@query("flt_prefix_range", "a_page", "SELECT source FROM a_page WHERE source >= 'brand2/' AND source < 'brand20'")
def _(spark, d):
    return C.with_prefix_range(A.pages(spark, d), "source", "brand2/").select("source")


@query("flt_contains_space", "a_page, a_map".replace(",", ""), "SELECT src, dst FROM a_map WHERE src LIKE '% %'")
def _(spark, d):
    return A.mappings(spark, d).where(F.col("src").contains(" ")).select("src", "dst")


@query("flt_valid_source", "a_page", "SELECT source, regexp_matches(source, '^[a-zA-Z][a-zA-Z0-9_-]*/[^/]+/[^/]+/[^/]+\\.\\d\\w*\\.gz$') AS valid FROM (SELECT source FROM a_page UNION ALL SELECT '9x/' || source FROM a_page UNION ALL SELECT replace(source, '.gz', '') FROM a_page)")
def _(spark, d):
    s = A.pages(spark, d).select("source")
    every = s.union(s.select(F.concat(F.lit("9x/"), "source"))).union(s.select(F.replace("source", F.lit(".gz"), F.lit(""))))
    return every.select("source", S.is_source("source").alias("valid"))


@query("flt_in_set", "a_page a_map", "SELECT src, dst, score FROM a_map WHERE src IN (SELECT p_name FROM part WHERE p_size = 7)")
def _(spark, d):
    keys = A.table(spark, d, "part").where("p_size = 7").select("p_name")
    return C.in_set(A.mappings(spark, d), "src", keys, "p_name").select("src", "dst", "score")


@query("flt_scope", "a_page", "SELECT source FROM a_page WHERE starts_with(source, 'brand3/small/')")
def _(spark, d):
    return C.in_scope(A.pages(spark, d), "source", "brand3", "small").select("source")


@query("flt_size_bucket", "", "SELECT doc_id, CASE WHEN strlen(text) <= 2048 THEN 'small' ELSE 'large' END AS bucket FROM documents WHERE text IS NOT NULL")
def _(spark, d):
    t = A.table(spark, d, "documents").where("text is not null")
    return t.select("doc_id", F.when(F.octet_length("text") <= 2048, "small").otherwise("large").alias("bucket"))


@query("flt_locale_section", "", "SELECT doc_id, lang, source FROM documents WHERE (lang = '' OR starts_with(lang, 'en')) AND regexp_matches(substr(replace(source, 'src', ''), 1, 1), '\\d') AND substr(replace(source, 'src', ''), 1, 1) IN ('1', '8')")
def _(spark, d):
    first = F.substring(F.replace("source", F.lit("src"), F.lit("")), 1, 1)
    return A.table(spark, d, "documents").where(((F.col("lang") == "") | F.col("lang").startswith("en")) & first.rlike(r"\d") & first.isin("1", "8")).select("doc_id", "lang", "source")


@query("flt_anti_blacklist", "a_page", "SELECT source FROM a_page WHERE source NOT IN (SELECT source FROM a_page WHERE p_size % 5 = 0)")
def _(spark, d):
    p = A.pages(spark, d)
    return C.not_in_set(p.select("source"), "source", p.where("p_size % 5 = 0"), "source")


# Joins.


@query("jon_known_hash", "", "SELECT sha256(text) || ':' || source AS key, min(doc_id) AS first_doc FROM documents WHERE text IS NOT NULL GROUP BY 1")
def _(spark, d):
    docs = A.table(spark, d, "documents").where("text is not null")
    key = S.dedup_key(F.sha2(F.col("text").cast("binary"), 256), F.concat(F.col("source"), F.lit("/x")))
    return docs.groupBy(key.alias("key")).agg(F.min("doc_id").alias("first_doc"))


@query("jon_distros_for_name", "a_page a_map", "SELECT DISTINCT split_part(dst, '/', 1) AS distro, split_part(dst, '/', 2) AS release FROM a_map JOIN a_page ON dst = source WHERE src = 'small ring'")
def _(spark, d):
    return C.distros_for_name("small ring", A.pages(spark, d), A.mappings(spark, d))


@query("jon_two_hop_suggestions", "a_page a_map", """
SELECT DISTINCT o.source, b.dst AS other FROM a_page o JOIN a_map a ON a.dst = o.source JOIN a_map b ON a.src = b.src WHERE b.dst <> o.source""")
def _(spark, d):
    return C.suggestions(A.pages(spark, d), A.mappings(spark, d))


@query("jon_orphan_anti", "a_page a_map", "SELECT src, dst FROM a_map WHERE dst NOT IN (SELECT source FROM a_page WHERE p_size > 10)")
def _(spark, d):
    return C.not_in_set(A.mappings(spark, d).select("src", "dst"), "dst", A.pages(spark, d).where("p_size > 10"), "source")


@query("jon_unreachable_anti", "a_page a_map", "SELECT 'warning' AS severity, 'unreachable' AS code, source || ' has no mapping' AS message FROM a_page WHERE source NOT IN (SELECT dst FROM a_map WHERE score > 3)")
def _(spark, d):
    return C.unreachable_pages(A.pages(spark, d), A.mappings(spark, d).where("score > 3"))


@query("jon_residual", "a_page a_map", "SELECT src, dst, name FROM a_map JOIN a_page ON dst = source WHERE src LIKE '% %' AND src <> name")
def _(spark, d):
    m = A.mappings(spark, d).join(A.pages(spark, d).select("source", "name"), F.col("dst") == F.col("source"))
    return m.where(F.col("src").contains(" ") & (F.col("src") != F.col("name"))).select("src", "dst", "name")


_PARENTS = """, parents AS (SELECT split_part(p_name, ' ', 1) AS name, distro, release, list_sort(list(DISTINCT split_part(p_name, ' ', 2))) AS subcommands FROM a_page WHERE p_size % 3 = 0 GROUP BY ALL)"""


def _parents(spark, d):
    p = A.pages(spark, d).where("p_size % 3 = 0")  # a table of its own: pages that declare subcommands
    return p.groupBy(F.split_part("p_name", F.lit(" "), F.lit(1)).alias("name"), "distro", "release").agg(F.sort_array(F.collect_set(F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("subcommands"))


@query("jon_parent_lookup", "a_page a_map", _PARENTS + """
SELECT CASE WHEN p.name IS NULL THEN 'error' ELSE 'warning' END AS severity, CASE WHEN p.name IS NULL THEN 'parent_missing' ELSE 'not_declared' END AS code, src || ' -> ' || dst AS message
FROM a_map m LEFT JOIN parents p ON p.name = split_part(src, ' ', 1) AND p.distro = split_part(dst, '/', 1) AND p.release = split_part(dst, '/', 2)
WHERE src LIKE '% %' AND (p.name IS NULL OR NOT list_contains(p.subcommands, substr(src, instr(src, ' ') + 1)))""")
def _(spark, d):
    return C.stale_subcommands(A.pages(spark, d), A.mappings(spark, d), _parents(spark, d))


@query("jon_explode_subcommand", "a_page", _PARENTS + """
SELECT DISTINCT p.name || ' ' || s AS src, c.source AS dst FROM (SELECT name, distro, release, unnest(subcommands) AS s FROM parents) p
JOIN (SELECT *, replace(p_name, ' ', '-') AS child FROM a_page) c ON c.child = p.name || '-' || s AND c.distro = p.distro AND c.release = p.release""")
def _(spark, d):
    children = A.pages(spark, d).withColumn("name", F.replace("p_name", F.lit(" "), F.lit("-")))
    return C.valid_subcommands(_parents(spark, d), children)


@query("jon_star", "", """SELECT r_name, n_name, c_mktsegment, count(*) AS n_lines, round(sum(l_extendedprice), 2) AS total
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def _(spark, d):
    t = lambda n: A.table(spark, d, n)
    # The dimensions are small enough for the optimizer to broadcast; the fact table is only probed.
    j = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return j.groupBy("r_name", "n_name", "c_mktsegment").agg(F.count("*").alias("n_lines"), F.round(F.sum("l_extendedprice"), 2).alias("total"))


@query("jon_semi", "", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def _(spark, d):
    return C.in_set(A.table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", A.table(spark, d, "lineitem").where("l_quantity > 45"), "l_orderkey")


@query("jon_id_remap", "", "SELECT count(*) FILTER (c_custkey IS NOT NULL) AS mapped, count(*) FILTER (c_custkey IS NULL) AS skipped FROM orders LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 > 0) ON o_custkey = c_custkey")
def _(spark, d):
    known = A.table(spark, d, "customer").where("c_custkey % 3 > 0").select("c_custkey")
    j = A.table(spark, d, "orders").join(known, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.agg(F.count("c_custkey").alias("mapped"), F.count_if(F.col("c_custkey").isNull()).alias("skipped"))


@query("jon_interval", "", """, m AS (SELECT conv_id, turn, turn * 100 AS s, turn * 100 + least(length(text), 150) AS e FROM conversations), x AS (SELECT conv_id, turn * 100 + 20 AS xs, turn * 100 + 60 AS xe FROM conversations WHERE role = 'assistant')
SELECT m.conv_id, m.turn, count(x.xs) AS inside FROM m LEFT JOIN x ON x.conv_id = m.conv_id AND m.s <= x.xs AND x.xe <= m.e GROUP BY 1, 2""".replace(", m AS", "WITH m AS", 1))
def _(spark, d):
    c = A.table(spark, d, "conversations")
    m = c.select("conv_id", "turn", (F.col("turn") * 100).alias("s"), (F.col("turn") * 100 + F.least(F.length("text"), F.lit(150))).alias("e"))
    x = c.where("role = 'assistant'").select(F.col("conv_id").alias("k"), (F.col("turn") * 100 + 20).alias("xs"), (F.col("turn") * 100 + 60).alias("xe"))
    # Equal conversation first: the range only narrows a group.
    j = m.join(x, (F.col("conv_id") == F.col("k")) & (F.col("s") <= F.col("xs")) & (F.col("xe") <= F.col("e")), "left")
    return j.groupBy("conv_id", "turn").agg(F.count("xs").alias("inside"))


@query("jon_set_probe", "a_page", """, tok AS (SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\t\\n|&;<>()"''`$={}]')) AS t FROM documents), names AS (SELECT DISTINCT lower(line) AS t FROM (SELECT unnest(string_split(text, ' ')) AS line FROM documents WHERE doc_id % 50 = 0))
SELECT doc_id, count(*) AS hits FROM tok WHERE t <> '' AND t IN (SELECT t FROM names) GROUP BY 1""")
def _(spark, d):
    docs = A.table(spark, d, "documents")
    tokens = docs.select("doc_id", F.explode(S.command_tokens("text")).alias("t"))
    names = docs.where("doc_id % 50 = 0").select(F.explode(F.split(F.lower("text"), " ")).alias("t"))
    return C.in_set(tokens, "t", names, "t").groupBy("doc_id").agg(F.count("*").alias("hits"))


@query("jon_distros_with_all", "a_page a_map", "SELECT split_part(dst, '/', 1) AS distro, split_part(dst, '/', 2) AS release FROM a_map WHERE src IN ('small ring', 'red widget') GROUP BY ALL HAVING count(DISTINCT src) = 2")
def _(spark, d):
    return C.distros_with_all(["small ring", "red widget"], A.pages(spark, d), A.mappings(spark, d))


# Aggregates.


@query("agg_counts", "a_page a_map", "SELECT (SELECT count(*) FROM a_page) AS manpages, (SELECT count(*) FROM a_map) AS mappings, (SELECT count(*) FROM events) AS events")
def _(spark, d):
    n = [df.agg(F.count("*").alias(c)) for c, df in (("manpages", A.pages(spark, d)), ("mappings", A.mappings(spark, d)), ("events", A.table(spark, d, "events")))]
    return n[0].join(n[1]).join(n[2])  # three single rows


@query("agg_group_derived", "a_page", "SELECT distro, release, count(*) AS n FROM a_page GROUP BY 1, 2 ORDER BY 1, 2")
def _(spark, d):
    return A.pages(spark, d).groupBy(S.distro("source").alias("distro"), S.release("source").alias("release")).agg(F.count("*").alias("n")).orderBy("distro", "release")


@query("agg_distinct_pairs", "a_page", "SELECT DISTINCT distro, release FROM a_page")
def _(spark, d):
    return C.distro_releases(A.pages(spark, d))


@query("agg_sections", "a_page", "SELECT DISTINCT split_part(source, '/', 3) AS section FROM a_page WHERE starts_with(source, 'brand2/economy/')")
def _(spark, d):
    return C.sections(A.pages(spark, d), "brand2", "economy")


@query("agg_having_single", "", "SELECT p_name, p_size FROM part GROUP BY p_name, p_size HAVING count(*) = 1")
def _(spark, d):
    return A.table(spark, d, "part").groupBy("p_name", "p_size").agg(F.count("*").alias("n")).where("n = 1").select("p_name", "p_size")


@query("agg_having_multi", "", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def _(spark, d):
    return A.table(spark, d, "part").groupBy("p_name").agg(F.count("*").alias("n")).where("n > 1")


_COUNTS = "(SELECT o_orderkey, count(l_orderkey) * 4 - 4 AS n FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)"


def _counts(spark, d):
    o, l = A.table(spark, d, "orders"), A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("c"))
    return o.join(l, F.col("l_orderkey") == F.col("o_orderkey"), "left").select("o_orderkey", (F.coalesce("c", F.lit(0)) * 4 - 4).alias("n"))


@query("agg_histogram", "", f"""SELECT CAST(b.place AS BIGINT) AS place, b.bucket, count(c.n) AS pages FROM (VALUES (0, '0', 0, 0), (1, '1-5', 1, 5), (2, '6-15', 6, 15), (3, '16-50', 16, 50), (4, '50+', 51, 1000000)) b(place, bucket, lo, hi)
LEFT JOIN (SELECT greatest(n, 0) AS n FROM {_COUNTS}) c ON c.n BETWEEN b.lo AND b.hi GROUP BY 1, 2""")
def _(spark, d):
    return O.option_histogram(_counts(spark, d).select(F.greatest("n", F.lit(0)).alias("n")), "n")


@query("agg_summary", "", f"""SELECT count(n) AS n, CAST(sum(n) AS BIGINT) AS total, round(avg(n), 2) AS mean, median(n) AS median, max(n) AS most,
(SELECT s[i] + (0.9 * (len(s) + 1) - i) * (s[i + 1] - s[i]) FROM (SELECT list_sort(list(n)) AS s, CAST(floor(0.9 * (count(*) + 1)) AS INT) AS i FROM {_COUNTS})) AS p90 FROM {_COUNTS}""")
def _(spark, d):
    return O.count_summary(_counts(spark, d), "n")


@query("agg_p90_exclusive", "", """SELECT o_orderpriority, CASE WHEN len(s) = 1 THEN s[1] ELSE s[i] + (0.9 * (len(s) + 1) - i) * (s[i + 1] - s[i]) END AS p90
FROM (SELECT *, greatest(least(CAST(floor(0.9 * (len(s) + 1)) AS INT), len(s) - 1), 1) AS i FROM (SELECT o_orderpriority, list_sort(list(o_totalprice)) AS s FROM orders GROUP BY 1))""")
def _(spark, d):
    return O.exclusive_quantiles(A.table(spark, d, "orders"), "o_totalprice", ["o_orderpriority"], 0.9)


@query("agg_index_percentile", "", """SELECT event_type, n, round(mean, 6) AS mean, least, most, median, s[least(n, CAST(floor(0.5 * n) AS INT) + 1)] AS p50, s[least(n, CAST(floor(0.95 * n) AS INT) + 1)] AS p95, s[least(n, CAST(floor(0.99 * n) AS INT) + 1)] AS p99
FROM (SELECT event_type, count(*) AS n, avg(value) AS mean, min(value) AS least, max(value) AS most, median(value) AS median, list_sort(list(value)) AS s FROM events GROUP BY 1)""")
def _(spark, d):
    return O.latency_summary(A.table(spark, d, "events"), "value", ["event_type"]).withColumn("mean", F.round("mean", 6))


@query("agg_time_bucket_zero_fill", "", """WITH e AS (SELECT (date_diff('second', TIMESTAMP '2024-01-01', ts)) AS t, event_type <> 'error' AS ok, value FROM events),
g AS (SELECT t // 600 AS bucket, count(*) AS n, count(*) FILTER (ok) AS ok, list_sort(coalesce(list(value) FILTER (ok), [])) AS s FROM e GROUP BY 1)
SELECT b.bucket, coalesce(n, 0) AS n, coalesce(ok, 0) AS ok, coalesce(n, 0) - coalesce(ok, 0) AS fail, coalesce(n, 0) / 600 AS rate, s[least(len(s), CAST(floor(0.5 * len(s)) AS INT) + 1)] AS p50, s[least(len(s), CAST(floor(0.95 * len(s)) AS INT) + 1)] AS p95, s[least(len(s), CAST(floor(0.99 * len(s)) AS INT) + 1)] AS p99, s[-1] AS most
FROM (SELECT unnest(range(0, (SELECT max(bucket) + 1 FROM g))) AS bucket) b LEFT JOIN g ON g.bucket = b.bucket""")
def _(spark, d):
    e = A.table(spark, d, "events")
    e = e.select((F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lit("2024-01-01").cast("timestamp"))).alias("t"), (F.col("event_type") != "error").alias("ok"), "value")
    return O.time_buckets(e, "t", "ok", "value", 600)


@query("agg_topn_ratio", "a_request", "SELECT ua, count(*) AS hits, count(DISTINCT ip) AS ips, round(count(*) FILTER (status = 200) / count(*), 3) AS ok_ratio FROM a_request GROUP BY 1 ORDER BY hits DESC, ua LIMIT 50")
def _(spark, d):
    return O.top_agents(A.requests(spark, d))


@query("agg_mode", "a_request", """SELECT ip, CAST(sum(c) AS BIGINT) AS hits, first(ua ORDER BY c DESC, ua) AS top_ua, min(u) AS sample_uri FROM (SELECT ip, ua, count(*) AS c, min(uri) AS u FROM a_request GROUP BY 1, 2) GROUP BY 1 ORDER BY hits DESC, ip LIMIT 100""")
def _(spark, d):
    return O.top_ips(A.requests(spark, d))


@query("agg_slash24", "a_request", "SELECT array_to_string(string_split(ip, '.')[1:3], '.') || '.0' AS net, count(*) AS hits, count(DISTINCT ip) AS ips, count(DISTINCT ua) AS uas FROM a_request GROUP BY 1 ORDER BY hits DESC, net LIMIT 100")
def _(spark, d):
    return O.top_networks(A.requests(spark, d))


@query("agg_shape", "a_request", """, c AS (SELECT ip, CASE WHEN uri LIKE '/explain?cmd=tar%' THEN 'tar -x ' || (json->>'$.k') ELSE 'ls | wc -l' END AS cmd FROM a_request WHERE uri LIKE '/explain%')
SELECT split_part(cmd, ' ', 1) || ':args=' || (len(string_split(cmd, ' ')) - 1) || ':pipes=' || (len(string_split(cmd, '|')) - 1) AS shape, count(*) AS hits, count(DISTINCT ip) AS ips FROM c GROUP BY 1 ORDER BY hits DESC, shape LIMIT 50""")
def _(spark, d):
    return O.top_shapes(A.requests(spark, d))


@query("agg_status_mix", "a_request", """SELECT split_part(uri, '?', 1) AS path, count(*) AS hits, count(*) FILTER (status BETWEEN 200 AND 299) AS s2xx, count(*) FILTER (status BETWEEN 300 AND 399) AS s3xx, count(*) FILTER (status BETWEEN 400 AND 499) AS s4xx, count(*) FILTER (status BETWEEN 500 AND 599) AS s5xx
FROM a_request GROUP BY 1 ORDER BY hits DESC, path LIMIT 50""")
def _(spark, d):
    return O.top_paths(A.requests(spark, d))


@query("agg_minute_burst", "a_request", "SELECT date_trunc('minute', ts) AS minute, ip, count(*) AS hits FROM a_request GROUP BY 1, 2 ORDER BY hits DESC, minute, ip LIMIT 20")
def _(spark, d):
    return O.top_bursts(A.requests(spark, d))


@query("agg_merge_positionals", "", "SELECT o_custkey AS page, o_orderpriority AS name, string_agg(o_orderstatus || o_orderkey, chr(10) || chr(10) ORDER BY o_orderkey) AS text, min(o_orderkey) AS first FROM orders GROUP BY 1, 2")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderpriority").alias("name"), F.concat("o_orderstatus", "o_orderkey").alias("text"), F.col("o_orderkey").alias("pos"))
    return O.merge_positionals(o, "page", "name", "text", "pos")


@query("agg_first_prefix", "", "SELECT o_custkey AS page, o_orderpriority AS name, min_by(o_orderstatus, o_orderkey) AS prefix FROM orders GROUP BY 1, 2")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_custkey").alias("page"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("sigil"), F.col("o_orderkey").alias("pos"))
    return O.first_prefix(o, "page", "name", "sigil", "pos")


@query("agg_chunk_fold", "", "SELECT l_orderkey AS page, bool_or(l_quantity > 40) AS dashless, list(l_partkey ORDER BY l_linenumber, l_partkey) AS parts, CAST(sum(l_linenumber) AS BIGINT) AS chunks FROM lineitem GROUP BY 1")
def _(spark, d):
    l = A.table(spark, d, "lineitem")
    parts = F.transform(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))), lambda x: x["l_partkey"])
    return l.groupBy(F.col("l_orderkey").alias("page")).agg(F.bool_or(F.col("l_quantity") > 40).alias("dashless"), parts.alias("parts"), F.sum("l_linenumber").alias("chunks"))


@query("agg_outcomes", "", "SELECT count(*) FILTER (o_orderstatus = 'F') AS succeeded, count(*) FILTER (o_orderstatus = 'O') AS skipped, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS failed, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS cost FROM orders")
def _(spark, d):
    o, s = A.table(spark, d, "orders"), F.col("o_orderstatus")
    return o.agg(F.count_if(s == "F").alias("succeeded"), F.count_if(s == "O").alias("skipped"), F.count_if(~s.isin("F", "O")).alias("failed"), F.round(F.sum(F.when(s == "F", F.col("o_totalprice"))), 2).alias("cost"))


@query("agg_event_delta", "", "SELECT user_id, max_by(value, event_id) - min_by(value, event_id) AS delta FROM events GROUP BY 1")
def _(spark, d):
    return A.table(spark, d, "events").groupBy("user_id").agg((F.max_by("value", "event_id") - F.min_by("value", "event_id")).alias("delta"))


# Windows.


@query("win_rank_pick", "", """, r AS (SELECT o_custkey % 500 AS key, o_orderpriority AS package, o_orderdate AS released, o_orderkey AS hash, o_orderstatus = 'F' AS standard FROM orders),
a AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY key, package ORDER BY released DESC, hash) = 1),
b AS (SELECT * FROM (SELECT *, bool_or(standard) OVER (PARTITION BY key) AS any_std FROM a) WHERE standard OR NOT any_std)
SELECT key, package, released, hash, standard FROM b QUALIFY row_number() OVER (PARTITION BY key ORDER BY released DESC, hash, package) = 1""".replace(", r AS", "WITH r AS", 1))
def _(spark, d):
    o = A.table(spark, d, "orders")
    return O.rank_then_pick(o.select((F.col("o_custkey") % 500).alias("key"), F.col("o_orderpriority").alias("package"), F.col("o_orderdate").alias("released"), F.col("o_orderkey").alias("hash"), (F.col("o_orderstatus") == "F").alias("standard")))


@query("win_islands", "", "SELECT o_custkey, min(o_orderkey) AS first, max(o_orderkey) AS last, count(*) AS n FROM (SELECT *, o_orderkey - row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) GROUP BY o_custkey, i")
def _(spark, d):
    return O.islands(A.table(spark, d, "orders"), ["o_custkey"], "o_orderkey")


_SPANS = "(SELECT conv_id, turn * 10 AS s, turn * 10 + 10 - CASE WHEN turn % 3 = 0 THEN 2 ELSE 0 END AS e, CASE WHEN turn % 4 < 2 THEN 'a' ELSE role END AS text FROM conversations)"


def _spans(spark, d):
    c, t = A.table(spark, d, "conversations"), F.col("turn")
    return c.select("conv_id", (t * 10).alias("s"), (t * 10 + 10 - F.when(t % 3 == 0, 2).otherwise(0)).alias("e"), F.when(t % 4 < 2, "a").otherwise(F.col("role")).alias("text"))


@query("win_merge_adjacent", "", f"""SELECT conv_id, min(s) AS s, max(e) AS e, first(text) AS text FROM (SELECT *, sum(c) OVER (PARTITION BY conv_id ORDER BY s) AS g FROM (SELECT *, CASE WHEN text = lag(text) OVER (PARTITION BY conv_id ORDER BY s) AND s = lag(e) OVER (PARTITION BY conv_id ORDER BY s) THEN 0 ELSE 1 END AS c FROM {_SPANS})) GROUP BY conv_id, g""")
def _(spark, d):
    return O.merge_adjacent(_spans(spark, d), "conv_id", "s", "e", "text")


@query("win_lead_spaces", "", f"SELECT *, coalesce(lead(s) OVER (PARTITION BY conv_id ORDER BY s) - e, 0) AS spaces FROM {_SPANS}")
def _(spark, d):
    return O.spaces_between(_spans(spark, d), "conv_id", "s", "e")


@query("win_first_seen_id", "", "WITH f AS (SELECT user_id, event_type, min(event_id) AS f FROM events GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY f) - 1 AS id FROM f) SELECT e.event_id, e.user_id, e.event_type, i.id FROM events e JOIN i USING (user_id, event_type)")
def _(spark, d):
    return O.first_seen_ids(A.table(spark, d, "events").select("event_id", "user_id", "event_type"), "user_id", "event_id", "event_type")


@query("win_first_canonical", "", "SELECT doc_id, first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS canonical, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS place, doc_id = first_value(doc_id) OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS is_first FROM documents")
def _(spark, d):
    docs = A.table(spark, d, "documents")
    return O.first_canonical(docs.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha")), F.col("sha"), "doc_id", "doc_id").select("doc_id", "canonical", "place", "is_first")


@query("win_section_fill", "a_line", "SELECT doc_id, n, CAST(sum(CASE WHEN length(line) <= 40 AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS BIGINT) AS section FROM a_line")
def _(spark, d):
    return O.section_fill(A.lines(spark, d), "doc_id", "n", F.length("line") <= 40).select("doc_id", "n", "section")


@query("win_bin_packing", "", """WITH RECURSIVE i AS (SELECT l_suppkey AS g, CAST(l_linenumber AS BIGINT) + l_orderkey * 10 AS o, CAST(trunc(l_quantity) AS BIGINT) AS s, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey * 10 + l_linenumber, CAST(trunc(l_quantity) AS BIGINT)) AS r FROM lineitem),
f AS (SELECT g, o, r, s AS used, 0::BIGINT AS batch FROM i WHERE r = 1
UNION ALL SELECT i.g, i.o, i.r, CASE WHEN f.used > 0 AND f.used + i.s > 60 THEN i.s ELSE f.used + i.s END, CASE WHEN f.used > 0 AND f.used + i.s > 60 THEN f.batch + 1 ELSE f.batch END FROM f JOIN i ON i.g = f.g AND i.r = f.r + 1)
SELECT g, o, batch FROM f""")
def _(spark, d):
    l = A.table(spark, d, "lineitem")
    return O.greedy_batches(l.select(F.col("l_suppkey").alias("g"), (F.col("l_linenumber") + F.col("l_orderkey") * 10).alias("o"), F.col("l_quantity").cast("int").alias("s")), "g", "o", "s", 60)


# Sorts.


@query("srt_rank_candidates", "a_page a_map", "SELECT src, dst, score, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM a_map")
def _(spark, d):
    m = A.mappings(spark, d)
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("src").orderBy(F.desc("score"), "dst")))


@query("srt_section_first", "a_page", "SELECT p_name, source, row_number() OVER (PARTITION BY p_name ORDER BY section = '3' DESC, score DESC, source) AS rank FROM a_page")
def _(spark, d):
    w = Window.partitionBy("p_name").orderBy(F.desc(F.col("section") == "3"), F.desc("score"), "source")
    return A.pages(spark, d).select("p_name", "source", F.row_number().over(w).alias("rank"))


@query("srt_latest_n", "", "SELECT event_id, event_type FROM events WHERE event_type = 'error' ORDER BY event_id DESC LIMIT 20")
def _(spark, d):
    return O.latest(A.table(spark, d, "events").where("event_type = 'error'"), "event_id", "event_id").select("event_id", "event_type")


@query("srt_latest_samples", "a_request", "SELECT event_id, ts, ip FROM a_request WHERE status = 200 ORDER BY ts DESC, event_id DESC LIMIT 20")
def _(spark, d):
    return O.latest(A.requests(spark, d).where("status = 200"), "ts", "event_id").select("event_id", "ts", "ip")


@query("srt_version_sort", "a_page", "SELECT distro, max([section::INT, score, p_size]) AS newest FROM a_page GROUP BY 1")
def _(spark, d):
    v = F.concat_ws(".", "section", "score", F.col("p_size").cast("string"))
    return A.pages(spark, d).groupBy("distro").agg(F.max(S.version_key(v)).alias("newest"))


@query("srt_stratified", "", "SELECT o_orderpriority, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderpriority ORDER BY md5('7' || o_orderkey)) <= 5")
def _(spark, d):
    return O.stratified(A.table(spark, d, "orders").select("o_orderpriority", "o_orderkey"), "o_orderpriority", 5, F.md5(F.concat(F.lit("7"), F.col("o_orderkey").cast("string"))))


@query("srt_worst_disagreement", "", "SELECT l_orderkey, count(*) FILTER (l_returnflag = 'A') AS only_l, count(*) FILTER (l_returnflag = 'N') AS only_r FROM lineitem GROUP BY 1 ORDER BY only_l + only_r DESC, l_orderkey LIMIT 10")
def _(spark, d):
    l = A.table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("only_l"), F.count_if(F.col("l_returnflag") == "N").alias("only_r"))
    return l.orderBy(F.desc(F.col("only_l") + F.col("only_r")), "l_orderkey").limit(10)


@query("srt_distro_preference", "a_page", "SELECT distro, release, row_number() OVER (ORDER BY distro = 'brand2' DESC, release DESC, distro) AS rank FROM (SELECT DISTINCT distro, release FROM a_page)")
def _(spark, d):
    return C.preference(C.distro_releases(A.pages(spark, d)), "brand2")


# Sets.


@query("set_union_all", "a_request", "SELECT event_id, ip FROM a_request WHERE status = 500 AND event_id % 2 = 0 UNION ALL SELECT event_id, ip FROM a_request WHERE status = 500 AND event_id % 3 = 0")
def _(spark, d):
    r = A.requests(spark, d)
    return O.hot_and_archive(r.where("event_id % 2 = 0"), r.where("event_id % 3 = 0"), F.col("status") == 500).select("event_id", "ip")


@query("set_except", "", "SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def _(spark, d):
    o = A.table(spark, d, "orders")
    return o.where("o_orderstatus = 'F'").select("o_custkey").subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("set_intersect", "a_page", "SELECT distro, release FROM a_page WHERE p_name = 'small ring' INTERSECT SELECT distro, release FROM a_page WHERE p_name = 'red widget'")
def _(spark, d):
    p = A.pages(spark, d)
    return p.where("p_name = 'small ring'").select("distro", "release").intersect(p.where("p_name = 'red widget'").select("distro", "release"))


@query("set_array_ops", "a_option", """, k AS (SELECT page, list_sort(list(DISTINCT CAST(idx AS BIGINT)) FILTER (qty > 10)) AS a, list_sort(list(DISTINCT CAST(idx AS BIGINT)) FILTER (qty < 40)) AS b FROM a_option GROUP BY 1)
SELECT page, list_sort(list_filter(coalesce(a, []), lambda x: NOT list_contains(coalesce(b, []), x))) AS only_a, list_sort(list_filter(coalesce(a, []), lambda x: list_contains(coalesce(b, []), x))) AS both_ab FROM k""")
def _(spark, d):
    o = A.options(spark, d)
    k = o.groupBy("page").agg(F.collect_set(F.when(F.col("qty") > 10, F.col("idx").cast("long"))).alias("a"), F.collect_set(F.when(F.col("qty") < 40, F.col("idx").cast("long"))).alias("b"))
    return k.select("page", F.sort_array(F.array_except("a", "b")).alias("only_a"), F.sort_array(F.array_intersect("a", "b")).alias("both_ab"))


@query("set_lost_mappings", "a_page a_map", "SELECT src, dst FROM a_map m WHERE dst IN (SELECT source FROM a_page WHERE p_size % 4 = 0) AND NOT EXISTS (SELECT 1 FROM a_page p WHERE p.source = m.dst AND p.p_name = m.src AND p.p_partkey % 3 > 0)")
def _(spark, d):
    """Every fourth page comes again, two of three with their old name."""
    p = A.pages(spark, d).where("p_size % 4 = 0")
    return C.lost_on_reimport(A.mappings(spark, d), p, p.where("p_partkey % 3 > 0").select(F.col("p_name").alias("src"), F.col("source").alias("dst"))).select("src", "dst")


# Lookups, checks, changes.


@query("lkp_find_page", "a_page a_map", """, q AS (SELECT min(p_partkey) AS query_id, p_name AS name FROM part GROUP BY p_name)
SELECT query_id, q.name AS asked, source, a_page.name AS page, section, m.score, row_number() OVER (PARTITION BY query_id ORDER BY m.score DESC, source) AS rank, CAST(NULL AS VARCHAR) AS error FROM q JOIN a_map m ON src = q.name JOIN a_page ON dst = source""")
def _(spark, d):
    names = A.table(spark, d, "part").groupBy(F.col("p_name").alias("name")).agg(F.min("p_partkey").alias("query_id"))
    return C.find_pages(names, A.pages(spark, d), A.mappings(spark, d))


@query("lkp_find_odd_names", "a_page a_map", """, q AS (SELECT * FROM (SELECT CAST(1 AS BIGINT) AS query_id, min(source) AS name FROM a_page UNION ALL SELECT 2, 'small ring.3' UNION ALL SELECT 3, 'small ring.none' UNION ALL SELECT 4, 'no such program.1' UNION ALL SELECT 5, 'nothing' UNION ALL SELECT 6, '.')),
hit AS (SELECT CAST(1 AS BIGINT) AS query_id, source, 10 AS score, section, 0 AS pref FROM a_page WHERE source = (SELECT min(source) FROM a_page) UNION ALL SELECT 2, dst, m.score, section, CASE WHEN section = '3' THEN 0 ELSE 1 END FROM a_map m JOIN a_page ON dst = source WHERE src = 'small ring' AND EXISTS (SELECT 1 FROM a_page WHERE p_name = 'small ring' AND section = '3'))
SELECT query_id, q.name AS asked, p.source, p.name AS page, p.section, hit.score, row_number() OVER (PARTITION BY query_id ORDER BY pref, hit.score DESC, p.source) AS rank, CAST(NULL AS VARCHAR) AS error FROM hit JOIN q USING (query_id) JOIN a_page p ON p.source = hit.source
UNION ALL SELECT query_id, name, NULL, NULL, NULL, NULL, NULL, CASE query_id WHEN 4 THEN 'no such program' ELSE name END FROM q WHERE query_id NOT IN (SELECT query_id FROM hit)""")
def _(spark, d):
    p = A.pages(spark, d)
    odd = spark.createDataFrame([(2, "small ring.3"), (3, "small ring.none"), (4, "no such program.1"), (5, "nothing"), (6, ".")], "query_id int, name string")
    return C.find_pages(p.agg(F.lit(1).alias("query_id"), F.min("source").alias("name")).unionByName(odd), p, A.mappings(spark, d))


@query("lkp_distro_anchor", "a_page a_map", """, q AS (SELECT conv_id AS query_id, turn AS pos, list_extract(['small ring', 'red widget', 'steel bolt', 'blue gear'], CAST(1 + (conv_id + turn) % 4 AS INT)) AS name FROM conversations),
r AS (SELECT distro, release, row_number() OVER (ORDER BY distro = 'brand2' DESC, release DESC, distro) AS rank FROM (SELECT DISTINCT distro, release FROM a_page)),
f AS (SELECT query_id, pos, q.name, a.distro, a.release, min(source) AS source FROM q JOIN a_map ON src = q.name JOIN a_page a ON dst = source GROUP BY ALL),
a AS (SELECT query_id, distro, release FROM f JOIN r USING (distro, release) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY pos, rank) = 1)
SELECT f.* FROM f JOIN a USING (query_id, distro, release)""")
def _(spark, d):
    c, p = A.table(spark, d, "conversations"), A.pages(spark, d)
    name = F.element_at(F.array(*map(F.lit, ["small ring", "red widget", "steel bolt", "blue gear"])), (1 + (F.col("conv_id") + F.col("turn")) % 4).cast("int"))
    q = c.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), name.alias("name"))
    m = A.mappings(spark, d).select(F.col("src").alias("name"), "dst").join(p.select("source", "distro", "release").hint("merge"), F.col("dst") == F.col("source"))
    places = m.groupBy("name", "distro", "release").agg(F.min("source").alias("source"))
    return C.anchored_lookup(q, places, C.preference(C.distro_releases(p), "brand2"))


_CHECK_TABLES = _PARENTS + ", pg AS (SELECT * FROM a_page), mp AS (SELECT * FROM a_map WHERE score > 3 UNION ALL SELECT src, 'gone/' || dst, score FROM a_map WHERE score = 3)"
_CHECK_ROWS = """SELECT 'error' AS severity, 'malformed_source' AS code, 'malformed source: ' || source AS message FROM pg WHERE NOT regexp_matches(source, '^[a-zA-Z][a-zA-Z0-9_-]*/[^/]+/[^/]+/[^/]+\\.\\d\\w*\\.gz$')
UNION ALL SELECT 'error', 'shadowed', source || ' is shadowed by ' || first FROM (SELECT source, first_value(source) OVER w AS first, row_number() OVER w AS n FROM (SELECT *, replace(p_name, ' ', '-') AS nm FROM pg) WINDOW w AS (PARTITION BY nm, section, distro, release ORDER BY source)) WHERE n > 1
UNION ALL SELECT 'error', 'orphan', 'mapping ' || src || ' leads to missing ' || dst FROM mp WHERE dst NOT IN (SELECT source FROM pg)
UNION ALL SELECT CASE WHEN p.name IS NULL THEN 'error' ELSE 'warning' END, CASE WHEN p.name IS NULL THEN 'parent_missing' ELSE 'not_declared' END, src || ' -> ' || dst FROM (SELECT * FROM mp WHERE dst IN (SELECT source FROM pg)) m LEFT JOIN parents p ON p.name = split_part(src, ' ', 1) AND p.distro = split_part(dst, '/', 1) AND p.release = split_part(dst, '/', 2)
  WHERE src LIKE '% %' AND (p.name IS NULL OR NOT list_contains(p.subcommands, substr(src, instr(src, ' ') + 1)))
UNION ALL SELECT 'warning', 'unreachable', source || ' has no mapping' FROM pg WHERE source NOT IN (SELECT dst FROM mp)"""


def _checked(spark, d):
    p, m = A.pages(spark, d), A.mappings(spark, d)
    m = m.where("score > 3").unionByName(m.where("score = 3").withColumn("dst", F.concat(F.lit("gone/"), "dst")))
    return C.check_all(p.withColumn("name", F.replace("p_name", F.lit(" "), F.lit("-"))), m, _parents(spark, d))


@query("chk_all", "a_page a_map", f"{_CHECK_TABLES} {_CHECK_ROWS}")
def _(spark, d):
    return _checked(spark, d)


@query("chk_counts", "a_page a_map", f"{_CHECK_TABLES}, ck AS ({_CHECK_ROWS}) SELECT severity, count(*) AS n FROM ck GROUP BY 1")
def _(spark, d):
    return C.issue_counts(_checked(spark, d))


@query("chk_corrupt_options", "a_page", "SELECT 'error' AS severity, 'corrupt_options' AS code, source || ' has options that are no JSON' AS message FROM a_page WHERE p_size % 4 = 1")
def _(spark, d):
    size = F.col("p_size") % 4
    return C.corrupt_options(A.pages(spark, d).withColumn("options", F.when(size == 0, '[{"short": ["-a"]}]').when(size == 1, '[{"short": ["-a"').when(size == 2, "")), "options")


@query("flt_mapping_score", "a_page a_map", "SELECT src, dst, CASE WHEN score > 3 THEN score END AS score FROM a_map")
def _(spark, d):
    m = A.mappings(spark, d)
    return C.mapping_scores(m, m.where("score > 3"))


@query("agg_failures", "", """WITH f AS (SELECT * FROM orders WHERE o_orderstatus <> 'O') SELECT 'status' AS kind, o_orderstatus AS value, count(*) AS n FROM f GROUP BY 2
UNION ALL SELECT 'error', e, n FROM (SELECT CAST(o_custkey % 50 AS VARCHAR) AS e, count(*) AS n, min(o_orderkey) AS first FROM f GROUP BY 1 ORDER BY first, e LIMIT 10)""")
def _(spark, d):
    o = A.table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), (F.col("o_orderstatus") == "O").alias("ok"), (F.col("o_custkey") % 50).cast("string").alias("error"), "o_orderkey")
    return O.failure_report(o, "ok", "status", "error", "o_orderkey")


@query("agg_bucket_report", "", "SELECT l_returnflag AS bucket, count(*) AS n, avg(l_linenumber) AS mean_l_linenumber, median(l_linenumber) AS median_l_linenumber, median(l_extendedprice) AS median_l_extendedprice FROM lineitem GROUP BY 1")
def _(spark, d):
    return O.bucket_report(A.table(spark, d, "lineitem"), "l_returnflag", ["l_linenumber"], ["l_linenumber", "l_extendedprice"])


@query("dml_upsert", "a_page", "SELECT source, p_retailprice FROM a_page WHERE p_size % 2 = 0 AND p_size % 3 > 0 UNION ALL SELECT source, p_retailprice + 1 FROM a_page WHERE p_size % 3 = 0")
def _(spark, d):
    p = A.pages(spark, d).select("source", "p_retailprice", "p_size")
    old, new = p.where("p_size % 2 = 0").drop("p_size"), p.where("p_size % 3 = 0").select("source", (F.col("p_retailprice") + 1).alias("p_retailprice"))
    return C.upsert(old, new, "source")


@query("dml_delete_cascade", "a_page a_map", "SELECT 'page' AS kind, source AS key FROM a_page WHERE p_size % 4 > 0 UNION ALL SELECT 'mapping', src || ' ' || dst FROM a_map WHERE dst NOT IN (SELECT source FROM a_page WHERE p_size % 4 = 0)")
def _(spark, d):
    p, m = A.pages(spark, d), A.mappings(spark, d)
    pages, _, maps = C.delete_pages(p.where("p_size % 4 = 0"), p, p, m)
    return pages.select(F.lit("page").alias("kind"), F.col("source").alias("key")).unionByName(maps.select(F.lit("mapping").alias("kind"), F.concat_ws(" ", "src", "dst").alias("key")))


@query("dml_snapshot", "a_page a_map", """, late AS (SELECT src, dst FROM a_map WHERE dst NOT IN (SELECT source FROM a_page WHERE p_size % 4 = 0))
SELECT distro, count(*) AS pinned_pages, CAST(sum(m.n) AS BIGINT) AS pinned_mappings, count(*) FILTER (p_size % 4 <> 0) AS pages, (SELECT count(*) FROM late JOIN a_page q ON dst = q.source WHERE q.distro = a.distro) AS mappings
FROM a_page a JOIN (SELECT dst, count(*) AS n FROM a_map GROUP BY 1) m ON dst = source GROUP BY distro""")
def _(spark, d):
    """Pages are deleted in one commit with their mappings; a reader that pinned the snapshot before still sees both."""
    p, m = A.pages(spark, d), A.mappings(spark, d)
    store = Snapshots(spark, new_folder(spark, "catalog"))
    pinned = store.at(store.commit({"pages": p.select("source", "distro", "p_size"), "mappings": m}).version)
    pages, _, maps = C.delete_pages(pinned.read("pages").where("p_size % 4 = 0"), pinned.read("pages"), pinned.read("pages"), pinned.read("mappings"))
    now = store.commit({"pages": pages, "mappings": maps}, pinned)

    def counts(at, pages_as, mappings_as):
        links = at.read("pages").join(at.read("mappings").groupBy("dst").agg(F.count("*").alias("n")), F.col("dst") == F.col("source"), "left")
        return links.groupBy("distro").agg(F.count("*").alias(pages_as), F.coalesce(F.sum("n"), F.lit(0)).alias(mappings_as))

    both = counts(pinned, "pinned_pages", "pinned_mappings").join(counts(now, "pages", "mappings"), "distro", "left")
    return both.fillna(0)


@query("dml_duplicates_on_insert", "a_page", """, k AS (SELECT *, replace(p_name, ' ', '-') AS nm FROM a_page) SELECT n.source, o.source AS stored FROM k n JOIN k o ON n.nm = o.nm AND n.section = o.section AND n.distro = o.distro AND n.release = o.release WHERE n.p_partkey % 2 = 0 AND o.p_partkey % 2 = 1 AND n.source <> o.source""")
def _(spark, d):
    p = A.pages(spark, d).withColumn("name", F.replace("p_name", F.lit(" "), F.lit("-")))
    return C.duplicates_on_insert(p.where("p_partkey % 2 = 1"), p.where("p_partkey % 2 = 0"))


@query("dml_reconcile", "a_page a_map", _PARENTS + """
, k AS (SELECT *, replace(p_name, ' ', '-') AS nm FROM a_page), mp AS (SELECT src, dst, score FROM a_map WHERE score > 5 UNION ALL SELECT nm, source, 10 FROM k),
kept AS (SELECT * FROM mp WHERE src NOT LIKE '% %'), valid AS (SELECT DISTINCT p.name || ' ' || s AS src, k.source AS dst FROM (SELECT name, distro, release, unnest(subcommands) AS s FROM parents) p JOIN k ON k.nm = p.name || '-' || s AND k.distro = p.distro AND k.release = p.release)
SELECT src, dst, score FROM kept UNION ALL SELECT src, dst, 1 FROM valid""")
def _(spark, d):
    p = A.pages(spark, d).withColumn("name", F.replace("p_name", F.lit(" "), F.lit("-")))
    m = A.mappings(spark, d).where("score > 5").unionByName(p.select(F.col("name").alias("src"), F.col("source").alias("dst"), F.lit(10).alias("score")))
    return C.reconcile_subcommands(p, m, _parents(spark, d))


@query("dml_alias_upgrade", "a_page a_map", "SELECT src, dst, max(score) AS score FROM (SELECT * FROM a_map UNION ALL SELECT p_name, source, 10 FROM a_page WHERE p_partkey % 5 = 0 UNION ALL SELECT 'alias ' || p_name, source, 10 FROM a_page WHERE p_partkey % 7 = 0) GROUP BY 1, 2")
def _(spark, d):
    p = A.pages(spark, d)
    alias = p.where("p_partkey % 5 = 0").select(F.col("p_name").alias("src"), F.col("source").alias("dst")).unionByName(p.where("p_partkey % 7 = 0").select(F.concat(F.lit("alias "), "p_name").alias("src"), F.col("source").alias("dst")))
    return C.upgrade_aliases(A.mappings(spark, d), alias)


@query("dml_set_score", "a_page a_map", "SELECT src, dst, (CASE WHEN src = 'small ring' AND dst = (SELECT min(dst) FROM a_map WHERE src = 'small ring') THEN 99 ELSE score END) AS score FROM a_map")
def _(spark, d):
    m = A.mappings(spark, d)
    dst = m.where("src = 'small ring'").agg(F.min("dst")).first()[0]  # one row
    return C.set_score(m, "small ring", dst, 99)


@query("web_section_pages", "a_page", "SELECT source, name, section, replace(url_encode(name || '.' || section), '+', '%20') AS tail FROM a_page WHERE starts_with(source, 'brand2/economy/2/')")
def _(spark, d):
    return C.section_pages(A.pages(spark, d), "brand2/economy/2/")


@query("bot_should_shed", "", """, c AS (SELECT doc_id, text AS cmd FROM documents), t AS (SELECT doc_id, unnest(regexp_split_to_array(cmd, '[ \\t\\n|&;<>()"''`$={}]')) AS t FROM c),
h AS (SELECT doc_id, count(*) AS hits FROM t WHERE t IN (SELECT t FROM t WHERE doc_id % 100 = 0 AND length(t) > 9) GROUP BY 1)
SELECT doc_id, cmd, coalesce(hits, 0) AS hits, strlen(cmd) BETWEEN 1 AND 5000 AND (coalesce(hits, 0) >= 4 OR coalesce(hits, 0) >= 2 AND strlen(cmd) > 250) AS shed FROM c LEFT JOIN h USING (doc_id)""".replace(", c AS", "WITH c AS", 1))
def _(spark, d):
    c = A.table(spark, d, "documents").select("doc_id", F.col("text").alias("cmd"))
    names = c.where("doc_id % 100 = 0").select(F.explode(S.command_tokens("cmd")).alias("t")).where("length(t) > 9")
    return O.hits_and_verdict(c, names, "doc_id")
