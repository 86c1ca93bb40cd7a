"""The queries of this subpackage, each over a whole table, and SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship
from .chat import chat_report
from .filteraudit import filter_audit
from .fingerprints import fingerprint_report
from .linededup import line_dedup_report
from .lm import lm_scores
from .mixing import mixed_report
from .neardup import near_components
from .packing import pack_documents
from .quality import BOILERPLATE, quality_report
from .substrings import remove_repeats
from .tokencount import section_tokens
from .trie import conversation_trie
from .warc import DIGITS, page_captures


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file is; a parameter of the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_report(_table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


#: A conversation whose texts are made of control strings.
HOSTILE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    hostile = spark.createDataFrame(HOSTILE, "conv_id long, turn long, role string, text string")
    return chat_report(_table(spark, sf_dir, "conversations").select(*hostile.columns).unionByName(hostile))


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_report(_table(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"), num=85, den=100, k=3)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op7_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup_report(_table(spark, sf_dir, "documents"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_table(spark, sf_dir, "documents"), texts=False)


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(_table(spark, sf_dir, "documents"))


def op11_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_captures(_table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_document_fingerprints": op1_document_fingerprints,
    "op2_best_fit_packing": op2_best_fit_packing,
    "op3_chat_formatting": op3_chat_formatting,
    "op4_source_mixing": op4_source_mixing,
    "op5_minhash_near_dedup": op5_minhash_near_dedup,
    "op6_token_counts": op6_token_counts,
    "op7_lm_scoring": op7_lm_scoring,
    "op8_line_dedup": op8_line_dedup,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_quality_rules": op10_quality_rules,
    "op11_filter_interaction_audit": op11_filter_interaction_audit,
    "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
    "op13_warc": op13_warc,
}

ORACLES: dict[str, str] = {
    "op3_chat_formatting": r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), turns AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '\\|\[/?SYS\]|\[/?INST\]|</?s>|\[/?ROLE\]|\[TEXT\]'))
    + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 23 + length(role) END AS n
  FROM rows
), placed AS (
  SELECT *, sum(n) OVER w AS through, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC NULLS LAST, role DESC, text DESC) = 1 AS last
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR last THEN through ELSE 0 END) AS BIGINT) AS formatted_chars
FROM placed GROUP BY conv_id
""",
    "op5_minhash_near_dedup": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), each AS (
  SELECT doc_id, unnest(s) AS g FROM sets
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM each a JOIN each b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b WHERE 100 * n >= 85 * (len(x.s) + len(y.s) - n)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM sets
  UNION SELECT reach.a, l.b FROM reach JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON reach.b = l.a
)
SELECT doc_id, len(s) AS n_shingles, m AS component_id, doc_id = m AS kept FROM sets JOIN (SELECT a, min(b) AS m FROM reach GROUP BY 1) ON a = doc_id
""",
    "op9_substring_dedup": r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), each AS (
  SELECT doc_id, generate_subscripts(w, 1) AS i, unnest(w) AS word FROM words
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM words WHERE len(w) >= 13)
), firsts AS (
  SELECT s, min(doc_id) AS m FROM windows GROUP BY s
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN firsts USING (s) WHERE m < doc_id
), kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS k FROM each ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
), removed AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256 FROM words LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op10_quality_rules": r"""
WITH words AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, i, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3))
), covered AS (
  SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS k FROM grams WHERE c > 1) GROUP BY doc_id
), lines AS (
  SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS n, unnest(string_split(text, chr(10))) AS line FROM words
), parts AS (
  SELECT *, regexp_extract_all(line, '[^\x20\x09-\x0D]+') AS w, row_number() OVER (PARTITION BY doc_id, line ORDER BY n) > 1 AS dup, translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
    length(regexp_replace(line, '[^A-Z]', '', 'g')) AS upper, length(regexp_replace(line, '[^a-z]', '', 'g')) AS lower
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), judged AS (
  SELECT *, list_sum(list_transform(w, lambda x: length(x))) AS chars,
    NOT regexp_matches(line, '[.!?:;"'')\]…”’»。！？][\x20\x09-\x0D]*$')
    OR len(list_filter(w, lambda x: x IN ('|', '>', '/', '-', '*', '»', '·'))) >= 2 OR 10 * len(list_filter(w, lambda x: x IN ('|', '>', '/', '-', '*', '»', '·'))) > 3 * len(w)
    OR 10 * len(list_filter(w, lambda x: regexp_matches(x, '[#*$%&|<>]'))) >= 3 * len(w)
    OR (len(w) >= 3 AND upper > 0 AND 10 * upper > 7 * (upper + lower))
    OR """ + " OR ".join(f"contains(low, '{p}')" for p in BOILERPLATE) + r""" AS fails
  FROM parts
), per_doc AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dup) AS n_dup_lines, count(*) FILTER (fails) AS n_failed_lines, CAST(coalesce(sum(chars) FILTER (fails), 0) AS BIGINT) AS lost_chars FROM judged GROUP BY doc_id
), measured AS (
  SELECT doc_id, len(w) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(n, 0) AS n_repeat_words,
    coalesce(n_lines, 0) AS n_lines, coalesce(n_failed_lines, 0) AS n_failed_lines, coalesce(lost_chars, 0) AS lost_chars
  FROM words LEFT JOIN covered USING (doc_id) LEFT JOIN per_doc USING (doc_id)
)
SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND lost_chars <= 0.5 * word_chars AS kept FROM measured
""",
    "op8_line_dedup": r"""
WITH texts AS (
  SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL
), lines AS (
  SELECT doc_id, i, line, n_lines, h, coalesce(lag(h) OVER (PARTITION BY doc_id ORDER BY i), 0) AS h1
  FROM (SELECT *, CAST('0x' || substr(md5(line), 1, 7) AS BIGINT) AS h FROM (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) - 1 AS i, len(lines) AS n_lines FROM texts))
), marked AS (
  SELECT doc_id, phase, i, line, i = n_lines - 1 OR (h + base * h1) % 1000003 % 2 = 0 AS is_end
  FROM lines, (VALUES (0, 8191), (1, 131071), (2, 524287)) AS phases(phase, base)
), cut AS (
  SELECT *, coalesce(sum(CAST(is_end AS INT)) OVER (PARTITION BY doc_id, phase ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM marked
), chunks AS (
  SELECT doc_id, phase, chunk, min(i) AS a, max(i) AS b, list(line ORDER BY i) AS body FROM cut GROUP BY ALL
), beside AS (
  SELECT *, coalesce(lag(a, 2) OVER w, lag(a) OVER w, a) AS low, coalesce(lead(b) OVER w, b) AS high FROM chunks WINDOW w AS (PARTITION BY doc_id, phase ORDER BY chunk)
), worded AS (
  SELECT * FROM beside WHERE regexp_matches(array_to_string(body, chr(10)), '[^\x20\x09-\x0D]')
), firsts AS (
  SELECT phase, body, min({'doc_id': doc_id, 'a': a}) AS f FROM worded GROUP BY phase, body HAVING count(*) > 1
), pairs AS (
  SELECT w.doc_id, w.a, w.b, w.low, w.high, f.doc_id AS doc0, w.a - f.a AS off FROM worded w JOIN firsts USING (phase, body) WHERE w.doc_id <> f.doc_id OR w.a <> f.a
), compared AS (
  SELECT p.*, x.lines, list_filter(range(low, high + 1), lambda i: i < off OR i - off >= len(y.lines) OR x.lines[i + 1] <> y.lines[greatest(i - off, 0) + 1]) AS apart
  FROM pairs p JOIN texts x USING (doc_id) JOIN texts y ON y.doc_id = p.doc0
), ranges AS (
  SELECT doc_id, lines, coalesce(list_max(list_filter(apart, lambda i: i < a)) + 1, low) AS a, coalesce(list_min(list_filter(apart, lambda i: i > b)) - 1, high) AS b FROM compared
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS i FROM ranges WHERE len(list_filter(lines[a + 1:b + 1], lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) >= 2
), removed AS (
  SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS k FROM lines ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id
)
SELECT doc_id, CAST(len(lines) AS BIGINT) AS n_lines, coalesce(n, 0) AS n_removed, length(coalesce(k, '')) AS kept_chars, sha256(coalesce(k, '')) AS kept_sha256
FROM texts LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)
UNION ALL SELECT doc_id, 0, 0, NULL, NULL FROM documents WHERE text IS NULL
""",
    "op4_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM sized GROUP BY source
), weighted AS (
  SELECT *, CAST(CASE (n - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight FROM sources
), levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
      - coalesce(CAST(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0))
    / sum(weight) OVER (ORDER BY 2 * source_size / weight, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighted
), targets AS (
  SELECT source, source_size, CASE WHEN 2 * source_size <= weight * level THEN CAST(2 * source_size AS DOUBLE)
    ELSE weight * (max(CASE WHEN 2 * source_size <= weight * level THEN NULL ELSE level END) OVER ()) END AS target
  FROM levels
), parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole,
    CASE WHEN source_size > 0 THEN target / source_size - floor(target / source_size) ELSE 0 END AS part
  FROM targets
), ranked AS (
  SELECT doc_id, s.source, size, source_size, target, whole, target - whole * source_size AS draw,
    (CAST('0x' || substr(md5('mix' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 12) AS BIGINT) + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u, part
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
), odds AS (
  SELECT *, CASE WHEN part > 0 THEN u / (1 - u) / (part / (1 - part)) END AS rnk FROM ranked
), drawn AS (
  SELECT *, CASE WHEN rnk IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY rnk, doc_id, size RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) <= draw THEN 1 ELSE 0 END AS d
  FROM odds
), remaining AS (
  SELECT *, draw - CAST(sum(size * d) OVER (PARTITION BY source) AS BIGINT) AS remain FROM drawn
), best AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN d = 0 AND rnk IS NOT NULL AND abs(size - remain) < abs(remain) THEN abs(size - remain) END NULLS LAST, rnk, doc_id) = 1
    AND d = 0 AND rnk IS NOT NULL AND abs(size - remain) < abs(remain) AS extra
  FROM remaining
)
SELECT doc_id, size, source_size, target, size * CAST(whole + d + CAST(extra AS INT) AS BIGINT) AS taken, CAST(whole + d + CAST(extra AS INT) AS BIGINT) AS copies FROM best
""",
    "op11_filter_interaction_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents
), worded AS (
  SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w, min(doc_id) OVER (PARTITION BY text) AS first_id FROM texts
), marks AS (
  SELECT doc_id, max(quality = 1) AS good, max(toxic = 1) AS toxic FROM labels GROUP BY doc_id
), failed AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, {
    'A': len(w) < 100, 'B': 100 * len(list_distinct(w)) < 80 * len(w), 'C': 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text),
    'D': regexp_matches(text, '[#$%&*|]'), 'E': coalesce(doc_id > first_id, false)} AS f
  FROM worded LEFT JOIN marks USING (doc_id)
), cells AS (
  SELECT part, good, toxic, f, count(*) AS n FROM failed GROUP BY ALL
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
), orders AS (
  SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
), steps AS (
  SELECT filter_order, CAST(unnest(range(1, 6)) AS INT) AS step FROM orders
), long AS (
  SELECT part, good, toxic, n, filter_order, step, substr(filter_order, step, 1) AS letter, list_transform(['A', 'B', 'C', 'D', 'E'], lambda l: CASE l WHEN 'A' THEN f.A WHEN 'B' THEN f.B WHEN 'C' THEN f.C WHEN 'D' THEN f.D ELSE f.E END) AS fails
  FROM cells, steps
), seen AS (
  SELECT *, fails[ascii(letter) - 64] AS own, len(list_filter(range(1, step), lambda i: fails[ascii(substr(filter_order, i, 1)) - 64])) > 0 AS earlier, len(list_filter(fails, lambda b: b)) = 1 AS alone FROM long
), summed AS (
  SELECT part, filter_order, step, letter, CAST(coalesce(sum(n) FILTER (NOT own AND NOT earlier), 0) AS BIGINT) AS kept, CAST(coalesce(sum(n) FILTER (own AND NOT earlier), 0) AS BIGINT) AS removed,
    CAST(coalesce(sum(n) FILTER (own AND earlier), 0) AS BIGINT) AS redundant, CAST(coalesce(sum(n) FILTER (own AND alone), 0) AS BIGINT) AS unique_fails,
    CAST(coalesce(sum(n) FILTER (own AND NOT earlier AND good), 0) AS BIGINT) AS good_lost, CAST(coalesce(sum(n) FILTER (own AND NOT earlier AND toxic), 0) AS BIGINT) AS toxic_lost
  FROM seen GROUP BY ALL
)
SELECT * EXCLUDE (letter), CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM summed
""",
    "op12_conversation_prefix_trie": r"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT DISTINCT conv_id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: list_concat([ascii(c)::BIGINT], list_transform(range(8), lambda i: -1::BIGINT))))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END)) % 6 AS h FROM turns
), placed AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 100 WHERE pos <= h
  UNION ALL SELECT conv_id, 1, pos, role, text FROM turns JOIN convs USING (conv_id) WHERE pos > h
), paths AS (
  SELECT conv_id, coalesce(list(struct_pack(role := role, text := text) ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS path FROM convs LEFT JOIN placed USING (conv_id) GROUP BY conv_id
), members AS (
  SELECT conv_id, unnest(range(0, len(path) + 1)) AS depth, path FROM paths
), nodes AS (
  SELECT path[1:depth] AS node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (len(path) = depth) AS ends FROM members GROUP BY 1, 2
), linked AS (
  SELECT a.*, b.conv_id AS parent_conv_id, CASE WHEN a.depth = 0 THEN 0 ELSE (a.n_convs - 1) * length(a.node[a.depth].text) END AS own,
    (SELECT count(*) FROM nodes k WHERE k.depth = a.depth + 1 AND k.node[1:a.depth] = a.node) AS n_children
  FROM nodes a LEFT JOIN nodes b ON b.depth = a.depth - 1 AND b.node = a.node[1:a.depth - 1]
), sums AS (
  SELECT node[1:up] AS node, up AS depth, sum(own) AS saved_tokens, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(range(0, depth + 1)) AS up FROM linked) GROUP BY 1, 2
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256 FROM linked JOIN sums USING (node, depth)
""",
    "op13_warc": """
WITH sized AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages
), firsts AS (
  SELECT *, max(page_id) OVER (PARTITION BY html) AS last_id FROM sized
)
SELECT DISTINCT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda i: substr('"""
    + DIGITS
    + """', 1 + CAST((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM last_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id IS NOT DISTINCT FROM last_id THEN NULL ELSE last_id END AS refers_to
FROM firsts
""",
}
