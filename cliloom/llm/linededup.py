"""Line deduplication by content-defined line chunks, with built-in functions only.

A text is split at ``\\n``.  Each line has a 28-bit hash (of its MD5 digest), and a
rolling hash over the last two lines, ``(h[i] + base * h[i-1]) mod PRIME`` with 0
before the first line, ends a chunk after line i where it is even.  So a boundary
depends on two lines only, and equal passages get equal chunks two lines after
they begin, wherever they stand.  `BASES` has a base for each of three phases:
three ways to cut, each on its own, which give a short passage three chances.

A chunk that occurs again anywhere, in another document or in the same, is paired
with its first occurrence by id, then by place.  Pairs of one document with one
other at one distance run together.  Then bytes are compared: line by line, the
run with its first occurrence, and on both sides as far as lines stay equal, up to
the end of the chunk behind it and the beginning of the second one before it (the
first line of a passage may end a chunk in one document only).  If at least two lines that aren't blank are
equal, all that are go; the first occurrence stays.  (Its place is before the
removed one, so the earliest of equal lines always stays.)

Scale: chunks meet as narrow rows (a 64-bit key and places); only lines of
repeated chunks and of those beside them are then fetched, once for each range.
Counts and least places are combined before the shuffle, and the optimizer's skew
join splits hot keys; all work on a text is linear in its length.

What stays although it is repeated: passages of one or two lines, most likely those
of three; a passage is found if one of the three phases has a chunk within it.

Nulls: a null text stays null and has no lines; an empty one has one empty line.
A null id ranks first.  Rows of equal id and text rank in an arbitrary order, and
one of them stays.  A text all of whose lines go becomes empty.  Empty tables
give empty results.  A very long text is one row of its lines.  Other columns pass
through, whatever their names; added ones get as many underscores as keep them apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import drop, fresh, numbered_columns, written

#: Multipliers of the rolling hash, its modulus, and how many boundaries there are (one in so many lines).
BASES, PRIME, DIVISOR = (8191, 131071, 524287), 1_000_003, 2
_BLANKS = "' \\t\\n\\u000b\\f\\r'"


def _worded(line: str) -> str:
    return f"length(translate({line}, {_BLANKS}, '')) > 0"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _chunks(rows: DataFrame, text_col: str, id_col: str, divisor: int) -> DataFrame:
    """_row, _id, _key, _from, _to of each chunk that isn't blank, with the hashes of the lines beside it (-1: none) as _before and _after, and _low and _high, where the second chunk before it begins and the one behind it ends."""
    df = rows.select("_row", F.col(id_col).alias("_id"), _lines(F.col(text_col)).alias("_lines")).where(F.col("_lines").isNotNull())
    df = df.withColumn("_h", F.expr("transform(_lines, x -> cast(conv(substring(md5(cast(x as binary)), 1, 7), 16, 10) as bigint))"))
    for p, base in enumerate(BASES):
        ends = f"filter(sequence(0, size(_h) - 1), i -> i = size(_h) - 1 or pmod(pmod(_h[i] + {base} * coalesce(get(_h, i - 1), 0L), {PRIME}), {divisor}) = 0)"
        df = df.withColumn(f"_ends{p}", F.expr(ends))
    at = lambda p, k: f"get(_ends{p}, k {k})"
    bounds = ", ".join(f"transform(_ends{p}, (e, k) -> struct({p} as _phase, coalesce({at(p, '- 1')} + 1, 0) as _from, e as _to, coalesce({at(p, '- 3')} + 1, 0) as _low, coalesce({at(p, '+ 1')}, e) as _high))" for p in range(len(BASES)))
    own = "slice(_lines, b._from + 1, b._to - b._from + 1)"
    keyed = f"transform(filter(concat({bounds}), b -> exists({own}, x -> {_worded('x')})), b -> struct(xxhash64(b._phase, {own}) as _key, b._from, b._to, b._low, b._high, cast(coalesce(get(_h, b._from - 1), -1L) as int) as _before, cast(coalesce(get(_h, b._to + 1), -1L) as int) as _after))"
    return df.select("_row", "_id", F.inline(F.expr(keyed)))


def _repeated(chunks: DataFrame) -> DataFrame:
    """Ranges of lines that repeat the chunks of a document at a distance: _row, _row0, _off (line minus its first occurrence), _from, _to, _low, _high.

    Where the hash of the line beside a range isn't that of its first occurrence, _low is _from or _high is _to; ranges of one line then go no further.
    """
    place = F.struct("_id", "_row", "_from")
    first = chunks.groupBy("_key").agg(F.min(F.struct(place, "_before", "_after")).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_key").alias("_k"), F.col("_first.col1").alias("_first"), F.col("_first._before").alias("_b0"), F.col("_first._after").alias("_a0"))
    pairs = chunks.join(first, F.col("_key") == F.col("_k")).where(place != F.col("_first"))
    pairs = pairs.select("_row", F.col("_first._row").alias("_row0"), (F.col("_from") - F.col("_first._from")).alias("_off"), "_from", "_to", "_low", "_high", ((F.col("_before") >= 0) & (F.col("_before") == F.col("_b0"))).alias("_left"), ((F.col("_after") >= 0) & (F.col("_after") == F.col("_a0"))).alias("_right"))
    in_order = Window.partitionBy("_row", "_row0", "_off").orderBy("_from", "_to")
    pairs = pairs.withColumn("_new", (F.col("_from") > F.coalesce(F.max("_to").over(in_order.rowsBetween(Window.unboundedPreceding, -1)) + 1, F.lit(-1))).cast("int"))
    pairs = pairs.withColumn("_run", F.sum("_new").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = pairs.groupBy("_row", "_row0", "_off", "_run").agg(F.min("_from").alias("_from"), F.max("_to").alias("_to"), F.min("_low").alias("_low"), F.max("_high").alias("_high"), F.min_by("_left", "_from").alias("_left"), F.max_by("_right", "_to").alias("_right"))
    low, high = F.when(F.col("_left"), F.col("_low")).otherwise(F.col("_from")), F.when(F.col("_right"), F.col("_high")).otherwise(F.col("_to"))
    return runs.select("_row", "_row0", "_off", "_from", "_to", low.alias("_low"), high.alias("_high")).where("_low < _high")


def _gone(docs: DataFrame, ranges: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """_row, _a, _b: the ranges of lines whose bytes are those of their first occurrences."""
    # A range and its first occurrence meet at the first one's place; each text gives out its lines once for each such place.
    place = [F.col("_row0").alias("_m"), (F.col("_low") - F.col("_off")).alias("_mlow"), (F.col("_high") - F.col("_off")).alias("_mhigh")]
    copies = ranges.select("_row", F.struct("_low", "_high", *place, "_from", "_to", F.lit(False).alias("_original")).alias("_w"))
    low, high = F.col("_w._mlow").alias("_low"), F.col("_w._mhigh").alias("_high")
    none = F.lit(None).cast(ranges.schema["_from"].dataType)
    firsts = copies.select(F.col("_w._m").alias("_row"), F.struct(low, high, "_w._m", "_w._mlow", "_w._mhigh", none.alias("_from"), none.alias("_to"), F.lit(True).alias("_original")).alias("_w")).distinct()
    wanted = copies.unionByName(firsts).groupBy("_row").agg(F.collect_list("_w").alias("_wanted"))
    held = docs.join(wanted, "_row").withColumn("_lines", _lines(F.col(text_col)))
    # Only the wanted lines leave a row; null where the text has no such line.
    cut = F.expr("transform(_wanted, w -> struct(w._low, w._high, w._m, w._mlow, w._mhigh, w._from, w._to, w._original, transform(sequence(w._low, w._high), i -> get(_lines, i)) as _part))")
    parts = held.select("_row", F.col(id_col).alias("_id"), F.inline(cut))
    first = parts.where("_original").select("_m", "_mlow", "_mhigh", F.col("_row").alias("_row0"), F.col("_id").alias("_id0"), F.col("_part").alias("_part0"))
    pairs = parts.where("not _original").join(first, ["_m", "_mlow", "_mhigh"]).where(F.struct("_id0", "_row0") <= F.struct("_id", "_row"))
    apart = F.expr("filter(sequence(0, size(_part) - 1), i -> coalesce(_part[i] <> _part0[i], true))")
    pairs = pairs.withColumn("_apart", apart).where("not exists(_apart, i -> i between _from - _low and _to - _low)")
    pairs = pairs.withColumn("_a", F.expr("coalesce(array_max(filter(_apart, i -> i < _from - _low)), -1) + 1")).withColumn("_b", F.expr("coalesce(array_min(filter(_apart, i -> i > _to - _low)), size(_part)) - 1"))
    worded = F.expr(f"size(filter(slice(_part, _a + 1, _b - _a + 1), x -> {_worded('x')}))")
    return pairs.where(worded >= 2).select("_row", (F.col("_low") + F.col("_a")).alias("_a"), (F.col("_low") + F.col("_b")).alias("_b"))


def dedup_lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """The rows, texts without repeated passages, with _n_lines and _n_removed (lines).

    The input must give the same rows in the same order each time it is read, as files do.
    """
    names = documents.columns
    plain, (id_at, text_at) = numbered_columns(documents, id_col, text_col)
    docs = plain.withColumn("_row", F.monotonically_increasing_id())
    chunks = written(_chunks(docs, text_at, id_at, divisor), "chunks")
    ranges = written(_repeated(chunks), "ranges")
    drop(chunks)
    gone = _gone(docs, ranges, text_at, id_at).groupBy("_row").agg(F.collect_set(F.struct("_a", "_b")).alias("_gone"))
    # The same columns as in _gone, so that one shuffle of the texts serves both; other columns come by a shuffle of their own.
    out = docs.select("_row", id_at, text_at).join(gone, "_row", "left").withColumn("_lines", _lines(F.col(text_at)))
    left = F.when(F.col("_gone").isNotNull(), F.expr("array_except(sequence(0, size(_lines) - 1), flatten(transform(_gone, g -> sequence(g._a, g._b))))"))
    out = out.withColumn("_left", left)
    text = F.when(F.col("_gone").isNull(), F.col(text_at)).otherwise(F.array_join(F.expr("transform(_left, i -> _lines[i])"), "\n"))
    many = F.when(F.col(text_at).isNull(), 0).otherwise(F.size("_lines")).cast("long")
    removed = F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_lines") - F.size("_left")).cast("long")
    out = out.select("_row", id_at, text.alias(text_at), many.alias("_many"), removed.alias("_removed"))
    if rest := [c for c in plain.columns if c not in (id_at, text_at)]:
        out = out.join(docs.select("_row", *rest), "_row")
    return out.select(*plain.columns, "_many", "_removed").toDF(*names, *fresh(names, "_n_lines", "_n_removed"))


def line_dedup_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", divisor: int = DIVISOR) -> DataFrame:
    """doc_id, n_lines, n_removed and the digest and length of what stays."""
    rows = dedup_lines(documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), divisor=divisor)
    return rows.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.length("text").cast("long").alias("kept_chars"), F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def dedup_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without repeated passages; the columns stay as they are."""
    rows = dedup_lines(documents, id_col, text_col)
    return rows.select(rows.columns[: len(documents.columns)])
