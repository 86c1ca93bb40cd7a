"""How filters interact: what each one removes, in every order in which they can be applied.

Documents become masks, one bit for each filter that a document fails.  Masks are
counted by part and label into cells, so everything behind the first aggregate
grows with the number of parts only, not with the documents.  Cells are unpivoted
against the steps of every order (long form); a running bit-or over the steps
before tells what an earlier filter has already removed; conditional sums of the
cells give the figures of a step, and a total over a filter's steps in all orders
gives its Shapley sum.

The five filters (words are maximal runs without ASCII white space):
A: under 100 words.  B: distinct words are under 80 % of the words.  C: over 10 %
of the code points are A-Z.  D: one of ``# $ % & * |`` occurs.  E: the text is
that of a row with a smaller id, wherever in the table, removed or not.

Nulls: a null text or part is empty, an empty text fails A only (and E where
another row with a smaller id is empty too).  A null id is larger than none, so its
row fails no E and has no label.  Repeated rows count as often as they occur; rows
that share the smallest id of a text don't fail E.  Labels: several rows of one id
are one, good or toxic if one of them is; nulls are 0.  Texts of any length are one
value of a row; equal texts are told by SHA-256.  Empty tables give empty results.
Only the named columns are read, so others may clash.

Scale: texts don't move, each is measured where it is read; narrow rows of digest
and mask are shuffled twice.  A text that a third of all rows share is a hot key of
plain joins, which adaptive execution splits (the other side has one row a key).
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

_BLANKS = r"[ \t-\r]+"


def measured_conditions(text: Column) -> dict[str, Column]:
    """The conditions of failure that a text shows by itself."""
    words = F.array_remove(F.split(text, _BLANKS), "")
    return {
        "A": F.size(words) < 100,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 80 * F.size(words).cast("long"),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")).cast("long") > 10 * F.length(text).cast("long"),
        "D": text.rlike("[#$%&*|]"),
    }


def failure_masks(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask, good, toxic of each document; bit i of the mask: the i-th filter of ABCDE fails it."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = sum((c.cast("int") * (1 << i) for i, c in enumerate(measured_conditions(F.col("text")).values())), F.lit(0))
    narrow = written(rows.select("doc_id", "part", own.alias("own"), F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "masks")
    firsts = narrow.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select(F.col("digest").alias("held"), "first_id")
    marks = labels.groupBy(F.col("doc_id").alias("labelled")).agg(F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("is_good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("is_toxic"))
    seen = F.coalesce(F.col("doc_id") > F.col("first_id"), F.lit(False)).cast("int") * 16
    marked = narrow.join(firsts, F.col("digest") == F.col("held"), "left").join(marks, F.col("doc_id") == F.col("labelled"), "left")
    return marked.select("part", (F.col("own") + seen).alias("mask"), F.coalesce("is_good", F.lit(False)).alias("good"), F.coalesce("is_toxic", F.lit(False)).alias("toxic"))


def audit(masks: DataFrame, letters: str = "ABCDE", orders: list[str] | None = None) -> DataFrame:
    """One row for each part, order and step, from rows of part, mask, good and toxic.

    kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley, as long.
    """
    orders = ["".join(p) for p in permutations(letters)] if orders is None else orders
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count_if("good").alias("n_good"), F.count_if("toxic").alias("n_toxic"))
    each = cells.select("*", F.explode(F.split(F.lit(",".join(orders)), ",")).alias("filter_order"))
    long = each.select("*", F.posexplode(F.split("filter_order", "")).alias("place", "letter"))
    long = long.select("part", "mask", "n", "n_good", "n_toxic", "filter_order", (F.col("place") + 1).alias("step"), F.expr(f"shiftleft(1, instr('{letters}', letter) - 1)").alias("bit"))
    before = Window.partitionBy("part", "filter_order", "mask").orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    long = long.withColumn("earlier", F.coalesce(F.bit_or(F.col("mask").bitwiseAND(F.col("bit"))).over(before), F.lit(0)))
    fails, gone = F.col("mask").bitwiseAND(F.col("bit")) != 0, F.col("earlier") != 0
    total = lambda n, when: F.coalesce(F.sum(F.when(when, F.col(n))), F.lit(0))
    out = long.groupBy("part", "filter_order", "step", "bit").agg(
        total("n", ~fails & ~gone).alias("kept"),
        total("n", fails & ~gone).alias("removed"),
        total("n", fails & gone).alias("redundant"),
        total("n", F.col("mask") == F.col("bit")).alias("unique_fails"),
        total("n_good", fails & ~gone).alias("good_lost"),
        total("n_toxic", fails & ~gone).alias("toxic_lost"),
    )
    return out.withColumn("shapley", F.sum("removed").over(Window.partitionBy("part", "bit"))).drop("bit")


def filter_audit(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(failure_masks(documents, labels))
