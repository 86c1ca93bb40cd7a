"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words: its share, by weight, of `share` times all
words, but at most `most` times its own; what is over goes to the others by
weight.  A source's ratio is its target over its size.  Every document of it is
taken whole floor(ratio) times; the rest of the ratio is the inclusion
probability of one more copy.  Documents are ranked by random odds over
inclusion odds, and the first are taken as far as their words fit into what is
left of the target; then the one further document that brings the words closest
to the target is added, if it brings them closer.  `odds_col` multiplies a
document's inclusion odds, for unequal probabilities within a source.

The random numbers come from a digest of the id, so reruns agree.

Scale: the cut of a source is found without putting a source into one task.
Ranks fall into `bins` ranges, whose words are summed before the shuffle; only
the range that holds the cut is ordered row by row.

Nulls: a null text has size 0, null sources are one source (the last), a null id
is drawn as the text "null".  Rows of a source with equal id and size tie and are drawn
together.  Documents of size 0 are taken 0 words.  A very long text is counted whole, in one task.  Empty tables give empty results; other columns pass
through, and those added start with an underscore.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import kernels as K
from .shared import numbered_columns, written

WEIGHTS = (3, 1, 2)


def with_size(df: DataFrame, text_col: str = "text", keep_text: bool = True) -> DataFrame:
    """The rows with `_size`, the number of words of the text."""
    at, names = df.columns.index(text_col), df.columns
    left = [i for i, c in enumerate(names) if keep_text or i != at]
    schema = T.StructType([*(df.schema.fields[i] for i in left), T.StructField("_size", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [np.diff(K.words(data, offsets)[2]) for _, _, data, offsets in K.blocks(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in left), pa.array(np.concatenate(sizes) if sizes else np.zeros(0, np.int64))], schema.names)

    return df.mapInArrow(run, schema)


def source_targets(sized: DataFrame, source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """_source, _source_size, _target, _whole, _part, _draw: a row for each source (pre-aggregated; the windows see only these rows)."""
    sources = sized.groupBy(F.col(source_col).alias("_source")).agg(F.sum("_size").alias("_source_size"))
    by_name = Window.orderBy(F.col("_source").asc_nulls_last())
    ranked = sources.withColumn("_n", F.row_number().over(by_name)).withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), ((F.col("_n") - 1) % len(weights) + 1).cast("int")).cast("double"))
    fill = Window.orderBy(most * F.col("_source_size") / F.col("_weight"), "_n")
    total, everything = F.sum("_source_size").over(Window.partitionBy()), Window.partitionBy()
    capped_before = F.coalesce(F.sum(most * F.col("_source_size")).over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = (F.lit(share) * total - capped_before) / F.sum("_weight").over(fill.rowsBetween(0, Window.unboundedFollowing))
    level = ranked.withColumn("_level", level).withColumn("_capped", most * F.col("_source_size") <= F.col("_weight") * F.col("_level"))
    first = F.max(F.when(~F.col("_capped"), F.col("_level"))).over(everything)  # levels fall after the first that isn't capped
    target = F.when(F.col("_capped"), (most * F.col("_source_size")).cast("double")).otherwise(F.col("_weight") * first)
    ratio = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    out = level.withColumn("_target", target).withColumn("_whole", F.floor(ratio)).withColumn("_part", ratio - F.col("_whole"))
    return out.select("_source", "_source_size", "_target", "_whole", "_part", (F.col("_target") - F.col("_whole") * F.col("_source_size")).alias("_draw"))


#: Tables with a row for each source are broadcast up to so many sources, else joined by a shuffle.
BROADCAST_SOURCES = 20_000


def mix(sized: DataFrame, id_col: str = "doc_id", source_col: str = "source", odds_col: str | None = None, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix", bins: int = 4096) -> DataFrame:
    """The rows (with `_size`; a written table without texts) with _source_size, _target and _copies."""
    targets = written(source_targets(sized, source_col, weights, share, most), "targets")
    held = F.broadcast if targets.count() <= BROADCAST_SOURCES else (lambda df: df)

    def with_source(rows: DataFrame, table: DataFrame, how: str = "left") -> DataFrame:
        return rows.join(held(table), F.col(source_col).eqNullSafe(F.col("_s")), how).drop("_s")

    u = (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, 12), 16, 10).cast("double") + 0.5) / float(16**12)
    odds = F.col("_part") / (1 - F.col("_part")) * (F.col(odds_col) if odds_col else 1.0)
    rows = with_source(sized, targets.withColumnRenamed("_source", "_s"), "inner").withColumn("_u", u)
    rows = rows.withColumn("_rank", F.when(F.col("_part") > 0, F.col("_u") / (1 - F.col("_u")) / odds)).drop("_u")
    rows = rows.withColumn("_bin", F.floor(F.col("_rank") / (1 + F.col("_rank")) * bins))
    per_bin = rows.where(F.col("_rank").isNotNull()).groupBy(F.col(source_col).alias("_s"), "_bin").agg(F.sum("_size").alias("_words"), F.first("_draw").alias("_draw"))
    up = Window.partitionBy("_s").orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    per_bin = per_bin.withColumn("_through", F.sum("_words").over(up))
    cut = per_bin.where(F.col("_through") > F.col("_draw")).groupBy("_s").agg(F.min("_bin").alias("_cut"), F.min(F.col("_through") - F.col("_words")).alias("_before"))
    rows = with_source(rows, cut)
    # Only the rows of the range that holds the cut are ordered; ties are drawn together.
    inside = F.coalesce(F.col("_bin") == F.col("_cut"), F.lit(False))
    in_order = Window.partitionBy(source_col).orderBy("_rank", id_col, "_size").rangeBetween(Window.unboundedPreceding, 0)
    edge = rows.where(inside).withColumn("_drawn", (F.col("_before") + F.sum("_size").over(in_order) <= F.col("_draw")).cast("int"))
    drawn = F.when(F.col("_rank").isNull(), 0).when(F.col("_cut").isNull() | (F.col("_bin") < F.col("_cut")), 1).otherwise(0)
    rows = rows.where(~inside).withColumn("_drawn", drawn).unionByName(edge)
    sums = rows.groupBy(F.col(source_col).alias("_s")).agg((F.first("_draw") - F.sum(F.col("_size") * F.col("_drawn"))).alias("_left"))
    rows = with_source(rows, sums)
    gap = F.abs(F.col("_size") - F.col("_left"))
    could = rows.where((F.col("_drawn") == 0) & F.col("_rank").isNotNull() & (gap < F.abs(F.col("_left"))))
    best = could.groupBy(F.col(source_col).alias("_s")).agg(F.min(F.struct(gap.alias("gap"), F.col("_rank").alias("rank"), F.col(id_col).alias("id"))).alias("_best"))
    rows = with_source(rows, best)
    extra = F.coalesce((F.col("_drawn") == 0) & (gap == F.col("_best.gap")) & (F.col("_rank") == F.col("_best.rank")) & F.col(id_col).eqNullSafe(F.col("_best.id")), F.lit(False)).cast("int")
    return rows.select(*sized.columns, "_source_size", "_target", (F.col("_whole") + F.col("_drawn") + extra).cast("long").alias("_copies"))


def mixed_report(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of each document."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"))
    mixed = mix(written(with_size(rows, keep_text=False), "sizes"))
    return mixed.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies")).alias("taken"), F.col("_copies").alias("copies"))


def mixed_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents of the mix, each as often as it is taken; the columns stay as they are.

    Texts move once: they meet the copies on id, source and size, which settle a row's draw.
    """
    names = documents.columns
    documents, (id_col, text_col, source_col) = numbered_columns(documents, id_col, text_col, source_col)
    sized = with_size(documents, text_col)
    mixed = mix(written(sized.select(F.col(id_col).alias("_id"), F.col(source_col).alias("_src"), "_size"), "sizes"), "_id", "_src")
    taken = mixed.where("_copies > 0").select("_id", "_src", F.col("_size").alias("_words"), "_copies").distinct()
    same = F.col(id_col).eqNullSafe(F.col("_id")) & F.col(source_col).eqNullSafe(F.col("_src")) & (F.col("_size") == F.col("_words"))
    return sized.join(taken, same).withColumn("_copy", F.explode(F.expr("sequence(1, cast(_copies as int))"))).select(*documents.columns).toDF(*names)
