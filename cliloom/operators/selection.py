"""Exact order statistics of groups of any size, by selection.

Values are counted by group first (combined before the shuffle).  A group with
many distinct values isn't sorted: splitters from a bounded sketch cut it into
ranges, ranges are counted, and only the range that holds a wanted rank goes on,
round after round, until it has at most `MOST` distinct values; these are summed
up in order.  A round cuts a range to a few hundredths, so even a group of 10^12
distinct values takes four or five.

Nulls aren't counted; a group of nulls alone has null statistics.  Values are
numbers, dates or timestamps.  The types of the values are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.folders import written

#: Distinct values of a range that are ordered in one task.
MOST = 100_000
#: Ranges into which a round cuts, and the accuracy of the sketch of their bounds.
RANGES, ACCURACY = 64, 2000


def _narrowed(values: DataFrame, wide: DataFrame, keys: list[str]) -> DataFrame:
    """One round: each row of `wide` (keys, _name, _rank, _from, _to) with the range that holds its rank."""
    own = [*keys, "_name"]
    apart = wide.select(*(F.col(k).alias(f"{k}_") for k in keys), "_name", "_rank", "_from", "_to")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    inside = values.join(apart, same).where(F.col("_value").between(F.col("_from"), F.col("_to"))).drop(*(f"{k}_" for k in keys))
    bounds = inside.groupBy(*own).agg(F.percentile_approx("_value", [i / RANGES for i in range(1, RANGES)], ACCURACY).alias("_bounds"))
    bounds = written(bounds, "bounds").select(*(F.col(k).alias(f"{k}_") for k in keys), F.col("_name").alias("_name_"), "_bounds")
    placed = inside.join(bounds, [*same, F.col("_name") == F.col("_name_")])
    placed = placed.select(*own, "_rank", "_value", "_c", F.expr("size(filter(_bounds, b -> b < _value))").alias("_range"))
    ranges = placed.groupBy(*own, "_rank", "_range").agg(F.sum("_c").alias("_n"), F.count("*").alias("_many"), F.min("_value").alias("_from"), F.max("_value").alias("_to"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(*own).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    held = ranges.withColumn("_before", before).where((F.col("_before") < F.col("_rank")) & (F.col("_rank") <= F.col("_before") + F.col("_n")))
    return held.select(*own, (F.col("_rank") - F.col("_before")).alias("_rank"), "_from", "_to", "_many")


def order_statistics(df: DataFrame, value: str, by: list[str], ranks: dict[str, Column], most: int = MOST) -> DataFrame:
    """by, and of each group the values at some ranks (from 1; expressions of `_n`, the number of its values); null where there is no such rank."""
    keys = [f"_k{i}" for i in range(len(by))] or ["_k0"]
    named = [F.col(c).alias(k) for c, k in zip(by, keys, strict=True)] if by else [F.lit(0).alias("_k0")]
    values = df.select(*named, F.col(value).alias("_value")).where("_value is not null").groupBy(*keys, "_value").agg(F.count("*").alias("_c"))
    values = written(values, "values")
    sizes = values.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.count("*").alias("_many"), F.min("_value").alias("_from"), F.max("_value").alias("_to"))
    each = F.array(*(F.struct(F.lit(name).alias("_name"), rank.cast("long").alias("_rank")) for name, rank in ranks.items()))
    wanted = sizes.select(*keys, F.inline(each), "_from", "_to", "_many", "_n").where("_rank between 1 and _n").drop("_n")
    narrow, wide = [], wanted
    while True:
        wide = written(wide, "ranks")
        narrow.append(wide.where(F.col("_many") <= most))
        wide = wide.where(F.col("_many") > most)
        if wide.isEmpty():
            break
        wide = _narrowed(values, wide, keys)
    ends = narrow[0]
    for more in narrow[1:]:
        ends = ends.unionByName(more)
    ends = ends.select(*(F.col(k).alias(f"{k}_") for k in keys), "_name", "_rank", "_from", "_to")
    same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys]
    rows = values.join(ends, same).where(F.col("_value").between(F.col("_from"), F.col("_to")))
    through = F.sum("_c").over(Window.partitionBy(*keys, "_name").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    found = rows.withColumn("_through", through).groupBy(*keys).agg(*(F.min(F.when((F.col("_name") == name) & (F.col("_through") >= F.col("_rank")), F.col("_value"))).alias(name) for name in ranks))
    if not by:
        return found.agg(*(F.max(name).alias(name) for name in ranks))  # one row, of an empty table too
    # Groups of nulls alone have no values but are groups.
    groups = df.select(*named).distinct().select(*(F.col(k).alias(f"{k}_") for k in keys))
    return groups.join(found, same, "left").select(*(F.col(f"{k}_").alias(c) for c, k in zip(by, keys, strict=True)), *ranks)


def _n() -> Column:
    return F.col("_n")


def at_index(q: float) -> Column:
    """The rank of the value at floor(q * n) counted from 0, or the last."""
    return F.least(_n(), F.floor(q * _n()) + 1)


def exclusive(q: float, name: str) -> dict[str, Column]:
    """The ranks that `exclusive_value` needs: below and above q * (n + 1)."""
    low = F.least(F.greatest(F.floor(q * (_n() + 1)), F.lit(1)), F.greatest(_n() - 1, F.lit(1)))
    return {f"{name}_low": low, f"{name}_high": F.least(low + 1, _n())}


def exclusive_value(q: float, name: str, n: Column) -> Column:
    """The quantile at q * (n + 1), between neighbours (or on the line through the outer two); one value is itself."""
    at = q * (n + 1)
    share = at - F.least(F.greatest(F.floor(at), F.lit(1)), F.greatest(n - 1, F.lit(1)))
    a, b = F.col(f"{name}_low"), F.col(f"{name}_high")
    return F.when(n == 1, a.cast("double")).otherwise((a + share * (b - a)).cast("double"))


def middle(name: str) -> dict[str, Column]:
    """The ranks that `median_value` needs."""
    return {f"{name}_low": F.floor((_n() + 1) / 2), f"{name}_high": F.floor(_n() / 2) + 1}


def median_value(name: str) -> Column:
    return (F.col(f"{name}_low").cast("double") + F.col(f"{name}_high").cast("double")) / 2


def beside(table: DataFrame, statistics: DataFrame, by: list[str]) -> DataFrame:
    """A table of groups with their statistics, groups told null-safely."""
    if not by:
        return table.join(statistics)  # one row each
    named = statistics.select(*(F.col(c).alias(f"_by_{c}") for c in by), *(c for c in statistics.columns if c not in by))
    return table.join(named, [F.col(c).eqNullSafe(F.col(f"_by_{c}")) for c in by], "left").drop(*(f"_by_{c}" for c in by))
