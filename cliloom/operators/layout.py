"""Mappings laid out by name, and what four kinds of lookup read of them.

`laid_out` deals a table to files by ranges of its name and sorts each file, with small row
groups, so a lookup by name, a list of names or a prefix skips files' row groups by their
statistics, where a table in any order has to be read as a whole.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import selection as Q

#: Bytes of a row group in a laid-out table.
GROUP = 1 << 20


def laid_out(mappings: DataFrame, path: str, by: str = "src", files: int = 16, group: int = GROUP) -> DataFrame:
    mappings.repartitionByRange(files, by).sortWithinPartitions(by).write.option("parquet.block.size", group).option("parquet.page.size", max(group // 16, 4096)).parquet(path)
    return mappings.sparkSession.read.parquet(path)


def in_list(column: str, values: list[str]) -> Column:
    """IN with a value for each place; nothing is in an empty list."""
    return F.col(column).isin(*values) if values else F.lit(False)


def lookups(point: str, names: list[str], prefix: str, page: str) -> dict[str, Column]:
    """Four shapes of lookup: by a name, by several, by the beginning of one, by a page."""
    return {"point": F.col("src") == point, "in_list": in_list("src", names), "prefix": F.col("src").startswith(prefix), "by_page": F.col("dst") == page}


def single_and_shared(mappings: DataFrame, n: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(names of one page, names of several): up to n of each, at random."""
    counts = mappings.groupBy("src").agg(F.count("*").alias("pages"))
    pick = lambda rows: rows.orderBy(F.rand(seed), "src").limit(n)
    return pick(counts.where("pages = 1")), pick(counts.where("pages > 1"))


def scanned(df: DataFrame) -> dict[str, int]:
    """What a plan's file scans did when it ran: files, rows and bytes read."""
    plan = df._jdf.queryExecution().executedPlan()
    df._jdf.queryExecution().toRdd().count()
    totals = {"files": 0, "rows": 0, "bytes": 0}
    stack = [plan]
    while stack:
        node = stack.pop()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            stack.append(node.executedPlan())
            continue
        if node.getClass().getSimpleName() == "FileSourceScanExec":
            metrics = node.metrics()
            for name, key in (("files", "numFiles"), ("rows", "numOutputRows"), ("bytes", "filesSize")):
                if metrics.contains(key):
                    totals[name] += metrics.apply(key).value()
        children = node.children()
        stack += [children.apply(i) for i in range(children.size())]
    return totals


def compare_layouts(plain: DataFrame, laid: DataFrame, shapes: dict[str, Column], times: int = 5) -> DataFrame:
    """shape, layout, n (rows found), rows and bytes read, and mean, median, p95 and p99 milliseconds of some runs."""
    spark, seen, spent = plain.sparkSession, [], []
    for shape, condition in shapes.items():
        for layout, table in (("plain", plain), ("laid_out", laid)):
            found = table.where(condition)
            read = scanned(found)
            for _ in range(times):
                began = time.perf_counter()
                n = found.count()
                spent.append((shape, layout, (time.perf_counter() - began) * 1000))
            seen.append((shape, layout, n, read["rows"], read["bytes"]))
    t = spark.createDataFrame(spent, "shape string, layout string, ms double")
    at = Q.order_statistics(t, "ms", ["shape", "layout"], {"p95": Q.at_index(0.95), "p99": Q.at_index(0.99)} | Q.middle("_m"))
    means = t.groupBy("shape", "layout").agg(F.avg("ms").alias("mean"))
    out = spark.createDataFrame(seen, "shape string, layout string, n long, rows long, bytes long").join(Q.beside(means, at, ["shape", "layout"]), ["shape", "layout"])
    return out.select("shape", "layout", "n", "rows", "bytes", "mean", Q.median_value("_m").alias("median"), "p95", "p99")


def speedups(measured: DataFrame) -> DataFrame:
    """shape, speedup (null where nothing was spent), saved_us: of the layout over the plain table, by medians."""
    of = lambda layout: F.max(F.when(F.col("layout") == layout, F.col("median")))
    both = measured.groupBy("shape").agg(of("plain").alias("_p"), of("laid_out").alias("_l"))
    return both.select("shape", F.when(F.col("_l") > 0, F.col("_p") / F.col("_l")).alias("speedup"), ((F.col("_p") - F.col("_l")) * 1000).alias("saved_us"))
