"""Connected components of an edge table, by contraction; nothing is gathered in the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _roots(parents: DataFrame) -> DataFrame:
    """(id, parent) with each parent replaced by the last one above it; parents are smaller than their children or equal."""
    while True:
        above = parents.select(F.col("id").alias("_a"), F.col("parent").alias("_p"))
        moved = written(parents.join(above, F.col("parent") == F.col("_a"), "left").select("id", F.coalesce("_p", "parent").alias("parent"), (F.col("_p") < F.col("parent")).alias("_moved")), "roots")
        parents = moved.select("id", "parent")
        if moved.where("_moved").isEmpty():
            return parents


def components(edges: DataFrame) -> DataFrame:
    """id, component: for each end of the edges (a, b), the smallest id that it reaches.

    Each vertex hooks to its smallest neighbour, chains are shortened by doubling,
    and edges are rewritten to the roots until none is left; a vertex's neighbours
    are only ever aggregated, before the shuffle too.
    """
    edges = written(edges.select("a", "b").where("a <> b"), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hooked = both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("least")).select("id", F.least("id", "least").alias("parent"))
        roots = _roots(hooked)
        if found is None:
            found = roots.select("id", F.col("parent").alias("component"))
        else:
            up = roots.select(F.col("id").alias("_a"), F.col("parent").alias("_p"))
            found = written(found.join(up, F.col("component") == F.col("_a"), "left").select("id", F.coalesce("_p", "component").alias("component")), "components")
        at_a, at_b = (roots.select(F.col("id").alias(c), F.col("parent").alias(f"_{c}")) for c in "ab")
        edges = written(edges.join(at_a, "a").join(at_b, "b").where("_a <> _b").select(F.col("_a").alias("a"), F.col("_b").alias("b")).distinct(), "edges")
    if found is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return found
