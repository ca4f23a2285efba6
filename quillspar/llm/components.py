"""Connected components of a graph given by its edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspar.session import drop_table, write_table


def _large(edges: DataFrame) -> DataFrame:
    both = write_table(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "both")
    least = write_table(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m")), "least")
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    down = write_table(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct(), "down")
    least = write_table(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v")
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of the edges (u, v) that isn't the smallest of its component; root is the smallest.

    Node values may be of any orderable type. Loops and repeated edges are ignored; no edges give no rows.
    """
    state = write_table(edges.select("u", "v").filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        moved = write_table(_small(write_table(_large(state), "large")), "star")
        now = moved.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        drop_table(state)
        state = moved
        if tuple(now) == mark:
            return state.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)
