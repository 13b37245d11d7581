"""Connected components of a graph held in Spark, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citegrove.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: hangs a node's larger neighbours on its smallest neighbour (or itself). Small: hangs a node and its smaller
    neighbours on the smallest of them. Edges are (a, b) with a > b."""
    around = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        around = around.union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if large:
        out = joined.filter("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter("a <> b").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every node that has an edge to another one, and the smallest id that it is connected with.

    Each round is written to the shared folder; the driver sees two sums a round. Hot nodes are pre-aggregated for their
    minimum, and Spark splits their join."""
    x, y = F.col(a).cast("long"), F.col(b).cast("long")
    now = stored(edges.select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).filter("a <> b").distinct(), "edges")
    seen = None
    while True:
        print_of = now.select(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == print_of:
            break
        seen = print_of
        now = stored(_star(_star(now, True), False), "edges")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component")).union(
        now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
