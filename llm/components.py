"""Connected components over an edge table: alternating large-star and small-star steps, each a narrow aggregate and a
join on its result, so that a node with very many neighbours is combined map-side and split by the skew join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import stage


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """Edges (u, v) with v < u. large star (both): each larger neighbour of a node gets the least of its neighbourhood;
    small star: the node and its smaller neighbours get it."""
    around = edges.select("u", "v")
    if both:
        around = around.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = around.join(least, "u")
    if both:
        linked = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        linked = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return linked.where("u <> v").distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the least node reachable from each node that has an edge to another one. Null ends and loops are
    ignored; no edges give no rows."""
    links = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(
        F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b))
    )
    links = stage(links.distinct(), "links")
    seen = None
    while True:
        state = links.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state["n"] == 0 or state == seen:
            return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        seen = state
        links = stage(_star(_star(links, True), False), "links")
