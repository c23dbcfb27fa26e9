"""Frontier expansion over a stored link graph (F1) and the page budget (F2).

Level-synchronous BFS: round ``d`` joins the frontier (URLs first reached at
depth ``d``) with the edges, removes everything already visited (left anti
join) and makes that the next frontier. A URL is thus visited once, at its
smallest depth. Excluded URLs are marked visited but neither emitted nor
expanded. The edge table is checkpointed once, but a round shuffles it again
(a checkpoint keeps no partitioning); :mod:`sitelens.operators.linkgraph` stores
it in buckets instead. Every new level is checkpointed (reliable, under
spark.checkpoint.dir) to keep lineage flat and survive executor loss, and the
visited set is the union of the levels.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.urls import normalize_url
from sitelens.operators.links import exclusion_predicate
from sitelens.session import cut_lineage

DEFAULT_MAX_DEPTH = 3


def crawl_bfs(seeds: DataFrame, edges: DataFrame, max_depth: int = DEFAULT_MAX_DEPTH,
              exclude=None, mode: str = "search", seed_col: str = "url",
              src_col: str = "src_url", dst_col: str = "dst_url") -> DataFrame:
    """-> (url, depth) for every URL reached within ``max_depth`` hops."""
    spark = seeds.sparkSession
    nparts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    e = (
        edges.select(normalize_url(src_col).alias("src"), normalize_url(dst_col).alias("url"))
        .distinct()
        .repartition(nparts, "src")
    )
    e = cut_lineage(e)
    # every level is checkpointed once; the visited set is the union of the
    # levels (flat lineage of checkpoint scans), so each URL is written once
    levels = [cut_lineage(
        seeds.select(normalize_url(seed_col).alias("url")).distinct()
        .withColumn("depth", F.lit(0).cast("long"))
        .withColumn("excluded", exclusion_predicate("url", exclude, mode))
    )]
    for d in range(max_depth):
        visited = reduce(DataFrame.unionByName, levels).select("url")
        expand = levels[-1].where(~F.col("excluded")).select(F.col("url").alias("src"))
        nxt = cut_lineage(
            expand.join(e, "src").select("url").distinct()
            .join(visited, "url", "left_anti")
            .withColumn("depth", F.lit(d + 1).cast("long"))
            .withColumn("excluded", exclusion_predicate("url", exclude, mode))
        )
        if nxt.isEmpty():
            break
        levels.append(nxt)
    return reduce(DataFrame.unionByName, levels).where(~F.col("excluded")).select("url", "depth")


def limit_pages(df: DataFrame, n: int, order=("depth", "url")) -> DataFrame:
    """page budget; 0 means no limit. Keeps the first ``n`` by depth, url."""
    if not n:
        return df
    return df.orderBy(*order).limit(n)
