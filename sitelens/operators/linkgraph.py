"""Link graph on shared storage, bucketed by source, and the frontier expansion over it (F1).

The edges are written once as a table bucketed and sorted by (src, part). In a round only the frontier is shuffled, to the
table's buckets; the edges are read in place and joined without an exchange. A page with very many links is a hub: its
edges are dealt over HUB_PARTS parts by a hash of their target, so they lie in many buckets, and its frontier row is
repeated for each part. Which pages are hubs is stored beside the edges (one row a hub).
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions.urls import normalize_url
from sitelens.operators.graph import DEFAULT_MAX_DEPTH
from sitelens.operators.links import exclusion_predicate
from sitelens.session import cut_lineage, ensure_checkpoint_dir

#: Out-links from which a page is a hub, and the parts of its edges.
HUB_LINKS, HUB_PARTS = 100_000, 64


@dataclass
class LinkGraph:
    """A stored link graph: the name of its edge table, its number of buckets, and its hubs (src)."""

    spark: SparkSession
    table: str
    buckets: int
    hubs: DataFrame
    parts: int

    @property
    def edges(self) -> DataFrame:
        return self.spark.table(self.table)

    def drop(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def store_graph(edges: DataFrame, buckets: int | None = None, src_col: str = "src_url", dst_col: str = "dst_url",
                hub_links: int = HUB_LINKS, hub_parts: int = HUB_PARTS, path: str | None = None) -> LinkGraph:
    """Write the distinct normalised edges, bucketed by (src, part); path: a shared folder (default: beside checkpoints)."""
    spark = edges.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"link_graph_{uuid.uuid4().hex}"
    root = (path or ensure_checkpoint_dir(spark)).rstrip("/")
    pairs = edges.select(normalize_url(src_col).alias("src"), normalize_url(dst_col).alias("dst")).distinct()
    pairs = cut_lineage(pairs)
    degrees = pairs.groupBy("src").agg(F.count("*").alias("links"))
    hubs = cut_lineage(degrees.where(F.col("links") >= hub_links).select("src"))
    is_hub = pairs.join(hubs.withColumn("hub", F.lit(True)), "src", "left")
    part = F.when(F.col("hub"), F.pmod(F.xxhash64("dst"), F.lit(hub_parts))).otherwise(F.lit(0)).cast("int")
    dealt = is_hub.select("src", part.alias("part"), "dst").repartition(n, "src", "part")
    (dealt.write.format("parquet").bucketBy(n, "src", "part").sortBy("src", "part")
     .option("path", f"{root}/{name}").saveAsTable(name))
    return LinkGraph(spark, name, n, hubs, hub_parts)


def expand(graph: LinkGraph, frontier: DataFrame, url_col: str = "url") -> DataFrame:
    """Targets of the frontier's URLs; the frontier is shuffled to the buckets, the edges are not."""
    rows = frontier.select(F.col(url_col).alias("src")).join(graph.hubs.withColumn("hub", F.lit(True)), "src", "left")
    parts = F.when(F.col("hub"), F.sequence(F.lit(0), F.lit(graph.parts - 1))).otherwise(F.array(F.lit(0)))
    keyed = rows.select("src", F.explode(parts).alias("part")).repartition(graph.buckets, "src", "part")
    # the hint keeps a small frontier from being sent to all executors, and the buckets from being scanned without order
    return keyed.hint("merge").join(graph.edges, ["src", "part"]).select(F.col("dst").alias("url"))


def crawl_graph(graph: LinkGraph, seeds: DataFrame, max_depth: int = DEFAULT_MAX_DEPTH, exclude=None,
                mode: str = "search", seed_col: str = "url") -> DataFrame:
    """(url, depth) of every URL reached within max_depth hops, by levels; excluded URLs are neither given nor expanded."""
    def level(urls: DataFrame, depth: int) -> DataFrame:
        return cut_lineage(urls.withColumn("depth", F.lit(depth).cast("long")).withColumn("excluded", exclusion_predicate("url", exclude, mode)))

    levels = [level(seeds.select(normalize_url(seed_col).alias("url")).distinct(), 0)]
    for depth in range(1, max_depth + 1):
        visited = reduce(DataFrame.unionByName, levels).select("url")
        found = expand(graph, levels[-1].where(~F.col("excluded"))).distinct().join(visited, "url", "left_anti")
        nxt = level(found, depth)
        if nxt.isEmpty():
            break
        levels.append(nxt)
    return reduce(DataFrame.unionByName, levels).where(~F.col("excluded")).select("url", "depth")
