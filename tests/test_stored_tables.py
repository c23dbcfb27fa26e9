"""Stateful streams, the bucketed link graph and sitemap files."""

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from sitelens.operators import changes as CH
from sitelens.operators import linkgraph as LG
from sitelens.sources import sitemap_source as SS
from sitelens.streaming import change_stream as CS

PAGES = "url string, html string, seq long, headers map<string,string>"


def test_change_stream_equals_batch(spark, tmp_path):
    d = str(tmp_path)
    first = [("a", "x", 1, {"ETag": "1"}), ("b", "x", 2, {}), ("c", "x", 3, {"last-modified": "m"}), ("d", None, 4, None), ("b", "y", 5, {}), (None, "x", 6, {})]
    second = [("a", "changed body", 7, {"etag": "1"}), ("b", "x", 8, {}), ("b", "y", 9, {}), ("c", "x", 10, {"Last-Modified": "n"}),
              ("d", None, 11, {}), ("e", "new", 12, {}), (None, "x", 13, {}), ("a", "x", 14, {"ETag": "2"})]
    for k, rows in enumerate((first, second)):
        spark.createDataFrame(rows, PAGES).write.parquet(f"{d}/in/crawl={k}")
        source = spark.readStream.schema(PAGES).parquet(f"{d}/in/*")
        CS.run_available(CS.change_stream(source), f"{d}/out", f"{d}/checkpoint")
    got = {r.seq: r.change_status for r in spark.read.parquet(f"{d}/out/batch=1").collect()}
    batch = CH.changed_pages(spark.createDataFrame(first, PAGES), spark.createDataFrame(second, PAGES))
    assert got == {r.seq: r.change_status for r in batch.collect()}
    assert set(got.values()) == {"new", "changed", "unchanged"}


def test_unseen_stream(spark, tmp_path):
    d = str(tmp_path)
    for k, rows in enumerate(([("http://a.org/1",), ("http://A.org/1#x",)], [("http://a.org/1",), ("http://a.org/2",)])):
        spark.createDataFrame(rows, "dst_url string").write.parquet(f"{d}/in/crawl={k}")
        source = spark.readStream.schema("dst_url string").parquet(f"{d}/in/*")
        CS.run_available(CS.unseen_stream(source), f"{d}/out", f"{d}/checkpoint")
    found = spark.read.option("basePath", f"{d}/out").parquet(f"{d}/out").collect()
    assert sorted((r.dst_url, r.batch) for r in found) == [("http://a.org/1", 0), ("http://a.org/2", 1)]


@pytest.fixture()
def graph_edges():
    rnd = random.Random(6)
    edges = [(f"http://p.org/{rnd.randrange(80)}", f"http://p.org/{rnd.randrange(80)}") for _ in range(200)]
    return edges + [("http://p.org/3", f"http://hub.org/{i}") for i in range(300)]


def slow_bfs(edges, seeds, depth):
    seen = {s: 0 for s in seeds}
    last = list(seeds)
    for d in range(1, depth + 1):
        last = sorted({b for a, b in edges if a in last} - set(seen))
        seen |= {u: d for u in last}
    return seen


def test_bucketed_graph(spark, graph_edges):
    graph = LG.store_graph(spark.createDataFrame(graph_edges, "src_url string, dst_url string"), buckets=8, hub_links=100, hub_parts=16)
    try:
        assert [r.src for r in graph.hubs.collect()] == ["http://p.org/3"]
        files = graph.edges.where("src = 'http://p.org/3'").select(F.input_file_name()).distinct().count()
        assert files >= 4  # the hub lies in several buckets
        seeds = ["http://p.org/3", "http://p.org/5"]
        got = LG.crawl_graph(graph, spark.createDataFrame([(s,) for s in seeds], "url string"), 3)
        assert {r.url: r.depth for r in got.collect()} == slow_bfs(graph_edges, seeds, 3)
        plan = LG.expand(graph, spark.createDataFrame([("http://p.org/3",)], "url string"))._jdf.queryExecution().executedPlan().toString()
        edge_side = plan[plan.index("SortMergeJoin"):]
        scans = [part for part in re.split(r"\n\s*[:+]- ", edge_side)]
        below = next(i for i, p in enumerate(scans) if "FileScan parquet" in p and "dst" in p)
        assert "Bucketed: true" in scans[below]
        assert not any("Exchange" in p for p in scans[below - 2 : below])
        got = LG.crawl_graph(graph, spark.createDataFrame([("http://p.org/3",)], "url string"), 1, exclude=["/1"])
        assert not any("/1" in r.url for r in got.collect())
    finally:
        graph.drop()


ROWS = "domain string, shard long, loc string, lastmod string, changefreq string, priority string"


def test_sitemap_files_have_the_listed_names(spark, tmp_path):
    rows = [("a.org", i % 2, f"https://a.org/{i}?x=1&y", "2024-01-01", None, "0.5") for i in range(10)] + [("b.org", 0, "https://b.org/", None, "daily", "1.0")]
    path = str(tmp_path / "maps")
    SS.write_sitemaps(spark.createDataFrame(rows, ROWS), path, "https://x.org/", "2024-06-01")
    names = sorted(os.listdir(path))
    listed = re.findall("<loc>https://x.org/(.*?)</loc>", open(f"{path}/{SS.INDEX_NAME}").read())
    assert sorted([*listed, SS.INDEX_NAME]) == names == ["sitemap_a.org_0.xml", "sitemap_a.org_1.xml", "sitemap_b.org_0.xml", "sitemap_index.xml"]
    text = open(f"{path}/sitemap_a.org_1.xml").read()
    assert re.findall("<loc>(.*?)</loc>", text) == [f"https://a.org/{i}?x=1&amp;y" for i in (1, 3, 5, 7, 9)]
    SS.write_sitemaps(spark.createDataFrame(rows[-1:], ROWS), path, "https://x.org/")
    assert sorted(os.listdir(path)) == ["sitemap_b.org_0.xml", "sitemap_index.xml"]


def test_failed_sitemap_leaves_no_file(spark, tmp_path):
    path = str(tmp_path / "maps")
    rows = spark.createDataFrame([("a.org", 0, "https://a.org/", None, None, None)], ROWS)
    many = spark.range(SS.MOST_URLS + 1).selectExpr("'b.org' domain", "0L shard", "concat('https://b.org/', id) loc", "null lastmod", "null changefreq", "null priority")
    with pytest.raises(Exception, match="would hold over"):
        SS.write_sitemaps(rows.unionByName(many.select(*[F.col(c).cast(t) for c, t in rows.dtypes])), path, "https://x.org/")
    assert not os.path.exists(path) or os.listdir(path) == []
