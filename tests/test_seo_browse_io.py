"""SEO scoring, sitemap rows, browser operators, sources and sinks, streaming index."""

import json
import os
import struct
import zlib

from pyspark.sql import functions as F

from sitelens.operators import browse as BR
from sitelens.operators import changes as CH
from sitelens.operators import seo as SEO
from sitelens.sources import io as IO


def test_priority_changefreq_band(spark):
    df = spark.createDataFrame([(95.0, 0), (85.0, 2), (72.0, None), (None, 9), (50.0, None)], "s double, d long")
    got = [r[0] for r in df.select(SEO.sitemap_priority("s", "d")).collect()]
    assert got == [1.0, 0.6, 0.6, 0.1, 0.5]
    c = spark.createDataFrame([("text/news",), ("Blog",), ("product/x",), (None,)], "c string")
    assert [r[0] for r in c.select(SEO.change_freq("c")).collect()] == ["daily", "daily", "weekly", "monthly"]
    b = spark.createDataFrame([(80.0,), (60.0,), (59.9,), (None,)], "s double")
    assert [r[0] for r in b.select(SEO.score_band("s")).collect()] == ["good", "average", "poor", None]


def test_keyword_density_in_row(spark):
    df = spark.createDataFrame([(0, ["b", "a", "b", "c"]), (1, []), (2, ["x"] * 3 + ["y"] * 197), (3, None)],
                               "k long, tokens array<string>")
    got = {r.k: r.keyword_density for r in SEO.keyword_density(df, "k").collect()}
    assert got == {0: 50.0, 1: 0.0, 2: 98.5, 3: 0.0}


def test_latest_by_url_first_wins_on_ties(spark):
    df = spark.createDataFrame([("u", "2024-01-01T00:00:00", 0, "a"), ("u", "2024-01-02T00:00:00", 1, "b"),
                                ("u", "2024-01-02T00:00:00", 2, "c"), ("v", None, 3, "d")],
                               "url string, crawl_time string, seq long, html string")
    got = {r.url: r.html for r in SEO.latest_by_url(df).collect()}
    assert got == {"u": "b", "v": "d"}


def test_score_and_issues(spark):
    html = ('<html><head><title>' + "t" * 40 + '</title><meta name="viewport" content="w">'
            '<script type="application/ld+json">{}</script></head><body><h1>x</h1>' + "word " * 300 + '</body></html>')
    df = spark.createDataFrame([("https://a.com/p", html)], "url string, html string")
    edges = spark.createDataFrame([("https://a.com/p", "https://a.com/q"), ("https://a.com/p", "https://a.com/r"),
                                   ("https://a.com/p", "https://b.com/")], "src_url string, dst_url string")
    f = SEO.seo_issues(SEO.seo_score(SEO.seo_factors(df, edges))).first()
    # fails: meta description (4) and keyword density (4: one word repeated); passes the rest (31 of 39)
    assert f.seo_score == round(100 * 31 / 39, 1)
    types = {i.factor: i.type for i in f.seo_issues}
    assert types["meta_description_length"] == "issue" and types["https"] == "good"
    assert types["keyword_density"] == "issue" and types["image_alt_text"] == "good"


def test_sitemap_shards_index(spark):
    rows = spark.createDataFrame([(f"d{i % 2}.com", f"https://d{i % 2}.com/{i:03d}", "t", "monthly", 0.5) for i in range(9)],
                                 "domain string, loc string, lastmod string, changefreq string, priority double")
    sh = SEO.shard_sitemap(rows, 2).collect()
    d0 = sorted((r.loc, r.shard) for r in sh if r.domain == "d0.com")
    assert [s for _, s in d0] == [0, 0, 1, 1, 2]
    idx = SEO.sitemap_index(SEO.shard_sitemap(rows, 2), "https://ex.com/", "now").collect()
    assert len(idx) == 3 + 2 and all(r.loc.startswith("https://ex.com/sitemap_") for r in idx)


def test_browse(spark):
    df = spark.createDataFrame([
        ("u1", "Spark Guide", "text", "desktop", "2024-01-03T00:00:00", "text/html", 0),
        ("u2", None, "spark inside", "image", None, None, 1),
        ("u3", "Other", "nothing", "mobile", "2024-01-05T00:00:00", "text/html; x", 2)],
        "url string, title string, content string, crawler_type string, crawl_time string, content_type string, seq long")
    assert [r.url for r in BR.filter_results(df, "SPARK").collect()] == ["u1", "u2"]
    assert [r.url for r in BR.filter_results(df, "spark", "image").collect()] == ["u2"]
    assert [r.url for r in BR.sort_results(df, "date_desc").collect()] == ["u3", "u1", "u2"]
    assert [r.url for r in BR.sort_results(df, "relevance", "spark").collect()] == ["u1", "u2", "u3"]
    p = BR.paginate(df, BR.sort_keys(df, "date_asc"), page=2, size=2).collect()
    assert [(r.url, r.position) for r in p] == [("u3", 3)]
    assert BR.total_pages(df, 2).first().total_pages == 2
    c = BR.result_counters(df).first()
    assert (c.total_urls, c.total_pages, c.total_images) == (3, 2, 1)
    feed = BR.results_feed(df, n=2, last_updated="x").first()
    assert feed.total_results == 2 and [r["url"] for r in json.loads(feed.results)] == ["u3", "u1"]
    cards = {r.url: r for r in BR.result_cards(df).collect()}
    assert cards["u2"].card_title == "No Title" and cards["u3"].card_type == "Type: text/html"


def test_changed_pages_and_stats(spark):
    prev = spark.createDataFrame([("a", "x", {"ETag": "1"}), ("b", "y", {}), ("c", "z", {"Last-Modified": "m"})],
                                 "url string, html string, headers map<string,string>")
    cur = spark.createDataFrame([("a", "changed body", {"ETag": "1"}), ("b", "y2", {}), ("c", "z", {"Last-Modified": "n"}), ("d", "w", {})],
                                "url string, html string, headers map<string,string>")
    got = {r.url: r.change_status for r in CH.changed_pages(prev, cur).collect()}
    assert got == {"a": "unchanged", "b": "changed", "c": "changed", "d": "new"}
    res = spark.createDataFrame([("s1", "desktop", "2024-01-01T00:00:00", None), ("s1", "desktop", "2024-01-01T00:00:10", None),
                                 ("s1", "mobile", "2024-01-01T00:00:20", "boom")],
                                "seed string, crawler_type string, crawl_time string, error string")
    st = CH.crawl_stats(res).first()
    assert (st.urls_crawled, st.pages_indexed, st.errors, st.duration) == (1, 2, 1, 20.0)


def _png(w, h):
    raw = b"".join(b"\x00" + b"\xff\x00\x00" * w for _ in range(h))
    def chunk(t, d):
        return struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d) & 0xFFFFFFFF)
    return (b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0))
            + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b""))


def test_sources_and_sinks_roundtrip(spark, tmp_path):
    d = str(tmp_path)
    os.makedirs(f"{d}/crawl")
    with open(f"{d}/crawl/desktop_1.json", "w") as f:
        json.dump([{"url": "https://a.com", "depth": 0, "status_code": 200, "crawler_type": "desktop", "headers": {"X": "1"}},
                   {"url": "https://a.com/b", "error": "boom", "crawler_type": "desktop"}], f)
    with open(f"{d}/crawl/mobile_2.json", "w") as f:
        json.dump({"url": "https://m.a.com", "crawler_type": "mobile", "has_mobile_redirect": True}, f)
    with open(f"{d}/crawl/broken_3.json", "w") as f:
        f.write("{not json")
    a1 = IO.read_crawl_results(spark, f"{d}/crawl", "desktop")
    assert sorted(r.url for r in a1.collect()) == ["https://a.com", "https://a.com/b"]
    a2 = IO.read_json_tree(spark, d)
    assert a2.count() == 3
    lost = IO.read_quarantine(spark, f"{d}/crawl").collect()
    assert [(r.source_file, r.record) for r in lost] == [("broken_3.json", "{not json")]
    assert IO.read_quarantine(spark, d, tree=True).count() == 1 and IO.read_crawl_results(spark, f"{d}/crawl").count() == 3
    # B1 + A3-like store, B2, B3
    assert IO.write_crawl_results(a2, f"{d}/out", 123) is True
    assert IO.write_crawl_results(a2.limit(0), f"{d}/out", 124) is False
    IO.append_store(a2.select("url", "crawler_type"), f"{d}/store", "2024-01-01")
    IO.append_store(spark.createDataFrame([("s", "stats")], "url string, crawler_type string"), f"{d}/store", "t")
    IO.append_store(spark.createDataFrame([("u", None)], "url string, crawler_type string"), f"{d}/store", "t")
    assert sorted(r.url for r in IO.read_store(spark, f"{d}/store").collect()) == sorted([r.url for r in a2.collect()] + ["u"])
    assert IO.read_store(spark, f"{d}/store", "mobile").count() == 1
    IO.write_stats(spark.createDataFrame([(1.0, 2)], "start_time double, urls_crawled long"), f"{d}/stats")
    assert spark.read.json(f"{d}/stats").first().urls_crawled == 2
    # B4-B6, B8, B10
    IO.export_json(a2, f"{d}/export")
    IO.export_json(a2, f"{d}/export_grouped", grouped=True)
    parts = sorted(f for f in os.listdir(f"{d}/export_grouped") if f.startswith("part-"))
    doc = json.loads("".join(open(f"{d}/export_grouped/{f}").read() for f in parts))
    assert {k: len(v) for k, v in doc.items()} == {"desktop": 2, "mobile": 1}
    IO.export_csv(a2.select("url", "headers"), f"{d}/csv")
    IO.export_xml(a2.select("url", "crawler_type"), f"{d}/xml")
    assert spark.read.format("xml").option("rowTag", "result").load(f"{d}/xml").count() == 3
    assert IO.project_export(a2).columns == ["url", "title", "content", "metadata", "crawler_type", "crawl_time", "seo_score"]
    rows = spark.createDataFrame([("a.com", "https://a.com/?x=1&y=2", "t", "monthly", 0.5)],
                                 "domain string, loc string, lastmod string, changefreq string, priority double")
    IO.write_sitemaps(rows, f"{d}/sitemaps")
    xml_files = [os.path.join(r, f) for r, _, fs in os.walk(f"{d}/sitemaps") for f in fs if f.endswith(".xml")]
    body = open(xml_files[0]).read()
    assert "sitemaps.org" in body and "&amp;y=2" in body
    IO.write_domain_dataset(spark.createDataFrame([("a.com", "whoisds", "d", "new_registration")],
                                                  "domain string, source string, date string, type string"), f"{d}/ds")
    # A4 domain lists
    os.makedirs(f"{d}/lists")
    open(f"{d}/lists/2024-01-02.txt", "w").write("a.com\n b.org \n\n")
    open(f"{d}/phish.txt", "w").write("evil.com\n")
    dl = IO.read_domain_lists(spark, f"{d}/lists", f"{d}/phish.txt").collect()
    assert sorted((r.domain, r.list_date, r.type) for r in dl) == [
        ("a.com", "2024-01-02", "new_registration"), ("b.org", "2024-01-02", "new_registration"), ("evil.com", None, "phishing")]
    # A5/B7 index
    docs0, post0 = IO.read_index(spark, f"{d}/noindex")
    assert docs0.count() == 0 and post0.count() == 0
    from sitelens.operators import index as IX
    docs = IX.build_documents(spark.createDataFrame([("u", "Hello world")], "url string, title string"))
    IO.write_index(docs, IX.build_postings(docs), f"{d}/index")
    d1, p1 = IO.read_index(spark, f"{d}/index")
    assert d1.count() == 1 and sorted(r.term for r in p1.collect()) == ["hello", "world"]
    # A7 images
    os.makedirs(f"{d}/img")
    open(f"{d}/img/a.png", "wb").write(_png(3, 2))
    open(f"{d}/img/bad.png", "wb").write(b"not an image")
    im = {os.path.basename(r.path): r for r in IO.read_images(spark, f"{d}/img").collect()}
    assert (im["a.png"].px_width, im["a.png"].px_height) == (3, 2) and im["a.png"].analysis_error is None
    assert im["bad.png"].analysis_error is not None and im["bad.png"].size_bytes == 12
    # A6 page records
    pr = IO.page_records(spark.createDataFrame([("u", "<p>é</p>")], "url string, html string")).first()
    assert pr.status_code == 200 and pr.size == 9


def test_stream_index_idempotent(spark, tmp_path):
    from pyspark.sql import types as T

    from sitelens.streaming import index_stream as ST
    d = str(tmp_path)
    os.makedirs(f"{d}/in")
    spark.createDataFrame([("https://a.com/1", "<title>One</title>alpha"), ("https://a.com/2", "<title>Two</title>beta")],
                          "url string, html string").write.parquet(f"{d}/in/b1")
    schema = T.StructType([T.StructField("url", T.StringType()), T.StructField("html", T.StringType())])
    src = ST.crawl_file_stream(spark, f"{d}/in/*", schema, fmt="parquet")
    q = ST.stream_index(ST.pages_as_index_rows(src), f"{d}/index", f"{d}/ckpt")
    q.awaitTermination()
    spark.createDataFrame([("https://a.com/2", "<title>Two v2</title>gamma"), ("https://a.com/3", "<title>Three</title>")],
                          "url string, html string").write.parquet(f"{d}/in/b2")
    q = ST.stream_index(ST.pages_as_index_rows(ST.crawl_file_stream(spark, f"{d}/in/*", schema, fmt="parquet")),
                        f"{d}/index", f"{d}/ckpt")
    q.awaitTermination()
    docs, post = ST.read_latest_index(spark, f"{d}/index")
    got = {r.url: (r.doc_id, r.title) for r in docs.collect()}
    assert got == {"https://a.com/1": (0, "One"), "https://a.com/2": (1, "Two v2"), "https://a.com/3": (2, "Three")}
    terms = {r.term for r in post.where("doc_id = 1").collect()}
    assert "gamma" in terms and "beta" not in terms
    assert len(ST.finished_versions(spark, f"{d}/index")) == 2


def test_pages_are_the_order_cut_in_slices(spark):
    df = spark.range(0, 500).select(F.col("id").alias("seq"), (F.col("id") * 37 % 101).alias("score"), F.lit("u").alias("url"))
    order = [(F.col("score"), False), (F.col("seq"), True)]
    want = sorted(((-(i * 37 % 101), i) for i in range(500)))
    for page, size in ((1, 25), (7, 25), (20, 25), (21, 25), (3, 200)):
        got = [(r.position, r.seq) for r in BR.paginate(df, order, page=page, size=size).orderBy("position").collect()]
        start = (page - 1) * size
        assert got == [(start + k + 1, i) for k, (_, i) in enumerate(want[start : start + size])]
