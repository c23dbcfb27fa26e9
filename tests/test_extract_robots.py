"""One-pass HTML extraction and robots rules on inline fixtures."""

import os
import sys

from pyspark.sql import functions as F

from sitelens.operators import extract as EX
from sitelens.operators import robots as RB

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))  # for oracle_check

HTML = """<!DOCTYPE html><html lang="en-US"><head><title>Main <i>title</i></title>
<meta property="og:title" content="OG Title"><meta name="twitter:title" content="TW Title">
<meta name="description" content="A description">
<meta name="viewport" content="width=device-width, initial-scale=1">
<link rel="amphtml" href="https://ex.com/amp/">
<link rel="alternate" hreflang="fr" href="https://ex.com/fr/">
<meta property="og:image" content="/img/og.png"><meta name="twitter:image" content="https://cdn.ex.com/tw.jpg">
<meta name="apple-itunes-app" content="app-id=123"><meta property="al:android:package" content="com.ex">
<meta http-equiv="refresh" content="5; URL=https://m.ex.com/">
<style>.hero{background-image: url(/img/bg.jpg)} .x{background-image:url("/img/bg2.png")}</style>
<script type="application/ld+json">{"@context": "https://schema.org", "@type": "Article"}</script>
<script type="application/ld+json">{not json</script>
<script>var s = "</p>"; // react app</script>
</head><body><header class="author">Jane</header>
<article class="post"><h1>Head</h1><p><b>Bold<br><p>Para &amp; more</p></article>
<picture><source srcset="/img/p.webp" type="image/webp" media="(min-width: 600px)"><img src="/img/p.jpg" alt="pic"></picture>
<img data-src="/img/lazy.png" alt="" loading="lazy" width="120" height="80">
<img src="/img/og.png"><time>2024-01-02</time><!-- comment --></body></html>"""


def test_extract_one_fields():
    r = EX.extract_one(HTML)
    assert r["title"] == "Main title"
    content = r["content"].split("\n")
    # article, then .post (same element again), then body
    assert content[0] == "HeadBoldPara & more" and content[1] == content[0]
    assert content[-1].startswith("Jane") and "2024-01-02" in content[-1]
    import json
    meta = json.loads(r["metadata_json"])
    assert meta == {"title": "OG Title", "description": "A description", "author": "Jane", "date": "2024-01-02"}
    imgs = json.loads(r["images_json"])
    assert [i["tag_type"] for i in imgs] == ["img", "img", "img", "picture", "css_background", "css_background",
                                            "meta_og:image", "meta_twitter:image"]
    assert imgs[3]["sources"] == [{"srcset": "/img/p.webp", "media": "(min-width: 600px)", "type": "image/webp"}]
    assert [i["img_url"] for i in imgs[4:6]] == ["/img/bg.jpg", "/img/bg2.png"]
    assert r["viewport_meta"].startswith("width=device-width")
    assert r["amp_url"] == "https://ex.com/amp/"
    assert json.loads(r["app_json"]) == {"apple_app": "app-id=123", "google_app": None,
                                         "app_links": {"al:android:package": "com.ex"}}
    assert len(json.loads(r["structured_json"])) == 2


def test_missing_title_and_many_scripts():
    html = "<html><body>" + "<script>x</script>" * 11 + "<p>t</p></body></html>"
    r = EX.extract_one(html)
    assert r["title"] == "" and r["content"] == "t"
    nobody = EX.extract_one("<p>only <b>text</b></p>")
    assert nobody["content"] == "onlytext"


def test_extract_pages_dataframe(spark):
    df = spark.createDataFrame([(1, "https://ex.com/a/page", HTML), (2, "https://ex.com/b", None)],
                               "page_id long, url string, html string")
    e = EX.extract_pages(df)
    rows = {r.page_id: r for r in e.collect()}
    assert rows[1].metadata["title"] == "OG Title" and rows[1].mobile_app_data.app_links["al:android:package"] == "com.ex"
    assert rows[2].content == "" and rows[2].error is None
    imgs = EX.page_images(e).collect()
    urls = sorted(r.url for r in imgs)
    assert "https://ex.com/img/og.png" in urls and urls.count("https://ex.com/img/og.png") == 1
    og = [r for r in imgs if r.url == "https://ex.com/img/og.png"][0]
    assert og.tag_type == "img"  # first candidate wins
    assert len([r for r in imgs if r.url == "https://ex.com/img/p.jpg"]) == 1
    js = EX.validate_jsonld(e).orderBy("block_pos").collect()
    assert [(r.valid, r.schema_type) for r in js] == [(True, "Article"), (False, None)]
    red = e.withColumn("status_code", F.lit(200)).select(EX.has_mobile_redirect(headers_col=None).alias("m")).collect()
    assert [r.m for r in red] == [True, False]


def test_prefer_rendered(spark):
    raw = spark.createDataFrame([("u1", "short", 10), ("u2", "same", 10)], "url string, content string, text_length long")
    ren = spark.createDataFrame([("u1", "much longer text", 20), ("u2", "x", 11)], "url string, content string, text_length long")
    got = {r.url: (r.content, r.used_renderer) for r in EX.prefer_rendered(raw, ren).collect()}
    assert got == {"u1": ("much longer text", True), "u2": ("same", False)}


ROBOTS = """# comment line
User-agent: *
Disallow: /private/   # trailing comment
Allow: /private/open
Disallow: /tmp
Allow: /tmp

User-agent: googlebot
User-agent: sitelens
Disallow: /nolens/
Crawl-delay: abc
Crawl-delay: 3.5
Disallow: /*.pdf$
Disallow: /search*q=

User-agent: otherbot
Disallow: /
Crawl-delay: 99

Sitemap: https://h.com/sitemap.xml
sitemap:
"""


def test_parse_robots(spark):
    df = spark.createDataFrame([("h.com", ROBOTS)], "host string, body string")
    rules, delays, sitemaps = RB.parse_robots(df, agent="sitelens/0.1")
    got = sorted((r.kind, r.path) for r in rules.collect())
    assert got == sorted([("disallow", "/private/"), ("allow", "/private/open"), ("disallow", "/tmp"), ("allow", "/tmp"),
                          ("disallow", "/nolens/"), ("disallow", "/*.pdf$"), ("disallow", "/search*q=")])
    assert delays.first().crawl_delay == 3.5
    assert [r.sitemap for r in sitemaps.collect()] == ["https://h.com/sitemap.xml"]


def test_robots_filter(spark):
    df = spark.createDataFrame([("h.com", ROBOTS)], "host string, body string")
    rules, _, _ = RB.parse_robots(df, agent="sitelens/0.1")
    urls = ["https://h.com/private/x", "https://h.com/private/open/1", "https://h.com/tmp/a", "https://h.com/a.pdf",
            "https://h.com/a.pdf?x", "https://h.com/a.pdfx", "https://h.com/search?q=1", "https://h.com/searchxq=1",
            "https://h.com", "https://other.com/private/", "https://h.com/nolens/z"]
    u = spark.createDataFrame([(x,) for x in urls], "url string")
    got = {r.url: r.allowed for r in RB.robots_filter(u, rules).collect()}
    assert got == {
        "https://h.com/private/x": False, "https://h.com/private/open/1": True,
        "https://h.com/tmp/a": False,  # equal length: allow must be strictly longer
        "https://h.com/a.pdf": False, "https://h.com/a.pdf?x": False, "https://h.com/a.pdfx": True,
        "https://h.com/search?q=1": True,  # query ignored: the path is /search
        "https://h.com/searchxq=1": False, "https://h.com": True, "https://other.com/private/": True,
        "https://h.com/nolens/z": False,
    }
    assert len(got) == len(urls)  # allowed + denied = input


def test_effective_delay(spark):
    d = spark.createDataFrame([("h.com", 3.5)], "host string, crawl_delay double")
    hosts = spark.createDataFrame([("h.com",), ("x.com",)], "host string")
    got = {r.host: r.delay for r in RB.effective_delay(hosts, d, 1.0).collect()}
    assert got == {"h.com": 3.5, "x.com": 1.0}


def test_error_rows_are_kept(spark):
    df = spark.createDataFrame([(1, "<p>x</p>")], "page_id long, html string")
    # an unsupported selector makes every page fail: the row stays, with the error text
    r = EX.extract_pages(df, selectors=["div > p"]).first()
    assert r.page_id == 1 and r.content is None and "unsupported selector" in r.error


def test_attributes_any_order_and_quoting(spark):
    from sitelens.functions import html as H
    df = spark.createDataFrame([("<meta content='a &amp; b' NAME=viewport data-x>",)], "t string")
    r = df.select(H.attr(F.col("t"), "name").alias("n"), H.attr(F.col("t"), "content").alias("c"),
                  H.attr(F.col("t"), "data-x").alias("x"), H.attr(F.col("t"), "missing").alias("m")).first()
    assert (r.n, r.c, r.x, r.m) == ("viewport", "a & b", "", None)
    tags = spark.createDataFrame([('<img src="a.png"><IMG data-src=b.png><picture><img src=c></picture>',)], "h string")
    got = tags.select(H.tags("h", "img").alias("t"), H.blocks("h", "picture").alias("b")).first()
    assert len(got.t) == 3 and len(got.b) == 1


def test_page_images_oracle_on_fixture(spark, tmp_path):
    import duckdb

    from oracle_check import digest
    from sitelens.plans import oracle_sql as Q
    path = str(tmp_path / "pages.parquet")
    spark.createDataFrame([(1, "https://ex.com/a/page", HTML), (2, "https://ex.com/b", "<p>none</p>")],
                          "page_id long, url string, html string").coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{path}/*.parquet')")
    exp = digest(con.execute(Q.page_images_sql()).fetchdf())
    got = digest(EX.page_images(EX.extract_pages(spark.read.parquet(path))).select("page_url", "url", "tag_type", "pos").toPandas())
    assert got[:3] == exp[:3] and got[0] == 6, (got[3], exp[3])
    jexp = digest(con.execute(Q.jsonld_validity_sql()).fetchdf())
    jgot = digest(EX.validate_jsonld(EX.extract_pages(spark.read.parquet(path))).withColumn("block_pos", F.col("block_pos").cast("long")).toPandas())
    assert jgot[:3] == jexp[:3] and jgot[0] == 2, (jgot[3], jexp[3])


def test_mobile_redirect_from_location_header(spark):
    df = spark.createDataFrame([
        (301, {"Location": "https://m.ex.com/"}, None), (302, {"Location": "https://ex.com/desk"}, None),
        (200, {}, "0; url=https://ex.com/mobile/"), (200, None, "0;URL=https://ex.com/")],
        "status_code int, headers map<string,string>, meta_refresh string")
    got = [r[0] for r in df.select(EX.has_mobile_redirect()).collect()]
    assert got == [True, False, True, False]


def test_implied_end_tags():
    def author(html):
        import json
        return json.loads(EX.extract_one(html)["metadata_json"]).get("author")

    assert author('<p class="author">Jane<p>Long') == "Jane"
    assert author('<ul><li class="author">Jane <b>A<li>Next</ul>') == "JaneA"
    assert author('<table><tr><td class="author">Jane<td>x<tr><td>y</table>') == "Jane"
    assert author('<dl><dt class="author">Jane<dd>x</dl>') == "Jane"
    assert author('<p class="author">Jane<div>x</div></p>') == "Jane"
    # a list or a table inside keeps the outer element open
    assert author('<ul><li class="author">Jane<ul><li>in</ul>out</ul>') == "Janeinout"
    assert author('<div class="author">Jane<p>one<p>two</div>three') == "Janeonetwo"


def test_unclosed_tags_are_linear():
    import time
    page = lambda n: "<body>" + "<span>x" * n
    start = time.process_time()
    r = EX.extract_one(page(100_000), selectors=["body"], metadata={})
    assert r["content"] == "x" * 100_000 and time.process_time() - start < 20
