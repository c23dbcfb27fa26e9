"""HTML columns, keys and orders against literal expected values."""

from pyspark.sql import functions as F

from sitelens.functions import html as H
from sitelens.operators import browse as BR
from sitelens.operators import changes as CH
from sitelens.operators import index as IX
from sitelens.operators import links as LK
from sitelens.operators import seo as SEO
from sitelens.streaming.index_stream import pages_as_index_rows


def one(spark, html, column):
    return spark.createDataFrame([(html,)], "html string").select(column.alias("x")).first()["x"]


def test_hrefs(spark):
    cases = [
        ("<a href=\"/o'neil\">x</a>", ["/o'neil"]),
        ("<a href='/say\"x\"'>x</a>", ['/say"x"']),
        ("<a href=/plain>x</a>", ["/plain"]),
        ('<a data-href="/wrong" href="/right">x</a>', ["/right"]),
        ('<!-- <a href="/hidden">x</a> --><script>"<a href=\'/js\'>"</script><a class="b" HREF = "/shown">x</a>', ["/shown"]),
        ('<a title="a > b" href="/after">x</a>', ["/after"]),
        ("<a href='?a=1&amplitude=2&copy=3'>x</a>", ["?a=1&amplitude=2&copy=3"]),
        ("<a href='?a=1&amp;b=2&lt'>x</a>", ["?a=1&b=2<"]),
        ("<abbr href='/no'>x</abbr><a name=x>y</a>", []),
        (None, []),
    ]
    for html, want in cases:
        assert one(spark, html, H.hrefs("html")) == want, html


def test_entities(spark):
    cases = [
        ("Caf&eacute; &#8211; &#233; &#xE9;", "Café – é é"), ("&lt;b&gt; &amp;lt; &quot;x&quot;", '<b> &lt; "x"'),
        ("&unknown; &; AT&T &copy2024 &notin; &Aacute", "&unknown; &; AT&T ©2024 ∉ Á"), ("&#0; &#xD800; &#128512;", "\ufffd \ufffd 😀"),
        ("no reference", "no reference"),
    ]
    for text, want in cases:
        assert one(spark, text, H.decode_entities("html")) == want, text
    assert one(spark, "<title>Caf&eacute; &#8211; &#233;</title>", H.page_title("html")) == "Café – é"


def test_meta_tags_in_any_order_and_quotes(spark):
    cases = ['<meta name="viewport" content="w=1">', "<META CONTENT='w=1' NAME=viewport>", '<meta content="w=1" name="viewport"/>']
    for html in cases:
        assert one(spark, html, H.viewport_meta("html")) == "w=1", html
    assert one(spark, '<!-- <meta name="viewport" content="w=1"> -->', H.viewport_meta("html")) is None
    assert one(spark, "<meta content=\"Don't miss…\" name='description'>", H.meta_content("html", "description")) == "Don't miss…"
    assert one(spark, '<link href="/amp" rel="amphtml">', H.amp_url("html")) == "/amp"
    assert one(spark, '<meta content="x" property="og:title">', H.has_og_tags("html"))
    assert one(spark, '<link rel="alternate" href="/fr" hreflang=fr>', H.hreflangs("html")) == ["fr"]


def test_js_heavy_looks_at_the_whole_script_element(spark):
    assert one(spark, '<script src="/react.min.js"></script>', H.is_js_heavy("html")) is True
    assert one(spark, "<script>var vue = 1</script>", H.is_js_heavy("html")) is True
    assert one(spark, '<p>react</p><script src="/x.js"></script>', H.is_js_heavy("html")) is False
    assert one(spark, "<script></script>" * 11, H.is_js_heavy("html")) is True


def test_description_with_an_apostrophe_scores_like_one_without(spark):
    page = "<title>t</title><meta name='description' content=\"{}\">"
    rows = [(1, "https://a.com/1", page.format("x" * 134 + "'")), (2, "https://a.com/2", page.format("x" * 135))]
    scored = SEO.seo_issues(SEO.seo_score(SEO.seo_factors(spark.createDataFrame(rows, "id int, url string, html string"))))
    got = {r.id: r for r in scored.collect()}
    assert got[1].seo_score == got[2].seo_score
    assert {i.factor: i.type for i in got[1].seo_issues}["meta_description_length"] == "good"


def test_seo_factors_keep_one_row_for_each_input_row(spark):
    html = "<a href='/x'>x</a> alpha beta alpha <a href='https://o.org/'>y</a>"
    rows = [("https://a.com/", html, t) for t in ("desktop", "mobile", "image")]
    df = spark.createDataFrame(rows, "url string, html string, crawler_type string")
    got = SEO.seo_factors(df, LK.page_links(df)).collect()
    assert len(got) == 3
    assert {(r.internal_links, r.external_links, r.word_count, r.keyword_density) for r in got} == {(1, 1, 5, 66.67)}
    stats = LK.crawler_stats(df.withColumn("size", F.lit(1)), LK.page_links(df)).collect()
    assert {(r.crawler_type, r.pages_crawled, r.urls_discovered) for r in stats} == {(t, 1, 2) for t in ("desktop", "mobile", "image")}


def test_density_in_the_row_equals_the_aggregate(spark):
    rows = [(1, ["a", "b", "a", "c"]), (2, []), (3, ["x"] * 3 + ["y"] * 4), (4, ["z"])]
    df = spark.createDataFrame(rows, "k int, tokens array<string>")
    inside = {r.k: r.d for r in df.select("k", SEO.top_share(F.col("tokens")).alias("d")).collect()}
    assert inside == {r.k: r.keyword_density for r in SEO.keyword_density(df, "k").collect()}


def test_upsert_keeps_the_latest_row(spark):
    docs = spark.createDataFrame([], "doc_id long, url string, title string, snippet string, type string, date string")
    posts = spark.createDataFrame([], "term string, doc_id long")
    new = spark.createDataFrame([("u", "zebra", "2024-01"), ("u", "apple", "2024-02")], "url string, title string, date string")
    found, _ = IX.upsert_documents(docs, posts, new)
    assert [(r.url, r.title) for r in found.collect()] == [("u", "apple")]
    pages = spark.createDataFrame([(i, "u", f"<title>{t}</title>") for i, t in ((1, "mmm"), (2, "zzz"), (3, "bbb"))],
                                  "page_id long, url string, html string")
    found, _ = IX.upsert_documents(docs, posts, pages_as_index_rows(pages))
    assert [r.title for r in found.collect()] == ["bbb"]


def test_malformed_times_sort_as_the_epoch(spark):
    rows = [("a", "not a time", 1), ("b", "2024-01-01T00:00:00", 2), ("c", None, 3)]
    df = spark.createDataFrame(rows, "url string, crawl_time string, seq long")
    assert [r.url for r in BR.sort_results(df, "date_desc").collect()] == ["b", "a", "c"]


def test_headers_in_any_case(spark):
    kind = "url string, html string, headers map<string,string>"
    prev = spark.createDataFrame([("u", "x", {"etag": "1"}), ("v", "x", {"ETag": "1"})], kind)
    cur = spark.createDataFrame([("u", "y", {"ETag": "1"}), ("v", "x", {"Etag": "2"})], kind)
    assert {r.url: r.change_status for r in CH.changed_pages(prev, cur).collect()} == {"u": "unchanged", "v": "changed"}


def test_no_wide_column_in_the_aggregates(spark):
    df = spark.createDataFrame([("u", "t", 1, "<p>")], "url string, crawl_time string, seq long, html string")
    plan = SEO.latest_by_url(df)._jdf.queryExecution().executedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "Aggregate" in line]
    assert aggregates and not any("html" in line for line in aggregates)
