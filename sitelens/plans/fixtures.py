"""Stand-in inputs derived from the driver tables.

The driver tables hold raw pages (page_id, url, html) but no fetch metadata,
snapshots, link graph with hits, or domain lists. These builders only shape
rows into the schemas the operators expect; they do none of an operator's
work. Each definition is mirrored in the SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.urls import path, url_domain
from sitelens.session import read_table

CRAWLER_TYPES = ["desktop", "mobile", "image"]
EPOCH = "2024-01-01 00:00:00"
ISO = "yyyy-MM-dd'T'HH:mm:ss"


def pages(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "pages")


def page_records(spark, sf_dir: str) -> DataFrame:
    """A6 input: pages + status 200, text/html, depth from the path, a crawl
    time of 2024-01-01 + page_id minutes (ISO string) and a crawler type."""
    p = pages(spark, sf_dir)
    slashes = F.length(path("url")) - F.length(F.replace(path("url"), F.lit("/"), F.lit("")))
    # wall-clock arithmetic without a time zone (no DST shifts whatever the session zone)
    ts = F.to_timestamp_ntz(F.lit(EPOCH)) + F.make_dt_interval(mins=F.col("page_id"))
    ctype = F.element_at(F.array(*[F.lit(t) for t in CRAWLER_TYPES]), (F.col("page_id") % 3 + 1).cast("int"))
    return p.select(
        "page_id", "url", "html",
        F.greatest(slashes - 1, F.lit(0)).cast("long").alias("depth"),
        F.lit(200).cast("long").alias("status_code"),
        F.lit("text/html; charset=utf-8").alias("content_type"),
        F.date_format(ts, ISO).alias("crawl_time"),
        F.octet_length("html").cast("long").alias("size"),
        ctype.alias("crawler_type"),
    )


def page_versions(spark, sf_dir: str) -> DataFrame:
    """H1/F8 input: every record plus a second snapshot one day later for a
    quarter of the pages, with changed html for half of those."""
    r = page_records(spark, sf_dir).withColumn("seq", F.col("page_id") * 2)
    later = (
        r.where(F.col("page_id") % 4 == 0)
        .withColumn("crawl_time", F.date_format(F.to_timestamp_ntz("crawl_time") + F.expr("INTERVAL 1 DAY"), ISO))
        .withColumn("html", F.when(F.col("page_id") % 8 == 0, F.concat("html", F.lit("<!-- v2 -->"))).otherwise(F.col("html")))
        .withColumn("seq", F.col("seq") + 1)
    )
    return r.unionByName(later)


def derived_edges(spark, sf_dir: str) -> DataFrame:
    """F1 input: page i links to pages (3i+1) mod N and (7i+2) mod N."""
    p = pages(spark, sf_dir).select("page_id", "url")
    n = p.count()  # one scalar
    dst = p.select(F.col("page_id").alias("dst_id"), F.col("url").alias("dst_url"))
    out = p.select(
        F.col("url").alias("src_url"),
        F.posexplode(F.array((F.col("page_id") * 3 + 1) % n, (F.col("page_id") * 7 + 2) % n)).alias("pos", "dst_id"),
    )
    return out.join(dst, "dst_id").select("src_url", "dst_url", F.col("pos").cast("long").alias("pos"))


def domain_rows(spark, sf_dir: str) -> DataFrame:
    """Domain-list input: the distinct hosts of `pages`, tagged
    new_registration / phishing by the parity of the last md5 hex digit."""
    d = pages(spark, sf_dir).select(url_domain("url").alias("domain")).distinct()
    even = F.substring(F.md5("domain"), 32, 1).isin(*list("02468ace"))
    return d.select(
        "domain",
        F.when(even, F.lit("new_registration")).otherwise(F.lit("phishing")).alias("type"),
    )


def benchmark_queries(spark, sf_dir: str) -> DataFrame:
    """I10 input: every benchmark text whole."""
    return read_table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


# One robots file per host (a stand-in: the driver tables hold no robots files).
ROBOTS_TEMPLATE = (
    "# robots for {host}\n"
    "User-agent: *\n"
    "Disallow: /fr/\n"
    "Allow: /fr/1\n"
    "Disallow: /*.html$\n"
    "Crawl-delay: 2\n"
    "\n"
    "User-agent: otherbot\n"
    "Disallow: /\n"
    "Crawl-delay: 30\n"
    "\n"
    "Sitemap: https://{host}/sitemap.xml\n"
)


def robots_files(spark, sf_dir: str) -> DataFrame:
    """(host, body) for every distinct host of `pages`."""
    from sitelens.functions.urls import netloc
    hosts = pages(spark, sf_dir).select(F.lower(netloc("url")).alias("host")).distinct()
    head, tail = ROBOTS_TEMPLATE.split("{host}", 1)
    mid, end = tail.split("{host}", 1)
    return hosts.select("host", F.concat(F.lit(head), F.col("host"), F.lit(mid), F.col("host"), F.lit(end)).alias("body"))


def markup_pages(spark, sf_dir: str) -> DataFrame:
    """The pages with markup that they lack, chosen by page_id: meta, link and script tags at the end of the head, two
    links and images at the start of the body."""
    i = F.col("page_id")
    n = i.cast("string")
    pick = lambda by, *texts: F.element_at(F.array(*texts), (i % by + 1).cast("int"))
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    none = F.lit("")
    description = text('content="Page ', n, ": don't miss &#8211; it's new\"")
    head = F.concat(
        pick(4, none, F.lit('<meta name="viewport" content="width=device-width">'),
             F.lit("<META CONTENT='width=device-width, initial-scale=1' NAME=viewport>"),
             F.lit('<!-- <meta name="viewport" content="hidden"> -->')),
        F.when(i % 3 == 0, text('<link href="/amp?id=', n, '&amp;x=1" rel="amphtml">')).otherwise(none),
        F.when(i % 5 == 0, none).when(i % 2 == 0, text('<meta name="description" ', description, ">"))
        .otherwise(text("<meta ", description, " name=description>")),
        F.when(i % 2 == 0, text('<meta content="/og/', n, '.png" property="og:image">')).otherwise(none),
        F.when(i % 6 == 0, F.lit('<link rel="alternate" hreflang="fr" href="/fr"><link hreflang=de rel=alternate href=/de>')).otherwise(none),
        pick(4, none, F.lit('<script type="application/ld+json">{"@type": "Article"}</script>'),
             F.lit('<script type="application/ld+json">{"@graph": [{"@type": "WebPage"}]}</script>'),
             F.lit('<script type="application/ld+json">{"@type": </script>')),
        F.when(i % 7 == 0, F.lit('<script src="/vue.min.js"></script>')).otherwise(none),
    )
    image = lambda k, rest: text('<img src="/img/', n, f'-{k}.png"', rest, ">")
    body = F.concat(
        text('<!-- <a href="/hidden">h</a> --><a data-href="/wrong" href="https://www.site', (i % 5).cast("string"),
             '.example.org/p/?b=2&amp;a=1">off</a><a href=', F.col("url"), ">self</a>"),
        F.when(i % 3 > 0, image(0, none)).otherwise(none), F.when(i % 3 > 1, image(1, ' alt="one"')).otherwise(none),
    )
    html = F.replace("html", F.lit("</head>"), F.concat(head, F.lit("</head>")))
    return pages(spark, sf_dir).select("page_id", "url", F.replace(html, F.lit("<body>"), F.concat(F.lit("<body>"), body)).alias("html"))


def typed_records(spark, sf_dir: str) -> DataFrame:
    """Crawl rows with content types, missing URLs and missing titles chosen by page_id."""
    i = F.col("page_id")
    kinds = ["text/html; charset=utf-8", " TEXT/HTML", "application/pdf", "image/png", None]
    return pages(spark, sf_dir).select(
        "page_id",
        F.when(i % 7 == 0, F.lit(None)).when(i % 7 == 1, F.lit("")).otherwise(F.col("url")).alias("url"),
        F.when(i % 4 == 0, F.lit(None)).otherwise(F.concat(F.lit("t"), i)).alias("title"),
        F.element_at(F.array(*[F.lit(k) for k in kinds]), (i % 5 + 1).cast("int")).alias("content_type"),
    )


def linked_documents(spark, sf_dir: str) -> DataFrame:
    """The documents; every second one mentions two URLs."""
    d = read_table(spark, sf_dir, "documents")
    mention = F.concat(F.lit(" see https://docs.example.org/d/"), F.col("doc_id"), F.lit("?x=1 or http://h"),
                       F.col("doc_id") % 3, F.lit(".example.com for more"))
    return d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.concat("text", mention)).otherwise(F.col("text")).alias("text"))
