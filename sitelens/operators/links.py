"""Link extraction and URL-set operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.html import hrefs
from sitelens.functions.urls import is_valid_url, mime_type, normalize_url, resolve_url, url_domain

# Default URL exclusion patterns (documents and archives, admin
# and upload paths, tag/category listings, tracking parameters).
DEFAULT_EXCLUDES = [
    r".*\.(pdf|zip|rar|tar|gz|doc|docx|xls|xlsx|ppt|pptx)$",
    r"/wp-admin/.*",
    r"/wp-login\.php",
    r"/wp-content/uploads/.*",
    r"/tag/.*",
    r"/category/.*",
    r".*[?&]utm_.*",
]


def exclusion_predicate(col, patterns=None, mode: str = "search"):
    """True when the URL matches any pattern. ``mode='search'`` finds the
    pattern anywhere; ``mode='match'`` anchors it at the start."""
    pats = DEFAULT_EXCLUDES if patterns is None else list(patterns)
    if not pats:
        return F.lit(False)
    if mode == "match":
        pats = [f"^(?:{p})" for p in pats]
    alt = "|".join(f"(?:{p})" for p in pats)
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(c.rlike(alt), F.lit(False))


def exclude_urls(df: DataFrame, patterns=None, mode: str = "search", col: str = "url") -> DataFrame:
    """Drop rows whose URL matches any exclusion regex."""
    return df.where(~exclusion_predicate(col, patterns, mode))


def allow_domains(df: DataFrame, domains=None, col: str = "url") -> DataFrame:
    """Keep rows whose URL domain is allowed; an empty list allows all.
    A long allow-list should be passed as a DataFrame(domain) for a semi join."""
    if domains is None:
        return df
    if isinstance(domains, DataFrame):
        return df.join(domains.select(F.col(domains.columns[0]).alias("__dom")).distinct(),
                       url_domain(col) == F.col("__dom"), "left_semi")
    domains = list(domains)
    if not domains:
        return df
    return df.where(url_domain(col).isin(*domains))


def html_only(df: DataFrame, col: str = "content_type") -> DataFrame:
    """E5: rows whose media type is text/html."""
    return df.where(mime_type(col).startswith("text/html"))


def page_links(df: DataFrame, allowed=None, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Every ``<a href>`` of each page: resolved against the page URL, kept
    when valid, normalised, filtered to allowed domains. Duplicates are kept;
    ``pos`` is the position of the anchor in the page (0-based)."""
    raw = df.select(
        F.col(url_col).alias("src_url"),
        F.posexplode(hrefs(html_col)).alias("pos", "href"),
    )
    resolved = raw.select("src_url", F.col("pos").cast("long").alias("pos"),
                          resolve_url(F.col("src_url"), F.col("href")).alias("abs_url"))
    valid = resolved.where(is_valid_url("abs_url"))
    out = valid.select("src_url", "pos", normalize_url("abs_url").alias("dst_url"))
    if allowed is not None:
        out = allow_domains(out, allowed, col="dst_url")
    return out


def unseen(df: DataFrame, seen: DataFrame, col: str = "url", seen_col: str | None = None) -> DataFrame:
    """rows whose URL is not in the seen set (left anti join)."""
    s = seen.select(F.col(seen_col or col).alias(col)).distinct()
    return df.join(s, col, "left_anti")


def fan_out(df: DataFrame, types=("desktop", "mobile", "image"), col: str = "crawler_type") -> DataFrame:
    """one row per input row and crawler type (a generator, no join)."""
    return df.withColumn(col, F.explode(F.array(*[F.lit(t) for t in types])))


def distinct_links(edges: DataFrame) -> DataFrame:
    """Each link of a page once, also when its URL stands in several rows; told apart by the place in the page (``pos``).
    Edges without places are taken as they are."""
    return edges.select("src_url", "pos", "dst_url").distinct() if "pos" in edges.columns else edges


def crawler_stats(records: DataFrame, edges: DataFrame) -> DataFrame:
    """Per crawler type: pages, links discovered on them, bytes, errors. A URL crawled under several types has its
    links in ``edges`` once for each of its rows, but they count once."""
    links = distinct_links(edges).groupBy("src_url").agg(F.count(F.lit(1)).alias("n_links"))
    has_error = "error" in records.columns
    r = records.join(links, records["url"] == links["src_url"], "left")
    return r.groupBy("crawler_type").agg(
        F.count(F.lit(1)).alias("pages_crawled"),
        F.coalesce(F.sum("n_links"), F.lit(0)).cast("long").alias("urls_discovered"),
        F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes_downloaded"),
        (F.count_if(F.col("error").isNotNull()) if has_error else F.lit(0)).cast("long").alias("errors"),
    )


def urls_by_domain(df: DataFrame, col: str = "url") -> DataFrame:
    """URLs grouped by domain: count, distinct count, first and last URL."""
    return df.groupBy(url_domain(col).alias("domain")).agg(
        F.count(F.lit(1)).alias("n_urls"),
        F.count_distinct(col).alias("n_distinct"),
        F.min(col).alias("first_url"),
        F.max(col).alias("last_url"),
    )
