"""Explicit schemas of the stored records (never inferred)."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()
STR_MAP = T.MapType(S, S)

PAGE_RECORD = T.StructType([
    T.StructField("url", S),
    T.StructField("depth", T.LongType()),
    T.StructField("status_code", T.LongType()),
    T.StructField("content_type", S),
    T.StructField("crawl_time", S),
    T.StructField("size", T.LongType()),
    T.StructField("headers", STR_MAP),
    T.StructField("title", S),
    T.StructField("content", S),
    T.StructField("metadata", STR_MAP),
    T.StructField("crawler_type", S),
    T.StructField("viewport", S),
    T.StructField("used_selenium", T.BooleanType()),
    T.StructField("structured_data", T.ArrayType(S)),
    T.StructField("has_mobile_redirect", T.BooleanType()),
    T.StructField("viewport_meta", S),
    T.StructField("amp_url", S),
    T.StructField("mobile_app_data", T.StructType([
        T.StructField("apple_app", S), T.StructField("google_app", S), T.StructField("app_links", STR_MAP)])),
    T.StructField("seo_score", T.DoubleType()),
    T.StructField("error", S),
])

IMAGE_RECORD = T.StructType([
    T.StructField("url", S), T.StructField("page_url", S), T.StructField("content_type", S),
    T.StructField("size_bytes", T.LongType()), T.StructField("last_modified", S),
    T.StructField("crawler_type", S), T.StructField("alt", S), T.StructField("title", S),
    T.StructField("width", S), T.StructField("height", S), T.StructField("loading", S),
    T.StructField("tag_type", S),
    T.StructField("sources", T.ArrayType(T.StructType([
        T.StructField("srcset", S), T.StructField("media", S), T.StructField("type", S)]))),
    T.StructField("hash", S), T.StructField("format", S), T.StructField("mode", S),
    T.StructField("analysis_error", S),
])

CRAWL_STATS = T.StructType([
    T.StructField("start_time", T.DoubleType()), T.StructField("urls_crawled", T.LongType()),
    T.StructField("pages_indexed", T.LongType()), T.StructField("errors", T.LongType()),
    T.StructField("duration", T.DoubleType()), T.StructField("urls_submitted", T.LongType()),
])

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("url", S), T.StructField("title", S),
    T.StructField("snippet", S), T.StructField("type", S), T.StructField("date", S),
])
POSTINGS = T.StructType([T.StructField("term", S), T.StructField("doc_id", T.LongType())])

# union of page and image fields: the shape of a crawl-results file of any type
CRAWL_RESULT = T.StructType(
    PAGE_RECORD.fields + [f for f in IMAGE_RECORD.fields if f.name not in PAGE_RECORD.fieldNames()]
)

EXPORT_FIELDS = ["url", "title", "content", "metadata", "crawler_type", "crawl_time", "seo_score"]
