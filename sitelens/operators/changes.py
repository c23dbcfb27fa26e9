"""Snapshot comparison and run statistics (F8, G1)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def header(df: DataFrame, name: str):
    """A header's value, whatever the case of its name (HTTP/2 sends lower case)."""
    if "headers" in df.columns:
        hits = F.filter(F.map_entries("headers"), lambda e: F.lower(e["key"]) == name.lower())
        return F.get(hits, 0)["value"]
    return F.lit(None).cast("string")


def changed_pages(prev: DataFrame, cur: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """F8: status of every current row against the previous snapshot:
    'new' (url unseen), 'unchanged' (same ETag; else same Last-Modified; else
    same body md5) or 'changed'."""
    # one previous snapshot per url; with repeats the greatest (etag, last-modified, md5) - a deterministic choice
    p = prev.select(
        F.col(url_col).alias("_u"),
        F.struct(header(prev, "ETag").alias("_etag"), header(prev, "Last-Modified").alias("_lm"),
                 F.md5(F.col(html_col)).alias("_md5")).alias("_s"),
    ).groupBy("_u").agg(F.max("_s").alias("_s")).select("_u", "_s.*")
    c = cur.select("*", header(cur, "ETag").alias("etag_"), header(cur, "Last-Modified").alias("lm_"),
                   F.md5(F.col(html_col)).alias("md5_"))
    j = c.join(p, c[url_col] == p["_u"], "left")
    same = (F.when(F.col("etag_").isNotNull() & F.col("_etag").isNotNull(), F.col("etag_") == F.col("_etag"))
            .when(F.col("lm_").isNotNull() & F.col("_lm").isNotNull(), F.col("lm_") == F.col("_lm"))
            .otherwise(F.col("md5_") == F.col("_md5")))
    status = F.when(F.col("_u").isNull(), "new").when(same, "unchanged").otherwise("changed")
    return j.withColumn("change_status", status).drop("_u", "_etag", "_lm", "_md5", "etag_", "lm_", "md5_")


def crawl_stats(results: DataFrame, run_cols=("seed", "crawler_type"), time_col: str = "crawl_time") -> DataFrame:
    """G1: one row: urls_crawled (runs without error), pages_indexed (rows of
    those runs), errors (failed runs), start_time and duration in seconds."""
    has_err = F.col("error").isNotNull() if "error" in results.columns else F.lit(False)
    runs = results.groupBy(*run_cols).agg(
        F.max(has_err.cast("int")).alias("_failed"),
        F.count(F.lit(1)).alias("_rows"),
        F.min(F.col(time_col).try_cast("timestamp_ntz")).alias("_t0"),
        F.max(F.col(time_col).try_cast("timestamp_ntz")).alias("_t1"),
    )
    return runs.agg(
        F.count_if(F.col("_failed") == 0).alias("urls_crawled"),
        F.coalesce(F.sum(F.when(F.col("_failed") == 0, F.col("_rows"))), F.lit(0)).cast("long").alias("pages_indexed"),
        F.count_if(F.col("_failed") == 1).alias("errors"),
        # zone-less crawl times: seconds since the epoch read as wall-clock UTC
        F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), F.min("_t0")).cast("double").alias("start_time"),
        F.timestamp_diff("SECOND", F.min("_t0"), F.max("_t1")).cast("double").alias("duration"),
    )
