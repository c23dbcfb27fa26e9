"""Stateful streams over crawled pages: change detection (F8) and unseen links (F3) in Spark's state store.

The state of a URL is what its next snapshot is compared with (ETag, Last-Modified, body md5), a few dozen bytes, keyed
by URL and spread over the shuffle partitions; no table of all pages is read or rewritten for a micro-batch. A URL that is
not crawled again within the timeout loses its state and counts as new when it comes back. Bodies are hashed in the JVM
before the shuffle, so only digests and headers reach the state and Python.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sitelens.functions.urls import normalize_url
from sitelens.operators.changes import header

#: A URL's state goes when it was not crawled for so long.
FORGET_MS = 90 * 24 * 3600 * 1000

_STATE = "etag string, modified string, md5 string"
_OUT = "url string, seq long, change_status string"


def _status_function(forget_ms: int):
    def status(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (url,) = key
        held = tuple(state.get) if state.exists and url is not None else None
        newest = None
        for frame in frames:
            frame = frame.astype(object).where(frame.notna(), None)
            out = []
            for seq, *mine in zip(frame["seq"], frame["etag"], frame["modified"], frame["md5"]):
                if held is None:
                    out.append((url, seq, "new"))
                else:
                    pairs = [(a, b) for a, b in zip(mine, held) if a is not None and b is not None]
                    out.append((url, seq, "unchanged" if pairs and pairs[0][0] == pairs[0][1] else "changed"))
                rank = tuple((x is not None, x or "") for x in mine)
                if newest is None or rank > newest[0]:
                    newest = (rank, tuple(mine))
            yield pd.DataFrame(out, columns=["url", "seq", "change_status"])
        if newest is not None and url is not None:
            state.update(newest[1])
            if forget_ms:
                state.setTimeoutDuration(forget_ms)

    return status


def change_stream(pages: DataFrame, forget_ms: int = FORGET_MS, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """F8 as a stream: (url, seq, change_status) for every row of a stream of pages (url, html; optional headers, seq),
    against the URL's rows of earlier micro-batches, by the rule of :func:`sitelens.operators.changes.changed_pages`."""
    seq = F.col("seq").cast("long") if "seq" in pages.columns else F.lit(None).cast("long")
    narrow = pages.select(
        F.col(url_col).alias("url"), seq.alias("seq"), header(pages, "ETag").alias("etag"),
        header(pages, "Last-Modified").alias("modified"), F.md5(F.col(html_col)).alias("md5"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if forget_ms else GroupStateTimeout.NoTimeout
    return narrow.groupBy("url").applyInPandasWithState(_status_function(forget_ms), _OUT, _STATE, "append", timeout)


def unseen_stream(links: DataFrame, col: str = "dst_url", time_col: str | None = None, forget: str = "90 days") -> DataFrame:
    """F3 as a stream: every normalised target once, the first time that it is seen. With an event time column its state
    goes after `forget`; without one, targets are remembered for good."""
    rows = links.withColumn(col, normalize_url(col))
    if time_col is None:
        return rows.dropDuplicates([col])
    return rows.withWatermark(time_col, forget).dropDuplicatesWithinWatermark([col])


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process what is there into Parquet files under batch=<id>, and stop; a batch that is repeated after a failure
    writes its own folder anew. Batches without data are off meanwhile: a stream with processing-time timeouts would run
    them without end."""
    spark, key = stream.sparkSession, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        query = (stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
                 .foreachBatch(lambda rows, number: rows.write.mode("overwrite").parquet(f"{path}/batch={number}")).start())
    finally:
        spark.conf.set(key, before)
    query.awaitTermination()
