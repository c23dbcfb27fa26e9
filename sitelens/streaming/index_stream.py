"""Incremental index maintenance with Structured Streaming.

Crawl rows arrive as files; each micro-batch is merged into the stored index (:mod:`sitelens.sources.segments`): only the
buckets of its URLs are rewritten, and a manifest, written last, names the files of the new version. Readers see whole
versions, and a batch that is replayed after a failure finds its number in the manifest and changes nothing: the sink is
idempotent by batch id. The stream's own progress lives in the checkpoint location.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.schemas import DOCUMENTS, POSTINGS
from sitelens.sources import segments


def finished_versions(spark: SparkSession, index_path: str) -> list[int]:
    """The versions that readers may still use, oldest first."""
    return segments.versions(spark, index_path)


def read_latest_index(spark: SparkSession, index_path: str) -> tuple[DataFrame, DataFrame]:
    """Documents and (term, doc_id) postings of the newest version."""
    if not segments.versions(spark, index_path):
        return spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], POSTINGS)
    index = segments.Index(spark, index_path)
    return index.documents, index.postings


def _batch_writer(index_path: str, buckets: int):
    def write(batch: DataFrame, batch_id: int) -> None:
        segments.merge(batch.sparkSession, index_path, batch, batch_id, buckets)
    return write


def stream_index(source: DataFrame, index_path: str, checkpoint: str, available_now: bool = True, buckets: int = 64):
    """Run the incremental index over a streaming DataFrame with url, title
    (and optionally snippet, content, type, date, seq). Returns the query."""
    writer = source.writeStream.foreachBatch(_batch_writer(index_path, buckets)).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def crawl_file_stream(spark: SparkSession, directory: str, schema: T.StructType, fmt: str = "json",
                      glob: str | None = None) -> DataFrame:
    """Streaming source over a directory of crawl files with a fixed schema."""
    r = spark.readStream.schema(schema).format(fmt)
    if fmt == "json":
        r = r.option("multiLine", True)
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(directory)


def pages_as_index_rows(stream: DataFrame) -> DataFrame:
    """Index input rows from a stream of raw pages (url, html; page_id, when there, orders the rows of a URL)."""
    from sitelens.functions.html import page_title, visible_text
    order = [F.col("page_id").alias("seq")] if "page_id" in stream.columns else []
    return stream.select("url", page_title("html").alias("title"), visible_text("html").alias("content"), *order)

