"""Sources and sinks.

Readers always pass an explicit schema. Writers partition by the columns
later queries filter on (``crawler_type``, ``domain``) so those filters prune
directories instead of scanning.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.plans.ids import dense_ids
from sitelens.schemas import CRAWL_RESULT, CRAWL_STATS, DOCUMENTS, EXPORT_FIELDS, POSTINGS

SITEMAP_NS = "http://www.sitemaps.org/schemas/sitemap/0.9"


# ----------------------------------------------------------------------------- sources

CORRUPT = "_corrupt_record"


def _json_files(spark: SparkSession, path: str, schema: T.StructType, glob: str, tree: bool) -> DataFrame:
    """One row for each JSON object; what cannot be parsed keeps its text in ``_corrupt_record``."""
    kept = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    return (spark.read.schema(kept).option("multiLine", True).option("pathGlobFilter", glob)
            .option("recursiveFileLookup", tree).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
            .json(path).withColumn("source_file", F.col("_metadata.file_name")))


def _with_a_field(condition: Column, schema: T.StructType) -> Column:
    """The condition beside an always true one on a field: Spark's readers refuse to fill the corrupt record column when
    a query (say, a count) needs no other column of the file."""
    return condition & (F.length(F.concat_ws("", F.col(schema.fields[0].name).cast("string"))) >= 0)


def _glob(data_type: str | None) -> str:
    return f"{data_type}_*.json" if data_type else "*.json"


def read_crawl_results(spark: SparkSession, path: str, data_type: str | None = None,
                       schema: T.StructType = CRAWL_RESULT, tree: bool = False) -> DataFrame:
    """A1: every ``*.json`` under ``path`` (a file holds one object or a list
    of them); ``data_type`` keeps files named ``<type>_*.json``. Adds
    ``source_file`` and ``file_type`` (the name prefix). Records that cannot
    be parsed are not here but in :func:`read_quarantine`."""
    df = _json_files(spark, path, schema, _glob(data_type), tree)
    return df.where(_with_a_field(F.col(CORRUPT).isNull(), schema)).drop(CORRUPT).withColumn(
        "file_type", F.regexp_extract("source_file", r"^([^_]+)_", 1))


def read_quarantine(spark: SparkSession, path: str, data_type: str | None = None,
                    schema: T.StructType = CRAWL_RESULT, tree: bool = False) -> DataFrame:
    """A1/A2: (source_file, record) of what the readers could not parse."""
    df = _json_files(spark, path, schema, _glob(data_type), tree)
    return df.where(_with_a_field(F.col(CORRUPT).isNotNull(), schema)).select("source_file", F.col(CORRUPT).alias("record"))


def read_json_tree(spark: SparkSession, root: str, schema: T.StructType = CRAWL_RESULT) -> DataFrame:
    """A2: all JSON under a directory tree; unparsable records go to
    ``read_quarantine(..., tree=True)``."""
    return read_crawl_results(spark, root, schema=schema, tree=True).drop("source_file", "file_type")


def read_store(spark: SparkSession, root: str, data_type: str | None = None) -> DataFrame:
    """A3: the per-type store (Parquet partitioned by crawler_type); with no
    type every partition except ``stats`` (a null type is kept); the internal ``_id`` is dropped."""
    df = spark.read.parquet(root)
    df = df.where(F.col("crawler_type") == data_type) if data_type else df.where(~F.col("crawler_type").eqNullSafe("stats"))
    return df.drop("_id")


def read_domain_lists(spark: SparkSession, new_dir: str, phishing_path: str | None = None) -> DataFrame:
    """A4: one domain per line. New-registration lists are ``<date>.txt`` files
    (the date comes from the file name); the phishing list has no date.
    -> (domain, list_date, type); blank lines are dropped."""
    new = (spark.read.option("pathGlobFilter", "*.txt").text(new_dir)
           .select(F.regexp_replace("value", r"^\s+|\s+$", "").alias("domain"),
                   F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.txt$", 1).alias("list_date"),
                   F.lit("new_registration").alias("type")))
    out = new
    if phishing_path and path_exists(spark, phishing_path):
        ph = spark.read.text(phishing_path).select(
            F.regexp_replace("value", r"^\s+|\s+$", "").alias("domain"),
            F.lit(None).cast("string").alias("list_date"), F.lit("phishing").alias("type"))
        out = out.unionByName(ph)
    return out.where(F.length("domain") > 0)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether the path is there, asked of its own Hadoop file system (not of the driver's disk)."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(conf).exists(p)


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """A5: (documents, postings) of a saved index; empty tables when missing."""
    docs_p, post_p = os.path.join(path, "documents"), os.path.join(path, "postings")
    if not path_exists(spark, docs_p):
        return spark.createDataFrame([], DOCUMENTS), spark.createDataFrame([], POSTINGS)
    return spark.read.schema(DOCUMENTS).parquet(docs_p), spark.read.schema(POSTINGS).parquet(post_p)


def page_records(pages: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Page rows as crawl records: status_code, content_type, crawl_time
    and depth from the table when present, else from ``defaults``; size is
    the UTF-8 length of the html."""
    d = {"status_code": 200, "content_type": "text/html", "crawl_time": None, "depth": 0}
    d.update(defaults or {})
    out = pages
    for c, v in d.items():
        lit = F.lit(v)
        out = out.withColumn(c, F.coalesce(F.col(c), lit) if c in pages.columns else lit)
    return out.withColumn("size", F.octet_length("html").cast("long"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """Stored image files: bytes length, md5, and decoded dimensions
    (Spark's image source; undecodable files keep their row with an error)."""
    # both sources expose the same file path in _metadata (their own path columns differ in URI form)
    raw = spark.read.format("binaryFile").load(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("length").alias("size_bytes"), F.md5("content").alias("hash"))
    img = (spark.read.format("image").option("dropInvalid", False).load(path)
           .select(F.col("_metadata.file_path").alias("path"), F.col("image.width").alias("px_width"),
                   F.col("image.height").alias("px_height"), F.col("image.nChannels").alias("channels")))
    out = raw.join(img, "path", "left")
    bad = F.col("px_width").isNull() | (F.col("px_width") < 0)
    return (out.withColumn("analysis_error", F.when(bad, F.lit("cannot decode image")))
            .withColumn("px_width", F.when(~bad, F.col("px_width")))
            .withColumn("px_height", F.when(~bad, F.col("px_height"))))


def read_image_sizes(spark: SparkSession, path: str) -> DataFrame:
    """The same from the files' header bytes, each file read once and nothing joined: size, md5, format, sides."""
    from sitelens.functions.images import image_size

    raw = spark.read.format("binaryFile").load(path)
    rows = raw.select(F.col("_metadata.file_path").alias("path"), F.col("length").alias("size_bytes"),
                      F.md5("content").alias("hash"), image_size("content").alias("_i"))
    return rows.select("path", "size_bytes", "hash", F.col("_i.format").alias("format"), F.col("_i.width").alias("px_width"),
                       F.col("_i.height").alias("px_height"), F.col("_i.error").alias("analysis_error"))


# ----------------------------------------------------------------------------- sinks

def write_crawl_results(df: DataFrame, root: str, batch_ts: int, fmt: str = "json") -> bool:
    """B1: append a batch under crawler_type=/batch_ts= partitions; empty input writes nothing."""
    if df.isEmpty():
        return False
    (df.withColumn("batch_ts", F.lit(int(batch_ts))).write.mode("append")
     .partitionBy("crawler_type", "batch_ts").format(fmt).save(root))
    return True


def append_store(df: DataFrame, root: str, ts: str) -> None:
    """B2: append to the per-type store with an ingest ``timestamp``."""
    df.withColumn("timestamp", F.lit(ts)).write.mode("append").partitionBy("crawler_type").parquet(root)


def write_stats(stats: DataFrame, root: str) -> None:
    """Append run statistics (one JSON line per run)."""
    cols = [F.col(f.name).cast(f.dataType) if f.name in stats.columns else F.lit(None).cast(f.dataType).alias(f.name)
            for f in CRAWL_STATS.fields]
    stats.select(*cols).coalesce(1).write.mode("append").json(root)


def export_json(df: DataFrame, path: str, grouped: bool = False) -> None:
    """Export by crawler type. Default: JSON lines partitioned by type.
    ``grouped=True`` writes one ``{type: [records], ...}`` document as text
    part files whose concatenation in name order is the document: records are
    numbered in their type with distributed ids and written in that order, so
    no task or row holds a whole type."""
    if not grouped:
        df.write.mode("overwrite").partitionBy("crawler_type").json(path)
        return
    rows = df.select(F.coalesce("crawler_type", F.lit("unknown")).alias("type"),
                     F.to_json(F.struct(*[F.col(c) for c in df.columns if c != "crawler_type"])).alias("record"))
    numbered = dense_ids(rows, "record", "n", group_by="type")
    sizes = numbered.groupBy("type").agg(F.max("n").alias("last"))  # one row for each type
    types = [r["type"] for r in sizes.orderBy("type").collect()]
    if not types:
        df.sparkSession.createDataFrame([("{}",)], "value string").write.mode("overwrite").text(path)
        return
    name = F.to_json(F.array("type"))
    quoted = F.substring(name, F.lit(2), F.length(name) - 2)
    head = F.when(F.col("n") > 0, F.lit(",")).otherwise(
        F.concat(F.when(F.col("type") == types[0], F.lit("{")).otherwise(F.lit(",")), quoted, F.lit(":[")))
    tail = F.when(F.col("n") < F.col("last"), F.lit("")).otherwise(
        F.when(F.col("type") == types[-1], F.lit("]}")).otherwise(F.lit("]")))
    ordered = numbered.join(F.broadcast(sizes), "type").repartitionByRange("type", "n").sortWithinPartitions("type", "n")
    ordered.select(F.concat(head, "record", tail).alias("value")).write.mode("overwrite").text(path)


def _flat(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def export_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; nested columns as JSON text."""
    _flat(df).write.mode("overwrite").option("header", True).csv(path)


def export_xml(df: DataFrame, path: str, root_tag: str = "results", row_tag: str = "result") -> None:
    """XML via Spark's XML writer."""
    df.write.mode("overwrite").format("xml").option("rootTag", root_tag).option("rowTag", row_tag).save(path)


def project_export(df: DataFrame, cols=None) -> DataFrame:
    """The configured export columns, missing ones as nulls."""
    cols = EXPORT_FIELDS if cols is None else cols
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in cols])


def write_index(docs: DataFrame, postings: DataFrame, path: str) -> None:
    """Documents and postings as Parquet; postings range-partitioned and
    sorted by (term, doc_id), so a term lookup reads few row groups and a very
    frequent term spreads over several files."""
    docs.write.mode("overwrite").parquet(os.path.join(path, "documents"))
    (postings.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")
     .write.mode("overwrite").parquet(os.path.join(path, "postings")))


def write_sitemaps(rows: DataFrame, root: str) -> None:
    """One urlset XML per domain (and shard, when present)."""
    parts = ["domain"] + (["shard"] if "shard" in rows.columns else [])
    # one task, hence one file, for each sitemap (at most 50,000 URLs by the protocol)
    (rows.repartition(*parts).select(*parts, "loc", "lastmod", "changefreq", F.col("priority").cast("string").alias("priority"))
     .write.mode("overwrite").partitionBy(*parts).format("xml")
     .option("rootTag", f'urlset xmlns="{SITEMAP_NS}"').option("rowTag", "url").save(root))


def write_domain_dataset(df: DataFrame, path: str) -> None:
    """The labelled domain dataset (domain, source, date, type) as Parquet."""
    df.select("domain", "source", "date", "type").write.mode("overwrite").parquet(path)

