"""Helpers shared by the operators: narrow reads, bounded slices of Arrow batches, staged tables, range buckets."""

from __future__ import annotations

import uuid
import weakref

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.session import ensure_checkpoint_dir, read_table

#: Fixed values of the contracts: a word is a run of other characters than these (space and U+0009..U+000D).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
#: The Unicode White_Space characters, as a character class body.
WHITE_SPACE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Rows of an Arrow batch where a Python step holds tables of its own beside it.
BATCH_ROWS = 500
#: Bytes of text that a Python step holds at once, beside a longer single text.
SLICE_BYTES = 8 << 20


def documents(spark, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents")


def narrow(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty) alone, whatever other columns there are."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def slices(batches, limit: int = SLICE_BYTES, column: str = "text"):
    """Cut record batches so that the texts of one hold at most `limit` bytes, or one text."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        start = held = 0
        for i, size in enumerate(sizes):
            if i > start and held + (size or 0) > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size or 0
        if start < batch.num_rows:
            yield batch.slice(start)


def record_batch(schema: pa.Schema, columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: The folder of each table that `stage` wrote, while the table is in use.
_STAGED: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def stage(df: DataFrame, name: str, batch_rows: int | None = None, **options) -> DataFrame:
    """Write `df` once as Parquet into the shared checkpoint folder and read it back: lineage ends there and a lost
    executor costs no recomputation. The shuffle files behind it go when it is written. batch_rows: rows of an Arrow
    batch to Python meanwhile."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in (_BATCH, _CLEANUP)}
    spark.conf.set(_BATCH, str(batch_rows or before[_BATCH]))
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").options(**options).parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    written = spark.read.schema(df.schema).parquet(path)
    _STAGED[written] = path
    return written


def unstage(*tables: DataFrame) -> None:
    """Remove tables that `stage` wrote and nothing reads any more; others stay."""
    for table in tables:
        path = _STAGED.pop(table, None)
        if path is not None:
            spark = table.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(where, True)


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def range_bounds(df: DataFrame, column: str, n: int) -> list:
    """At most n - 1 rising values that cut `column` into n ranges of about equal rows (one narrow aggregate; the
    driver gets n - 1 numbers, however large the data)."""
    if n < 2:
        return []
    got = df.agg(F.percentile_approx(column, [i / n for i in range(1, n)], 20 * n).alias("b")).first()["b"]
    return sorted({x for x in got or [] if x is not None})


def range_bucket(column: Column, bounds: list) -> Column:
    """How many of the sorted bounds are below `column` (binary search in the JVM; null: 0)."""
    if not bounds:
        return F.lit(0)
    table = F.array(*[F.lit(b) for b in bounds])
    step = lambda s, _: F.when(
        s["lo"] >= s["hi"], s
    ).when(
        F.get(table, F.shiftright(s["lo"] + s["hi"], 1)) < column,
        F.struct((F.shiftright(s["lo"] + s["hi"], 1) + 1).alias("lo"), s["hi"].alias("hi")),
    ).otherwise(F.struct(s["lo"].alias("lo"), F.shiftright(s["lo"] + s["hi"], 1).alias("hi")))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    rounds = F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1))
    return F.aggregate(rounds, start, step, lambda s: s["lo"])


def ranked(rows: DataFrame, part: str, group: str, order: list, name: str) -> DataFrame:
    """`rows` (a staged table) with 0, 1, ... inside each value of `group`, counted by partition column `part` first, so
    that a group of any size is numbered in pieces of one partition each."""
    before = F.sum("n").over(Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    offsets = rows.groupBy(part, group).agg(F.count("*").alias("n")).select(
        part, group, F.coalesce(before, F.lit(0)).alias("__before")
    )
    inside = F.row_number().over(Window.partitionBy(part, group).orderBy(*order)) - 1
    numbered = rows.withColumn("__inside", inside).join(offsets, [part, group])
    return numbered.withColumn(name, F.col("__before") + F.col("__inside")).drop("__before", "__inside")
