"""Documents to packed training sequences: quality rules, SimHash near-dedup, repeated passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents. `run` writes every stage's rows into the shared folder and reads them again for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from llm.common import documents, stage
from llm.packing import pack, token_pieces
from llm.pii import mask_private
from llm.quality import filter_quality
from llm.simhash import keep_first
from llm.suffix_dedup import remove_repeats


#: Rows that go to a Python step at once: workers and executors hold few texts of any stage.
BATCH_ROWS = 500
#: Distinct units that a worker remembers while it tokenizes, beside what the stages before have left in memory.
REMEMBERED = 400_000


def _settings(spark) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _counted(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def quality(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression bands or the base rules reject go."""
    _settings(spark)
    return filter_quality(docs)


def near_dedup(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays."""
    _settings(spark)
    return keep_first(docs)


def repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by repeated strings go from the texts; every document stays."""
    _settings(spark)
    return _counted(remove_repeats(docs)).select(*docs.columns)


def private(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    _settings(spark)
    return _counted(mask_private(docs)).select(*docs.columns)


def packing(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, placed in sequences: the rows of op7 for what is left."""
    import public_tokenizers

    _settings(spark)
    found = pack(token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), remembered=REMEMBERED))
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality),
    ("SimHash near-dedup", near_dedup),
    ("suffix-array dedup", repeats),
    ("PII", private),
    ("best-fit packing", packing),
]

#: The stages use hashes, compression and tokenizers that SQL lacks; tests hold them against a brute-force version.
ORACLE_SQL = None


def run(spark, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir)
    for name, function in STAGES[:-1]:
        rows = stage(function(spark, rows, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, rows, sf_dir)
