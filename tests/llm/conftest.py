import random

import pytest
from pyspark.sql import functions as F

#: Columns that operators use themselves, or might.
CLASHING = (
    "ids part shard slot fp fingerprint kept spans anchor whole runs class chunk words counts length piece offset key "
    "candidates base email n_bytes component_id sequence_id size start"
).split()

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rnd, n, vocabulary):
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and very long texts, ties, repeated rows."""
    rnd = random.Random(11)
    vocabulary = ["".join(rnd.choice("abcdeéß") for _ in range(rnd.randrange(1, 9))) for _ in range(300)]
    long = prose(rnd, 30_000, vocabulary)
    texts = [prose(rnd, rnd.randrange(1, 200), vocabulary) for _ in range(20)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    rows += [(30, None, "en", "s", 0), (31, "", None, None, None), (32, " \n\t \x0b ", "en", "s", 5), (33, long, "en", "s", 1)]
    rows += [(None, texts[0], "en", "s", 1), (None, None, None, None, None), rows[3], rows[3], (34, texts[3], "de", "t", 2)]
    rows += [(35, "a" * 30_000, "en", "s", 3), (36, "x\x00y \x1c z <|endoftext|> 😀 don't", "en", "s", 4)]
    return rows


@pytest.fixture()
def odd(spark, odd_rows):
    df = spark.createDataFrame(odd_rows, SCHEMA)
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in df.columns})


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
