"""Every registered query against its DuckDB oracle at sf0.001 (the driver does the same at sf0.01)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_check import digest  # noqa: E402

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from sitelens.session import TABLES  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_matches_oracle(spark, duck, name):
    got = digest(queries()[name](spark, SF).toPandas())
    exp = digest(duck.execute(oracle_sql()[name]).fetchdf())
    assert got[:3] == exp[:3], (name, got[0], exp[0], sorted(set(got[3]) ^ set(exp[3]))[:3])


@pytest.mark.parametrize("name", ["quality_scores", "toxicity_scores"])
def test_model_queries_score_every_document(spark, name):
    # queries without oracle SQL; those of the llm subpackage have tests of their own
    assert queries()[name](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_entry(spark):
    df = entry(spark)
    rows = df.collect()
    assert 0 < len(rows) <= 10 and df.columns == ["rank", "doc_id", "url", "title", "score"]
