"""Subtitle texts of recordings beyond a hundred minutes."""

import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

import __spark_entry__ as entry  # noqa: E402
from check import compare  # noqa: E402
from cuestrata.plans.views import SCHEMAS  # noqa: E402


@pytest.mark.parametrize("name", ["read_srt", "read_srt_lenient"])
def test_long_texts_equal_sql(spark, tmp_path, name):
    docs = [(1, "\n".join(f"line {i}" for i in range(3010)), "en", "a", 1), (2, "only one", "en", "a", 1)]
    spark.createDataFrame(docs, SCHEMAS["documents"]).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    err, n = compare(entry.queries()[name](spark, str(tmp_path)), con, entry.oracle_sql()[name])
    assert not err and n > 2000
