"""Rewrite rules leave a text alone that holds none of them, and find those without an apostrophe."""

from pyspark.sql import functions as F

from cuestrata.functions import repair as R


def test_rules_with_and_without_apostrophes(spark):
    df = spark.createDataFrame([("plain text",), ("I'm had it",), ("puttingting it",), ("I WAS asked him",), (None,), ("",)], "t string")
    once = R._replace_all(F.col("t"), [("I'm had", "I had"), ("puttingting", "putting"), ("i was asked him", "I asked him"), ("putting it", "put it's")])
    assert [r[0] for r in df.select(once).collect()] == ["plain text", "I had it", "put it's", "I asked him", None, ""]
