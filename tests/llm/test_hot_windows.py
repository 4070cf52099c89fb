"""Hot windows: one row a string and window, and a join that can split a window of very many strings."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from cuestrata.llm import suffixes, windows
from cuestrata.llm.windows import Unit, hot_spans, keyed_texts, light_runs, packed, repeated_runs
from tests.llm.test_llm import masked, prose

BYTES = Unit(False, 400, 192)


def looped() -> list[tuple[int, str]]:
    """A loop of nine bytes of many lengths, and a passage that many documents hold between words of their own."""
    rng = random.Random(11)
    passage = prose(rng, 120)
    return [(i, "ab cd ef " * (60 + i)) for i in range(12)] + [(100 + i, f"{prose(rng, 12)} {passage} {prose(rng, 12)}") for i in range(40)]


def test_a_loop_has_one_row_for_each_of_its_windows(spark, monkeypatch):
    monkeypatch.setattr(windows, "HOT_ROWS", 1)
    staged = {}
    real = windows.stage
    monkeypatch.setattr(windows, "stage", lambda df, name: staged.setdefault(name, real(df, name)))
    monkeypatch.setattr(windows, "forget", lambda *frames: None)
    docs = spark.createDataFrame(looped(), "doc_id long, text string")
    got = Counter(tuple(r) for r in suffixes.dedup_bytes(docs).select("doc_id", "n_bytes", "n_removed").collect())
    raw = [(i, t.encode()) for i, t in looped()]
    times = Counter(t[k : k + 400] for _, t in raw for k in range(len(t) - 399))
    assert got == Counter((i, len(t), sum(masked(t, 400, lambda x: times[x] > 1))) for i, t in raw)
    rows = staged["windows"]
    most = rows.groupBy("w1", "w2").agg(F.count("*").alias("rows"), F.count_distinct("digest").alias("strings"))
    assert most.where("rows > strings").count() == 0
    assert rows.where(F.size("places") > 1).count() > 0


def skewed(df, key: str) -> bool:
    """Whether the join by ``key`` of a plan that has run was split."""
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    return "skew=true" in "".join(x for x in plan.splitlines() if "SortMergeJoin" in x and key in x)


def test_common_windows_and_copies_are_split(spark, monkeypatch):
    monkeypatch.setattr(windows, "HOT_ROWS", 1)
    rng = random.Random(5)
    passage = prose(rng, 120)
    copy = f"{prose(rng, 12)} {passage} {prose(rng, 12)}"
    rows = [(i, f"{prose(rng, 12)} {passage} {prose(rng, 12)}") for i in range(400)] + [(400 + i, copy) for i in range(2000)]
    few = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "0.5", "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k", "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    split = []
    real = windows.stage

    def spy(df, name):
        if name == "marks":
            df.collect()
            split.append(skewed(df, "w1"))
        return real(df, name)

    monkeypatch.setattr(windows, "stage", spy)
    before = {k: spark.conf.get(k, None) for k in few}
    try:
        for k, v in few.items():
            spark.conf.set(k, v)
        texts = keyed_texts(spark.createDataFrame(rows, "doc_id long, text string").repartition(8))
        runs = repeated_runs(light_runs(texts, BYTES), False).where("hot")
        spans = hot_spans(packed(texts, runs, BYTES), BYTES, False).groupBy("id").agg(F.count("*"))
        assert len(spans.collect()) == 2400
        assert split == [True] and skewed(spans, "digest")
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
