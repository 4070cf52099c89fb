"""What ``process`` and the tables staged on its way leave on disk."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuestrata.operators import process as pr
from cuestrata.session import settled, shared_dir, stage


def folders(spark) -> set:
    return {p for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if p.is_dir()}


@pytest.mark.parametrize("profile, kept", [("balanced", ["clean", "report", "verdict"]), ("strict", ["final", "report", "verdict"])])
def test_only_results_stay(spark, make, profile, kept):
    cues = make([(i * 2000, i * 2000 + 1500, f"Anna said line {i} to Annas friend") for i in range(6)])
    before = folders(spark)
    done, report = pr.process(cues, lambda texts, *_: [t + " ." for t in texts], profile)
    assert sorted(p.name.rsplit("-", 1)[0] for p in folders(spark) - before) == kept
    assert done.count() == 6 and report.count() == 1 and done.where(F.col("status") == "passed").count() in (0, 6)


def test_settled_deletes_what_was_staged_inside(spark):
    before = folders(spark)
    rows = settled(lambda: stage(spark.range(5), "inner").join(settled(lambda: stage(spark.range(3), "deep"), "outer"), "id"), "all")
    assert rows.count() == 3
    assert [p.name.rsplit("-", 1)[0] for p in folders(spark) - before] == ["all"]


def test_staging_leaves_no_shuffle_files(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        blocks = manager.getAllBlocks()
        return {n for n in (blocks.apply(i).name() for i in range(blocks.size())) if n.startswith("shuffle_")}

    before = shuffles()
    assert stage(spark.range(1000).repartition(7).groupBy((F.col("id") % 5).alias("k")).count(), "counts").count() == 5
    # the count itself may leave one small shuffle, the staging none
    made = {n.split("_")[1] for n in shuffles() - before}
    assert len(made) <= 1
