"""Bucket files: byte ranges of the manifest, batches that replace, few files, a failed batch."""

from __future__ import annotations

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from cuestrata.sources import asr, srt
from cuestrata.sources.text_store import TextStore

SCHEMA = "recording_id string, pos int, start_ms long, end_ms long, text string"


def cues(spark, names, tag, n=3):
    return spark.createDataFrame([(r, i, i * 1000, i * 1000 + 900, f"{tag} é {r}\nline {i}") for r in names for i in range(n)], SCHEMA).repartition(4)


def want(r, tag, n=3):
    return "".join(f"{i + 1}\n00:00:0{i},000 --> 00:00:0{i},900\n{tag} é {r}\nline {i}\n\n" for i in range(n))


def cut(root, row) -> str:
    files = sorted(Path(f"{root}/{row.folder}/text/bucket={row.bucket}").glob("part-*"))
    return b"".join(f.read_bytes() for f in files)[row.start : row.start + row.bytes].decode()


def test_ranges_hold_each_recording(spark, tmp_path):
    store = TextStore(spark, str(tmp_path / "store"), buckets=4)
    assert store.read() is None and srt.stored_srt(store) is None
    names = [f"rec {i}" for i in range(40)]
    assert srt.store_srt(cues(spark, names, "old"), store, "a")
    assert srt.store_srt(cues(spark, names[:5] + ["new one"], "new"), store, "b")
    assert not srt.store_srt(cues(spark, names, "other"), store, "a")
    texts = {r.recording_id: cut(tmp_path / "store", r) for r in store.manifest().collect()}
    assert texts == {r: want(r, "new" if r in names[:5] or r == "new one" else "old") for r in [*names, "new one"]}
    back = {(r.recording_id, r.pos): r.text for r in srt.stored_srt(store).collect()}
    assert back == {(r, i): f"{'new' if r in names[:5] or r == 'new one' else 'old'} é {r}\nline {i}" for r in texts for i in range(3)}
    files = list(Path(tmp_path / "store").rglob("part-*.txt"))
    assert len(files) <= 2 * (4 + int(spark.conf.get("spark.sql.shuffle.partitions")))  # buckets and tasks of two batches


def test_bucket_of_several_files(spark, tmp_path, monkeypatch, request):
    """A bucket that spans tasks is read in the order of its files."""
    store = TextStore(spark, str(tmp_path / "store"), buckets=1)
    monkeypatch.setattr("cuestrata.sources.text_store.PIECE", 100)
    name = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(name, "false")
    request.addfinalizer(lambda: spark.conf.set(name, "true"))
    srt.store_srt(cues(spark, [f"r{i:03d}" for i in range(200)], "x", 5), store, "a")
    assert len(list(Path(tmp_path / "store").rglob("part-*.txt"))) > 1
    back = srt.stored_srt(store)
    assert back.count() == 1000 and back.where(~F.col("text").contains(F.col("recording_id"))).count() == 0


def test_failed_batch_stays_unseen(spark, tmp_path):
    store = TextStore(spark, str(tmp_path / "store"), buckets=2)
    srt.store_srt(cues(spark, ["a"], "x"), store, "1")
    with pytest.raises(Exception, match="lost"):
        srt.store_srt(cues(spark, ["a"], "y").withColumn("text", F.raise_error(F.lit("lost")).cast("string")), store, "2")
    assert [r.text for r in srt.stored_srt(store).orderBy("pos").collect()] == [f"x é a\nline {i}" for i in range(3)]


def test_segments_go_to_a_store(spark, tmp_path):
    store = TextStore(spark, str(tmp_path / "store"), buckets=2)
    merged = spark.createDataFrame([("a", 0, 500, 900, -0.1, 0.2, 1.0), ("a", 0, 0, 400, -0.5, 0.1, 1.5), ("b", 1, 7, 9, -0.5, 0.1, 1.5)], "recording_id string, chunk_index int, start_ms long, end_ms long, avg_logprob double, no_speech_prob double, compression_ratio double")
    assert asr.store_segments(merged, store, "1")
    lines = [r.line for r in store.read().where("recording_id = 'a'").orderBy("at").collect()]
    assert [line.split(",")[0] for line in lines] == ['{"start":0.0', '{"start":0.5']
