"""Text measures are taken once, and only where they can change a result."""

from pyspark.sql import functions as F

from cuestrata.functions import text as T
from cuestrata.operators import selection


def counted(monkeypatch, module, name):
    calls, plain = [], getattr(module, name)

    def seen(df, *args, **kwargs):
        calls.append(df)
        return plain(df, *args, **kwargs)

    monkeypatch.setattr(module, name, seen)
    return calls


def test_only_shorter_recordings_are_measured(make, monkeypatch):
    rows = [(9000 + i * 3000, 11_000 + i * 3000, f"The {chr(97 + i)} is in {chr(98 + i)}.") for i in range(20)]
    cues = make([(0, 1000, "I think"), (1050, 2000, "we should go."), *rows]).unionByName(make(rows, 2))
    calls = counted(monkeypatch, selection, "semantic_health")
    out = selection.compact_if_not_worse(cues)
    assert {(r.recording_id, r.compacted) for r in out.collect()} == {(1, True), (2, False)} and out.count() == 41
    assert [{r.recording_id for r in df.collect()} for df in calls] == [{1}, {1}]


def test_scenes_of_the_old_text_are_measured_once(make, monkeypatch):
    rows = [(i * 900, i * 900 + 800, "go go go go now i'm's here") for i in range(6)]
    old = make(rows)
    retry = old.select("recording_id", "pos", F.lit("the cat is on the mat").alias("text"))
    calls = counted(monkeypatch, T, "text_features")
    out = selection.accept_better_scenes(old, retry).collect()
    assert {(r.accepted, r.text) for r in out} == {(True, "the cat is on the mat")} and len(out) == 6
    assert len(calls) == 2 and "scene_id" not in calls[0].columns


def test_report_and_its_scenes_share_the_measures(make, monkeypatch):
    from cuestrata.sources.report import report_json

    calls = counted(monkeypatch, T, "text_features")
    out = report_json(make([(0, 900, "Hello there."), (5000, 5900, "go go go go")])).orderBy("line").collect()
    assert [r.line for r in out] == [0, 1, 2] and len(calls) == 1


def test_pairs_of_names_are_the_same_directly_and_by_pieces(spark, monkeypatch):
    import random

    from cuestrata.operators import names

    pick = random.Random(5)
    rows = {(rec, pick.choice("ab") + "".join(pick.choice("abc") for _ in range(pick.randint(0, 9)))) for rec in (1, 2) for _ in range(120)}
    words = spark.createDataFrame(sorted(rows), "recording_id int, w string").cache()
    for edits in (lambda n: F.floor(n - F.ceil(n * 78 / 100)), lambda n: F.when(n > 0, 2)):
        seen = []
        for direct in (0, 10**6):
            monkeypatch.setattr(names, "DIRECT", direct)
            seen.append(sorted(map(tuple, names.near_pairs(words, ["recording_id"], "w", edits).collect())))
        assert seen[0] == seen[1] and len(seen[0]) > 50
