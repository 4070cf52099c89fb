"""The plan of compaction over whole recordings: one order, and no text carried along."""

from cuestrata.operators import folds


def test_one_sort_and_narrow_state(make):
    cues = make([(i * 1000, i * 1000 + 950, t) for i, t in enumerate(["so we", "go on", "[x] y", "Then", "it ends.", "a b", "", "c d"])])
    out = folds.compact_cues(cues)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "DESC" not in plan and "MapInPandas" not in plan
    got = {r.pos: (r.text, r.merges) for r in out.collect()}
    assert got == {0: ("so we go on", 1), 2: ("[x] y", 0), 3: ("Then it ends.", 1), 5: ("a b", 0), 7: ("c d", 0)}
