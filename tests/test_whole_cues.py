"""Queries over whole cue texts, against plain versions of them."""

import difflib
from collections import defaultdict
from pathlib import Path

import pytest

import __spark_entry__ as entry
from cuestrata.operators import evaluate as ev
from cuestrata.plans import views as v

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="driver tables not present")


@pytest.fixture(scope="module")
def neighbours(spark):
    """(recording_id, pos): texts of a cue and the next one, of a few recordings."""
    text = {(r.recording_id, r.pos): r.text for r in v.cues(spark, SF).select("recording_id", "pos", "text").collect()}
    few = sorted({rec for rec, _ in text})[:5]
    pairs = {k: (t, text[k[0], k[1] + 1]) for k, t in text.items() if k[0] in few and (k[0], k[1] + 1) in text}
    assert any(len(a) > 40 and len(b) > 40 for a, b in pairs.values())
    return pairs


def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
        last = row
    return last[-1]


def test_can_merge_whole(spark, neighbours):
    got = {(r.recording_id, r.pos): r for r in entry.queries()["can_merge_whole"](spark, SF).collect()}
    for k, (a, b) in neighbours.items():
        left, right = a.strip(), b.strip()
        blocked = any(c in a + b for c in "[]") or max(len(left.split()), len(right.split())) > 8 or "A" <= right[:1] <= "Z" or left[-1:] in tuple(".?!:")
        assert got[k].can_merge == (left != "" and right != "" and not blocked)
        assert got[k].merged == (a.rstrip() + " " + b.lstrip() if left and right else left or right)


def test_similarity_whole(spark, neighbours):
    got = {(r.recording_id, r.pos): r.similarity for r in entry.queries()["similarity_whole"](spark, SF).collect()}
    for k, (a, b) in neighbours.items():
        assert got[k] == pytest.approx(1 - distance(a, b) / max(len(a), len(b), 1), abs=2e-6)


def test_evaluate_whole(spark):
    got = {r.recording_id: r.asDict() for r in entry.queries()["evaluate_whole"](spark, SF).collect()}
    less = {r.recording_id: r.asDict() for r in entry.queries()["evaluate"](spark, SF).collect()}
    sums = defaultdict(lambda: [0.0, 0.0])
    for r in ev.aligned_texts(v.ref_cues(spark, SF), v.hyp_cues(spark, SF)).collect():
        a, b = r.ref_text.lower(), r.hyp_text.lower()
        sums[r.recording_id][0] += r.weight * (1.0 if a == b else difflib.SequenceMatcher(None, a, b).ratio())
        sums[r.recording_id][1] += r.weight
    assert got.keys() == less.keys() and sums
    for k, row in got.items():
        alike, weight = sums[k]
        assert row.pop("line_char_similarity") == pytest.approx(alike / max(0.001, weight), abs=2e-6)
        # by edits there, which SQL checks; the other metrics are the same
        assert 0 <= less[k].pop("line_char_similarity") <= 1 and row == less[k]
