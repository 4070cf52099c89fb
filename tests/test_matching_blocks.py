"""The matching-block ratio against difflib, and the whole-text measure of ``evaluate``."""

import random
from difflib import SequenceMatcher

import pytest

from cuestrata.functions.blocks import block_ratio
from cuestrata.operators import evaluate as ev

ALPHABETS = ["ab", "etaoin shrdlucmfwypvbgkjqxz0123456789", "".join(map(chr, range(0x4E00, 0x4E00 + 300)))]


@pytest.mark.parametrize("letters", ALPHABETS)
@pytest.mark.parametrize("most", [30, 190, 900])
def test_equals_difflib(letters, most):
    rng = random.Random(most)
    weights = [1 / (i + 1) ** 1.3 for i in range(len(letters))]
    text = lambda n: "".join(rng.choices(letters, weights, k=n))
    for _ in range(60):
        a = text(rng.randrange(most))
        cut = [a[i:i + rng.randrange(5, 60)] for i in range(0, len(a), 40)]
        b = "".join(p if rng.random() < 0.8 else text(rng.randrange(50)) for p in cut if rng.random() < 0.85)
        for x, y in ((a, b), (b, a), (a, text(rng.randrange(most)))):
            assert block_ratio(x, y) == SequenceMatcher(None, x, y).ratio()


def test_whole_texts_are_compared(make):
    lines = [f"Line {i} of a text that goes on; {chr(97 + i % 26)}{i * 37 % 101}." for i in range(40)]
    ref = [(i * 1000, i * 1000 + 900, t) for i, t in enumerate(lines) if i % 4 != 1]
    hyp = [(i * 1000, i * 1000 + 900, t.upper() if i % 3 else None) for i, t in enumerate(lines)]
    refs = make(ref).unionByName(make([(0, 500, "only there")], 2))
    hyps = make(hyp).unionByName(make([(0, 500, "only here")], 3))
    got = {r.recording_id: r for r in ev.evaluate(refs, hyps).collect()}
    joined = [" ".join(t or "" for _, _, t in side).lower() for side in (ref, hyp)]
    assert got[1].reference_char_similarity == pytest.approx(SequenceMatcher(None, *joined).ratio(), abs=1e-12)
    assert got[2].reference_char_similarity == got[3].reference_char_similarity == 0.0


def test_lines_are_compared_by_blocks(make):
    a, b = "abcd xyz", "xyz abcd"
    row = ev.evaluate(make([(0, 900, a)]), make([(0, 900, b)])).first()
    assert row.line_char_similarity == pytest.approx(SequenceMatcher(None, a, b).ratio())
