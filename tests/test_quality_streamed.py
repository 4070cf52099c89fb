"""Translation quality streams recordings; large ones, by blocks, give the same."""

from cuestrata.functions import text as T
from cuestrata.operators import ordered, quality


def test_texts_are_cut_into_words_once_and_blocks_agree(make, monkeypatch):
    odd = [None, "", "Oh. Oh!", "oh oh", "Oh. Oh!", "Oh. Oh!", "Kelvin İ'm's what what's the matter", "a b a b", "go go go go go go go go", "É ÀB 'x' don''t"]
    lines = [(i, i + 1, odd[(i * i) % 10]) for i in range(40)]
    cues = make(lines).unionByName(make([(0, 1, None)], 2)).unionByName(make([(i, i + 1, "what") for i in range(30)], 3))
    calls, plain = [], T.lower_tokens
    monkeypatch.setattr(T, "lower_tokens", lambda c: calls.append(c) or plain(c))

    def run():
        return sorted((r[0], round(r[1], 9)) for r in quality.translation_quality(cues, min_tokens=5, min_cues=3).collect())

    whole = run()
    assert [r[0] for r in whole] == [1, 2, 3] and not calls
    assert whole[1][1] == 1.0 and whole[2][1] == 0.0
    monkeypatch.setattr(ordered, "WHOLE_ROWS", 0)
    assert run() == whole
