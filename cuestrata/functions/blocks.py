"""The matching-block ratio of two texts: ``difflib.SequenceMatcher(None, a, b).ratio()``, in about linear time."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from difflib import SequenceMatcher

#: Letters of the second text from which difflib passes over frequent ones.
LONG = 200


def _places(text: str, kept: set) -> tuple[list[int], list[int]]:
    """Places of the kept letters, and how many kept letters follow each other from there."""
    at = [m.start() for m in re.finditer("[" + re.escape("".join(kept)) + "]", text)] if kept else []
    run, n = [1] * len(at), len(at)
    for i in range(n - 2, -1, -1):
        if at[i + 1] == at[i] + 1:
            run[i] = run[i + 1] + 1
    return at, run


def _alike_from(a: str, i: int, ahi: int, b: str, j: int, bhi: int) -> int:
    """Length of the common beginning of a[i:ahi] and b[j:bhi]."""
    most, n, step = min(ahi - i, bhi - j), 0, 16
    while n < most:
        step = min(step, most - n)
        if a[i + n:i + n + step] == b[j + n:j + n + step]:
            n, step = n + step, step * 2
        elif step == 1:
            break
        else:
            most, step = n + step, step // 2
    return n


def _grams(text: str, at: list[int], run: list[int], low: int, high: int, k: int) -> list[tuple[int, str]]:
    """Runs of ``k`` kept letters in text[low:high], with their places."""
    return [(at[p], text[at[p]:at[p] + k]) for p in range(bisect_left(at, low), bisect_left(at, high - k + 1)) if run[p] >= k]


def block_ratio(a: str, b: str) -> float:
    """Share of both texts that lies in matching blocks.

    difflib takes the longest run of equal letters, the first in ``a`` and then in ``b`` of several, and goes on
    to its left and right.  In texts of 200 letters and more, those that make up over one percent of ``b`` only
    extend a run.  Runs of one length are found here in one go along ``a``: to the left of the first there is none of
    that length, and to its right the next one comes next.
    """
    total = len(a) + len(b)
    if not total or a == b:
        return 1.0
    if len(b) < LONG and len(a) < 4 * LONG:
        return SequenceMatcher(None, a, b).ratio()
    most = len(b) // 100 + 1 if len(b) >= LONG else len(b)
    kept = {c for c, n in Counter(b).items() if n <= most}
    a_at, a_run = _places(a, kept)
    b_at, b_run = _places(b, kept)
    matched, todo = 0, [(0, len(a), 0, len(b), min(max(a_run, default=0), max(b_run, default=0)))]

    def shared(alo, ahi, blo, bhi, k):
        theirs = {g for _, g in _grams(b, b_at, b_run, blo, bhi, k)}
        return any(g in theirs for _, g in _grams(a, a_at, a_run, alo, ahi, k))

    while todo:
        alo, ahi, blo, bhi, limit = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        # the longest run that both have: a longer one holds shorter ones
        k, high, step = 0, min(limit, ahi - alo, bhi - blo), 1
        while k < high:
            longer = min(k + step, high)
            if shared(alo, ahi, blo, bhi, longer):
                k, step = longer, step * 2
            else:
                high, step = longer - 1, max(1, (longer - 1 - k) // 2)
        if k == 0:
            # only extending is left, and that from the beginning of both
            matched += _alike_from(a, alo, ahi, b, blo, bhi)
            continue
        where: dict[str, list[int]] = {}
        for j, g in _grams(b, b_at, b_run, blo, bhi, k):
            where.setdefault(g, []).append(j)
        for i, g in _grams(a, a_at, a_run, alo, ahi, k):
            found = where.get(g)
            if i < alo or found is None or found[-1] < blo:
                continue
            j = found[bisect_left(found, blo)]
            start, end = i, i + k + _alike_from(a, i + k, ahi, b, j + k, bhi)
            while start > alo and start - i + j > blo and a[start - 1] == b[start - 1 - i + j]:
                start -= 1
            matched += end - start
            todo.append((alo, start, blo, start - i + j, k - 1))
            alo, blo = end, end - i + j
        todo.append((alo, ahi, blo, bhi, k - 1))
    return 2.0 * matched / total
