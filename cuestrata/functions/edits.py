"""Edit distances of many pairs of texts by bit vectors: 64 cells of the table are one word operation."""

from __future__ import annotations

import numpy as np

#: Pairs and table entries that are taken together, and the fewest pairs for which that pays.
TOGETHER, ENTRIES, FEWEST = 1024, 1 << 20, 8
WORD = 64


def edit_distances(a: list[str], b: list[str]) -> np.ndarray:
    """Levenshtein distance of each pair, in code points.

    Pairs whose shorter texts fill equally many words run side by side, longest first;
    a few long ones left over run alone, on integers of any size.
    """
    short = [x if len(x) <= len(y) else y for x, y in zip(a, b, strict=True)]
    long = [y if len(x) <= len(y) else x for x, y in zip(a, b, strict=True)]
    out = np.array([len(t) for t in long], dtype=np.int64)
    words = np.array([-(-len(p) // WORD) for p in short], dtype=np.int64)
    order = np.lexsort((-out, words))
    order = order[words[order] > 0]
    at = 0
    while at < len(order):
        n = words[order[at]]
        end = min(at + TOGETHER, int(np.searchsorted(words[order], n, side="right")))
        group = order[at:end]
        if len(group) < FEWEST:
            out[group] = [_alone(short[i], long[i]) for i in group]
        else:
            out[group] = _together([short[i] for i in group], [long[i] for i in group], int(n))
        at = end
    return out


def _alone(p: str, t: str) -> int:
    place, full, high = {}, (1 << len(p)) - 1, 1 << (len(p) - 1)
    for i, ch in enumerate(p):
        place[ch] = place.get(ch, 0) | (1 << i)
    up, down, d = full, 0, len(p)
    for ch in t:
        eq = place.get(ch, 0)
        xv, xh = eq | down, (((eq & up) + up) ^ up) | eq
        ph, mh = down | (full & ~(xh | up)), up & xh
        d += bool(ph & high) - bool(mh & high)
        ph, mh = (ph << 1) | 1, mh << 1
        up, down = (mh | ~(xv | ph)) & full, ph & xv & full
    return d


def _codes(texts: list[str]) -> np.ndarray:
    """Code points of each text, one row a text, filled up with a code that no text has."""
    width = max(map(len, texts))
    return np.frombuffer("".join(x.ljust(width, "\0") for x in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(texts), width)


def _together(short: list[str], long: list[str], words: int) -> np.ndarray:
    p, t = _codes(short), _codes(long)
    if len(short) > (most := max(FEWEST, ENTRIES // (words * WORD))):
        return np.concatenate([_together(short[i:i + most], long[i:i + most], words) for i in range(0, len(short), most)])
    n, size = len(short), np.array([len(x) for x in short])
    lengths = np.array([len(x) for x in long])  # falling
    rows, one = np.arange(n), np.uint64(1)
    # letters are numbered within each pair; a letter that the shorter text lacks is one more
    found = np.zeros(0x110000, dtype=bool)
    found[p] = True
    number = np.where(found, np.cumsum(found) - 1, found.sum())
    p, t = number[p], number[t].T
    has = np.zeros((n, found.sum() + 1), dtype=bool)
    has[rows[:, None], p] = True
    has[:, -1] = False
    none = int(has.sum(axis=1).max())
    letter = np.where(has, np.cumsum(has, axis=1) - 1, none)
    p, t = letter[rows[:, None], p], letter[rows, t]
    place = np.zeros((words, n, none + 1), dtype=np.uint64)
    for i in range(p.shape[1]):
        here = rows[size > i]
        place[i // WORD, here, p[here, i]] |= one << np.uint64(i % WORD)
    first = (np.arange(words)[:, None] * n + rows) * (none + 1)
    # word w is w columns behind word 0, so that it finds what the word before it carried out
    blank = np.full((words - 1, n), none)
    t = np.ascontiguousarray(np.concatenate([blank, t, blank])[::-1])
    shift = np.full((words, n), WORD - 1, dtype=np.uint64)
    shift[-1] = (size - 1) % WORD
    up, down = np.full((words, n), ~np.uint64(0)), np.zeros((words, n), dtype=np.uint64)
    more, less = np.zeros((words + 1, n), dtype=np.uint64), np.zeros((words + 1, n), dtype=np.uint64)
    more[0] = 1
    d, out, last, k = size.astype(np.int64), np.empty(n, dtype=np.int64), t.shape[0] - words, n
    xh, mh = np.empty_like(up), np.empty_like(up)
    for s in range(last + 1):
        eq = place.take(first + t[last - s:last - s + words])
        xv = eq | down
        eq |= less[:-1]
        np.bitwise_and(eq, up, out=xh)
        xh += up
        xh ^= up
        xh |= eq
        np.bitwise_and(up, xh, out=mh)
        xh |= up
        np.invert(xh, out=xh)
        xh |= down  # a step up, before the shift
        np.right_shift(xh, shift, out=eq)
        eq &= one
        xh <<= one
        xh |= more[:-1]
        more[1:] = eq
        np.right_shift(mh, shift, out=eq)
        eq &= one
        mh <<= one
        mh |= less[:-1]
        less[1:] = eq
        np.bitwise_and(xh, xv, out=down)
        xv |= xh
        np.invert(xv, out=xv)
        np.bitwise_or(xv, mh, out=up)
        if s < words - 1:
            continue
        d += more[-1].view(np.int64)
        d -= less[-1].view(np.int64)
        left = int(np.searchsorted(-lengths, words - 2 - s, side="left"))  # with a column to come
        if left < k:
            out[left:k], k = d[left:k], left
            if k < 0.8 * len(d):
                first, t, shift, up, down, more, less, xh, mh = (np.ascontiguousarray(x[:, :k]) for x in (first, t, shift, up, down, more, less, xh, mh))
                d = d[:k].copy()
    return out
