"""The label model against plain loops, hashing against its definition, and the memory of a worker."""

from __future__ import annotations

import math
import random
import subprocess
import sys

import numpy as np
import pytest

from cuestrata.llm import common, language, toxicity


def plain_label_model(patterns, counts, rounds):
    """Expectation maximisation with a tree of dependencies, one number at a time."""
    voters = range(toxicity.VOTERS)
    bit = lambda p, i: p >> i & 1
    scaled = [[c[0], c[1] * toxicity.KNOWN, c[2] * toxicity.KNOWN] for c in counts]
    total = sum(map(sum, scaled))
    scaled = [[x / total for x in c] for c in scaled]
    fired = [sum(bit(p, i) for i in range(toxicity.LEXICON_VOTERS)) for p in patterns]
    posterior = [0.95 if f >= 2 else 0.7 if f == 1 else 0.02 for f in fired]
    for _ in range(rounds):
        mass = [[c[1] + c[0] * (1 - q) for c, q in zip(scaled, posterior)], [c[2] + c[0] * q for c, q in zip(scaled, posterior)]]
        prior = [min(1.0, max(1e-6, sum(m))) for m in mass]
        small = 1e-4
        rate = [[(sum(m for m, p in zip(mass[y], patterns) if bit(p, i)) + small) / (prior[y] + 2 * small) for i in voters] for y in (0, 1)]

        def joint(y, a, b, i, j):
            return max(sum(m for m, p in zip(mass[y], patterns) if bit(p, i) == a and bit(p, j) == b), 0.0) + small / 4

        tables = {(y, i, j): [[joint(y, a, b, i, j) for b in (0, 1)] for a in (0, 1)] for y in (0, 1) for i in voters for j in voters}

        def strength(i, j):
            out = 0.0
            for y in (0, 1):
                t = tables[y, i, j]
                whole = sum(map(sum, t))
                out += sum(t[a][b] * math.log(t[a][b] * whole / (sum(t[a]) * (t[0][b] + t[1][b]))) for a in (0, 1) for b in (0, 1))
            return out

        tie = {(i, j): strength(i, j) for i in voters for j in voters}
        parent, inside = {0: -1}, [0]
        while len(inside) < toxicity.VOTERS:
            best = None
            for k in voters:
                if k in parent:
                    continue
                source = None
                for s in inside:  # the first of equals, as they came in
                    if source is None or tie[s, k] > tie[source, k]:
                        source = s
                if best is None or tie[source, k] > tie[best[1], best[0]]:
                    best = (k, source)
            parent[best[0]] = best[1]
            inside.append(best[0])
        posterior = []
        for p in patterns:
            score = [math.log(prior[0]), math.log(prior[1])]
            for y in (0, 1):
                for i in voters:
                    if parent[i] < 0:
                        on = rate[y][i]
                    else:
                        t, b = tables[y, i, parent[i]], bit(p, parent[i])
                        on = t[1][b] / (t[0][b] + t[1][b])
                    score[y] += math.log(min(1.0, max(1e-9, on if bit(p, i) else 1 - on)))
            posterior.append(1 / (1 + math.exp(min(50.0, max(-50.0, score[0] - score[1])))))
    return posterior


def test_label_model_equals_plain_loops():
    rng = random.Random(11)
    seen = {}
    for _ in range(400):
        toxic = rng.random() < 0.3
        votes = 0
        for i in range(toxicity.VOTERS):
            on = rng.random() < ((0.7 if toxic else 0.08) if i % 3 else (0.5 if toxic else 0.2))
            if i in (4, 5) and rng.random() < 0.8:
                on = votes >> (i - 1) & 1  # depends on the voter before
            votes |= int(on) << i
        kind = 0 if rng.random() < 0.6 else 1 + toxic
        seen.setdefault(votes, [0, 0, 0])[kind] += 1
    patterns = sorted(seen)
    model = toxicity.LabelModel(np.array(patterns), np.array([seen[p] for p in patterns], float), rounds=4)
    assert model.posterior == pytest.approx(plain_label_model(patterns, [seen[p] for p in patterns], 4), abs=1e-9)


def test_span_hashes_of_any_length():
    rng = np.random.default_rng(2)
    buf = rng.integers(0, 256, 700_000).astype(np.uint8)
    half = common.POWERS // 2
    starts = np.array([0, 3, 3, 10, half - 1, half, 200_000, 200_001])
    ends = np.array([1, 3, 9, 10 + 2 * half, half + 5, 2 * half + 1, 690_000, 200_004])
    m, values = common.multiplier(1), common.byte_values(1)
    table, p = [], 1
    for _ in range(len(buf)):
        table.append(p)
        p = p * m & (1 << 64) - 1
    powers = np.array(table, np.uint64)

    def defined(a, b):
        total = (values[buf[a:b]] * powers[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)
        return common.mix(np.array([total], np.uint64))[0]

    assert common.span_hashes(buf, starts, ends).tolist() == [defined(a, b) for a, b in zip(starts, ends, strict=True)]


def test_worker_memory_of_the_voters():
    """A fresh process stays below 150 MB over slices of a large batch."""
    code = """
import numpy as np
from cuestrata.llm import common, language, toxicity
rng = np.random.default_rng(1)
buf = rng.integers(97, 103, 8_000_000).astype(np.uint8)
buf[rng.integers(0, len(buf), 1_200_000)] = 32
off = np.append(np.arange(0, 7_000_001, 2000), len(buf))
voters = toxicity.Voters.build([(0, b"abc", 2.0), (1, b"abcd", 2.0), (2, b"abcde", 1.5)])
for a, b in common.row_slices(off[:-1]):
    voters.look(buf[off[a] : off[b]], off[a : b + 1] - off[a])
common.give_back()
print(int(open("/proc/self/statm").read().split()[1]) * 4096 // 1_000_000 - len(buf) // 1_000_000)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, env={"PYTHONPATH": ":".join(sys.path), "PATH": "/usr/bin:/bin"})
    assert int(out.stdout) < 150


def test_language_scores_equal_a_dense_kernel_ridge():
    """Sets of n-grams, a full kernel matrix and the ridge solution in the space of landmarks."""
    rng = random.Random(5)
    parts = {"xx": "abcd", "yy": "cdefß", "zz": "éçghab"}
    text = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 12)))
    rows = [(text(lang), lang) for lang in ("xx", "yy", "zz") for _ in range(12)] + [("a", "xx"), ("ab", "yy")]
    rng.shuffle(rows)
    model = language.fit(rows, landmarks=5)
    sets = lambda t: {t.lower()[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}
    langs, taken, chosen = sorted(parts), {}, []
    for t, lang in rows:
        if len(t) > 2 and taken.get(lang, 0) < 5:
            taken[lang] = taken.get(lang, 0) + 1
            chosen.append(t)
    held = [sets(t) for t in chosen]
    known = set().union(*held)
    kernel = lambda ts: np.array([[len(sets(t) & m) / (max(len(sets(t) & known), 1) ** 0.5 * len(m) ** 0.5) for m in held] for t in ts])
    value, vector = np.linalg.eigh(kernel(chosen))
    keep = value > 1e-6 * value.max()
    mapped = lambda ts: kernel(ts) @ vector[:, keep] / np.sqrt(value[keep])
    x, n = mapped([t for t, _ in rows]), {x: sum(lang == x for _, lang in rows) for x in langs}
    weight = np.array([len(rows) / (len(langs) * n[lang]) for _, lang in rows])
    y = np.array([[1.0 if lang == x else -1.0 for x in langs] for _, lang in rows])
    solved = np.linalg.solve(x.T @ (x * weight[:, None]) + language.RIDGE * len(rows) * np.eye(x.shape[1]), (x * weight[:, None]).T @ y)
    fresh = [text(lang) for lang in langs for _ in range(5)] + ["qqq", "a"]
    presence, _ = language._features(model, [t.lower() for t in fresh])
    assert model.langs == langs
    assert model.scores(presence) == pytest.approx(mapped(fresh) @ solved, abs=2e-4)
