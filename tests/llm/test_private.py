"""Personal data: base spans against plain regular expressions, and what the trees add."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest

from cuestrata.llm import private

SCHEMA = "doc_id long, text string, lang string, __found string, value string, start int, kind string"
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def luhn(digits: str) -> bool:
    twice = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in twice) % 10 == 0


def fine(kind: str, value: str) -> bool:
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base(text: str | None) -> list[tuple]:
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in p.finditer(text or "") if fine(k, m.group())]


def card(rng: random.Random) -> str:
    head = "".join(rng.choice("0123456789") for _ in range(15))
    return head + next(c for c in "0123456789" if luhn(head + c))


def awkward() -> list[str | None]:
    return [
        None, "", " \n", "a@b@c.de x", "a@b.c_d@e.f", "a@b.c.", "..@-.-", "é.x@y.zé", "😀a@b.cc😀 1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1 1.1.1.256 0255.1.1.1", "00000000000000000255.1.1.1",
        "99999999999999999999999.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 4111  1111", "41111111111111111111111", "1-2", "+1 (234) 555-0100", "+1+2 345678901", "+ 123456789", "+12..)(-9 +1234567890123456",
        "x" * 5000, "a." * 20000, "1" * 3000, "1." * 4000, "a@" * 3000, "a@b" + ".c" * 30000, "+1" + " 2" * 20000, "\x01a@b.cc\x01\x02 4111111111111111", "+1 (017) 555-7713 4111111111111111"]


def corpus(count: int = 240) -> list[tuple]:
    rng = random.Random(3)
    rows = []
    for i in range(count):
        words = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(12)]
        words[3] = rng.choice([f"{words[0]}@mail{i}.example.com", ".".join(str(rng.randint(1, 255)) for _ in range(4)), card(rng), f"+1 ({rng.randint(100, 999)}) 555-{rng.randint(1000, 9999)}"])
        if i % 3 == 0:
            words[6] = f"{rng.randint(1, 99)}-{rng.randint(10, 99)}"
        if i % 4 == 0:
            words[8] = ".".join(str(rng.randint(300, 999)) for _ in range(4))
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, t) for i, t in enumerate(awkward())]
    return [*rows, rows[5], (None, rows[6][1]), (rows[7][0], "another text a@b.cc")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en", "clash", "clash", 1, "clash") for i, t in corpus()], SCHEMA).repartition(3)


def test_base_spans(spark, docs):
    want = sorted((str(i), *(sum(k == b[0] for b in base(t)) for k in PATTERNS), hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base(t)).encode()).hexdigest()) for i, t in corpus())
    out = private.find_private(docs).collect()
    assert sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in out) == want
    assert all(r.spans.count(",") + bool(r.spans) == r.n_email + r.n_ip + r.n_card + r.n_phone + r.n_near for r in out)
    assert private.find_private(docs.limit(0)).count() == 0


def test_further_spans(spark):
    more = [(2000, "call (415) 555-0123 now"), (2001, "write zoë.x@mail.example.com or anna [at] mail [dot] example.com"), (2002, "version 3-14 and 12-10")]
    docs = spark.createDataFrame([(i, t, "en", "", "", 1, "") for i, t in [*corpus(600), *more]], SCHEMA)
    found = {(r.doc_id, r.kind, dict(more)[r.doc_id][r.start : r.end]) for r in private.personal_spans(docs).where("doc_id >= 2000 and doc_id < 3000").collect()}
    assert found == {
        (2000, "near_phone", "(415) 555-0123"), (2001, "near_email", "zoë.x@mail.example.com"), (2001, "email", ".x@mail.example.com"), (2001, "near_email", "anna [at] mail [dot] example.com")}
    clean = private.redact_private(docs).where("doc_id >= 2000 and doc_id < 3000").orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["call [PERSONAL] now", "write [PERSONAL] or [PERSONAL]", more[2][1]]


def test_redaction_keeps_rows_and_columns(spark, docs):
    out = private.redact_private(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    for r in out.where("doc_id < 240").collect():
        assert not base(r.text) and r.kind in ("clash",)
    assert private.redact_private(docs.limit(0)).count() == 0
    assert out.where("doc_id = 1000").first().text is None


def test_trees_and_thresholds(spark):
    rng = np.random.default_rng(2)
    sizes = list(private.FEATURES.values())
    table = np.array([[rng.integers(s) for s in sizes] for _ in range(300)])
    good = np.where((table[:, 1] > 2) & (table[:, 5] == 0) | (table[:, 7] == 1), 20.0, 1.0)
    model, score = private.boost(table, good, 21 - good)
    assert score[good > 10].mean() > score[good < 10].mean() + 2
    rows = spark.createDataFrame([tuple(map(int, r)) for r in table], ", ".join(f"f_{k} int" for k in private.FEATURES))
    assert np.allclose(sorted(r[0] for r in rows.select(model.score()).collect()), np.sort(score))
    family = table[:, 0]
    private.calibrate(model, score, family, good, 21 - good, 0.8)
    for k, s in model.thresholds.items():
        above = (family == k) & (score >= s)
        assert good[above].sum() >= 0.8 * (21 * above.sum() + 1)
    few = private.Boosted()
    private.calibrate(few, np.zeros(1), np.zeros(1, int), np.array([10.0]), np.zeros(1))
    assert few.thresholds == {}
