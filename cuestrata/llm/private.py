"""Personal data by candidate gradient boosting, in DataFrame functions only.

1. Generators of high recall propose spans, which may overlap: the base kinds, mail addresses with
   letters of any script or a written-out "at", long and grouped numbers, IPv6 addresses.
2. A base candidate that passes its check (octets, Luhn digit, number of digits) is a finding
   for sure.  Passing and failing ones, and numbers too short to be personal, are the weak labels.
3. Boosted trees learn them from format and context alone: the checks, the plus sign and the plain alphabet,
   which decided the labels, are hidden from them, so they carry over to candidates that miss a check.
   Features are small categories; candidates are counted by combination of features, in
   Spark, and the trees are fitted to that table, whose size the numbers of categories bound.
4. On held-out documents the lowest score whose findings are ``PRECISION`` right is the threshold
   of each family of candidates.  A further candidate from there on is reported unless a base span holds it.

The trees are column expressions; every candidate of every document is scored by them.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuestrata.llm.common import stage, text_key, text_or_empty
from cuestrata.llm.language import fold

#: Candidate patterns by generator.  The first four are the base kinds: a guard before the first character and
#: possessive repetition keep a scan linear in texts of any form, without changing what matches.
GENERATORS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "any_mail": r"""(?<![^\x00-\x20"'(),:;<>@\[\]\\|])[^\x00-\x20"'(),:;<>@\[\]\\|]{1,64}+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)*+""",
    "at_mail": r"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]{1,64}+\x20?[\[(]\x20?at\x20?[\])]\x20?[a-z0-9-]++(?:\x20?(?:[\[(]\x20?dot\x20?[\])]|\.)\x20?[a-z0-9-]++)++",
    "ip6": r"(?<![0-9A-Fa-f:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])",
    "number": r"(?<![0-9])\+?\(?[0-9]{1,4}\)?(?:[\x20.-]{1,2}\(?[0-9]{2,4}\)?){1,4}(?![0-9])",
}
BASE = ["email", "ip", "card", "phone"]
#: Kinds in the order in which they are listed.
KINDS = [*BASE, "near_email", "near_ip", "near_card", "near_phone"]
FAMILIES = {"email": 0, "any_mail": 0, "at_mail": 0, "ip": 1, "ip6": 1, "card": 2, "phone": 2, "number": 2}
#: A number with fewer digits is nobody's phone or card.
FEW_DIGITS = 7
#: Code points of context before a candidate.
BEFORE = 24
#: Words that announce personal data.
CUES = r"(?i)\b(?:e-?mail|mail|phone|tel|call|fax|mobile|card|visa|account|ip|host|contact)\b"
TREES, RATE, PRECISION, FOLDS, HELD = 24, 0.3, 0.95, 5, 0
#: Categories of each feature.
FEATURES = {"family": 3, "digits": 6, "groups": 4, "separators": 4, "parens": 2, "before": 4, "after": 4, "cue": 2, "tail": 3}
_MARK, _STAND_IN = "\x01", "\x02"


def candidates(docs: DataFrame) -> DataFrame:
    """All candidates: doc_id, th, source, nth, value, left, right (context), start, end (code points, end exclusive).

    One scan a pattern: matches are marked, the text is cut at the marks, and pieces stand
    in turn for what lies between and what matches.  A mark that a text itself has is another control
    character first, which no pattern tells apart.
    """
    text = F.translate(text_or_empty(), _MARK, _STAND_IN)
    cut = docs.select("doc_id", text_key().alias("th"), *(
        F.split(F.regexp_replace(text, F.lit(p), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1).alias(f"__{k}") for k, p in GENERATORS.items()))
    parity = lambda c, odd: F.filter(c, lambda _, i: (i % 2) == odd)
    halves = cut.select("doc_id", "th", *(parity(f"__{k}", odd).alias(f"__{k}_{odd}") for k in GENERATORS for odd in (0, 1)))

    def rows(kind: str) -> Column:
        gap, found = F.col(f"__{kind}_0"), F.col(f"__{kind}_1")
        after = F.transform(F.slice(gap, 2, F.greatest(F.size(found), F.lit(1))), lambda g: F.left(g, F.lit(1)))
        before = F.transform(F.slice(gap, 1, F.greatest(F.size(found), F.lit(1))), lambda g: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(BEFORE)).alias("left")))
        zipped = F.arrays_zip(found.alias("value"), before.alias("b"), after.alias("right"))
        return F.when(F.size(found) > 0, F.transform(zipped, lambda z, i: F.struct(
            F.lit(kind).alias("source"), i.alias("nth"), z["value"].alias("value"), z["b"]["gap"].alias("gap"), z["b"]["left"].alias("left"), z["right"].alias("right"))))

    each = F.explode(F.filter(F.flatten(F.array_compact(F.array(*map(rows, GENERATORS)))), lambda x: x.isNotNull()))
    found = halves.select("doc_id", "th", each.alias("c")).select("doc_id", "th", "c.*").dropDuplicates(["doc_id", "th", "source", "nth"])
    along = Window.partitionBy("doc_id", "th", "source").orderBy("nth")
    end = F.sum(F.col("gap") + F.length("value")).over(along)
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.length("value")).drop("gap")


def _digits() -> Column:
    return F.regexp_replace("value", "[^0-9]", "")


def passes() -> Column:
    """Whether a base candidate passes its check; null for other candidates."""
    n, source = F.length(_digits()), F.col("source")
    octets = F.forall(F.split("value", r"\."), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.ltrim(p, F.lit("0")).try_cast("int"), F.lit(0)) <= 255))
    return (
        F.when(source == "email", F.lit(True)).when(source == "ip", octets)
        .when(source == "card", F.when(n.between(13, 19), F.call_function("luhn_check", _digits())).otherwise(False)).when(source == "phone", n.between(9, 15)))


def _character(c: Column) -> Column:
    """0: none or blank, 1: letter or digit, 2: mark that encloses or ends, 3: other."""
    return F.when(c.rlike(r"^[\x20\x09-\x0D]?$"), 0).when(c.rlike(r"^[\p{L}\p{N}_]$"), 1).when(c.rlike(r"^[.,;:!?)(\"'<>|\]\[]$"), 2).otherwise(3)


def features() -> dict[str, Column]:
    """Format and context of a candidate, as small numbers; what decided the weak labels is left out."""
    value, mail = F.col("value"), F.col("source").isin("email", "any_mail", "at_mail")
    family = F.lit(2)
    for k, x in FAMILIES.items():
        family = F.when(F.col("source") == k, x).otherwise(family)
    n = F.length(_digits())
    groups = F.size(F.split(F.regexp_replace(value, r"^[^0-9]+|[^0-9]+$", ""), "[^0-9]+"))
    none = lambda *classes: ~F.col("value").rlike("[" + "".join(classes) + "]")
    separators = F.when(mail, 0).when(none(r"\x20", r"\.", "-"), 0).when(none(r"\x20", r"\."), 1).when(none(r"\x20", "-"), 2).otherwise(3)
    tail = F.length(F.regexp_extract("value", r"\.([\p{L}]+)$", 1))
    return {
        "family": family,
        "digits": F.when(mail, 0).when(n < 7, 0).when(n < 9, 1).when(n < 12, 2).when(n < 16, 3).when(n == 16, 4).otherwise(5),
        "groups": F.when(mail, 0).otherwise(F.least(groups, F.lit(4)) - 1),
        "separators": separators,
        "parens": value.contains("(").cast("int"),
        "before": _character(F.right("left", F.lit(1))),
        "after": _character(F.col("right")),
        "cue": F.col("left").rlike(CUES).cast("int"),
        "tail": F.when(~mail | (tail == 0), 0).when(tail <= 3, 1).otherwise(2),
    }


def described(docs: DataFrame) -> DataFrame:
    """Candidates with features, ``sure`` (passes its check) and ``taught`` (weak label; null: none)."""
    found = candidates(docs).withColumn("sure", passes())
    few = (F.col("source") == "number") & (F.length(_digits()) < FEW_DIGITS)
    return found.select(
        "doc_id", "th", "source", "start", "end", F.coalesce("sure", F.lit(False)).alias("sure"), F.when(few, 0).otherwise(F.col("sure").cast("int")).alias("taught"),
        F.length(_digits()).alias("n_digits"), *(c.cast("int").alias(f"f_{k}") for k, c in features().items()))


@dataclass
class Boosted:
    """Trees of depth two over tests "feature = category", a start value, and a threshold a family."""

    start: float = 0.0
    trees: list[tuple] = field(default_factory=list)
    thresholds: dict[int, float] = field(default_factory=dict)

    def score(self) -> Column:
        """Log odds of a candidate; sums are rounded so that equal features compare equal."""
        test = lambda t: F.col(f"f_{t[0]}") == t[1]
        total = F.lit(self.start)
        for root, (yes, a, b), (no, c, d) in self.trees:
            total = total + F.when(test(root), F.when(test(yes), a).otherwise(b)).otherwise(F.when(test(no), c).otherwise(d))
        return F.round(total, 9)

    def reported(self) -> Column:
        """Whether a candidate's score reaches the threshold of its family."""
        limit = F.lit(float("inf"))
        for k, x in self.thresholds.items():
            limit = F.when(F.col("f_family") == k, F.lit(x)).otherwise(limit)
        return self.score() >= limit


def boost(table: np.ndarray, good: np.ndarray, bad: np.ndarray, trees: int = TREES, rate: float = RATE) -> tuple[Boosted, np.ndarray]:
    """Gradient boosting on rows of categories with so many good and bad candidates; the model and each row's score.

    Newton steps on the logistic loss: of all tests, the one that raises the gain most splits the root, then each side.
    """
    names = list(FEATURES)
    tests = [(i, v) for i, k in enumerate(names) for v in range(FEATURES[k])]
    holds = np.array([table[:, i] == v for i, v in tests])
    every = good + bad
    model = Boosted(float(np.log((good.sum() + 1) / (bad.sum() + 1))))
    z = np.full(len(table), model.start)

    def split(rows: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[tuple, float, float, np.ndarray]:
        a, b = (holds & rows) @ g, (holds & rows) @ h
        c, d = (g * rows).sum() - a, (h * rows).sum() - b
        best = int(np.argmax(np.round(a * a / (b + 1) + c * c / (d + 1), 9)))
        i, v = tests[best]
        return (names[i], v), rate * a[best] / (b[best] + 1), rate * c[best] / (d[best] + 1), holds[best]

    for _ in range(trees):
        p = 1 / (1 + np.exp(-z))
        g, h = good - every * p, every * p * (1 - p)
        root, _, _, side = split(np.ones(len(table), bool), g, h)
        yes, no = split(side, g, h), split(~side, g, h)
        model.trees.append((root, tuple(map(_plain, yes[:3])), tuple(map(_plain, no[:3]))))
        z = z + np.where(side, np.where(yes[3], yes[1], yes[2]), np.where(no[3], no[1], no[2]))
    return model, np.round(z, 9)


def _plain(x):
    return x if isinstance(x, tuple) else float(x)


def calibrate(model: Boosted, score: np.ndarray, family: np.ndarray, good: np.ndarray, bad: np.ndarray, precision: float = PRECISION) -> None:
    """Thresholds from held-out candidates: the lowest score from which on at least ``precision`` are good;
    one more bad one is counted, so that a few candidates prove nothing."""
    for k in np.unique(family).tolist():
        own = family == k
        s, at = np.unique(score[own], return_inverse=True)
        g, b = np.bincount(at, good[own], len(s)), np.bincount(at, bad[own], len(s))
        above_g, above_b = np.cumsum(g[::-1])[::-1], np.cumsum(b[::-1])[::-1]
        right = np.flatnonzero(above_g >= precision * (above_g + above_b + 1))
        if len(right):
            model.thresholds[k] = float(s[right[0]])


def fit(found: DataFrame) -> Boosted:
    """Model of the weakly labelled candidates; without good and bad ones it reports nothing further."""
    names = [f"f_{k}" for k in FEATURES]
    held = fold(FOLDS) == HELD
    count = lambda y, h: F.count(F.when((F.col("taught") == y) & h, 1))
    rows = found.where(F.col("taught").isNotNull()).groupBy(*names).agg(
        count(1, ~held).alias("good"), count(0, ~held).alias("bad"), count(1, held).alias("held_good"), count(0, held).alias("held_bad")).orderBy(*names).collect()
    table = np.array([[r[k] for k in names] for r in rows], np.int64).reshape(len(rows), len(names))
    good, bad, held_good, held_bad = (np.array([r[k] for r in rows], float) for k in ("good", "bad", "held_good", "held_bad"))
    if not len(rows) or not good.sum() or not bad.sum():
        return Boosted()
    model, score = boost(table, good, bad)
    calibrate(model, score, table[:, 0], held_good, held_bad)
    return model


def select(found: DataFrame, model: Boosted) -> DataFrame:
    """doc_id, th, kind, start, end: base spans, and further candidates that are likely and that no base span holds."""
    family = F.col("f_family")
    near = F.when(family == 0, "near_email").when(family == 1, "near_ip").when(F.col("n_digits") >= 13, "near_card").otherwise("near_phone")
    likely = model.reported() & ~F.coalesce(F.col("taught") == 0, F.lit(False)) | F.col("sure")
    chosen = found.where(likely).withColumn("kind", F.when(F.col("sure"), F.col("source")).otherwise(near))
    upto = Window.partitionBy("doc_id", "th").orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    reach = F.max(F.when(F.col("sure"), F.col("end"))).over(upto)
    return chosen.withColumn("reach", reach).where(F.col("sure") | F.coalesce(F.col("reach") < F.col("end"), F.lit(True))).select("doc_id", "th", "kind", "start", "end").distinct()


def personal_spans(docs: DataFrame) -> DataFrame:
    """All spans of ``docs``: doc_id, th (a hash of the text, for rows of one id), kind, start, end."""
    found = stage(described(docs), "candidates")
    return select(found, fit(found))


def _by_document(docs: DataFrame, order: list[str]) -> DataFrame:
    nth = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    span = F.struct(*(nth.alias("nth") if c == "nth" else F.col(c) for c in order))
    return personal_spans(docs).groupBy("doc_id", "th").agg(F.array_sort(F.collect_list(span)).alias("found"))


def _joined(docs: DataFrame, spans: DataFrame, *kept: Column) -> DataFrame:
    """``kept`` columns of every row, beside __found: its spans, or none."""
    own = docs.select(F.struct(*kept).alias("__row"), F.col("doc_id").alias("__own_id"), text_key().alias("__own_th"))
    other = spans.select(F.col("doc_id").alias("__span_id"), F.col("th").alias("__span_th"), F.col("found").alias("__found"))
    return own.join(other, F.col("__own_id").eqNullSafe(F.col("__span_id")) & (F.col("__own_th") == F.col("__span_th")), "left").select("__row", "__found")


def find_private(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_near.

    Null texts count as empty and give no spans; repeated rows each get their row; a null doc_id is a
    value like any other; texts of any length are searched whole; of equal spans of one kind one is
    listed; extra columns of the input are not looked at; an empty table gives no rows.
    """
    spans = _by_document(docs, ["nth", "start", "end", "kind"])
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    found = F.coalesce("__found", F.array().cast(spans.schema["found"].dataType))
    all_rows = _joined(docs, spans, F.col("doc_id")).select(F.col("__row.doc_id"), found.alias("found"))
    count = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return all_rows.select(
        "doc_id", *map(count, BASE), F.sha2(listed(F.filter("found", lambda x: x["nth"] < len(BASE))), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"),
        F.size(F.filter("found", lambda x: x["nth"] >= len(BASE))).cast("long").alias("n_near"))


def redact_private(docs: DataFrame, mark: str = "[PERSONAL]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; all rows and all other columns stay, whatever their names.

    Spans that overlap or touch become one mark; a null text stays null; repeated rows are redacted alike.
    """
    spans = _by_document(docs, ["start", "end"])
    rows = _joined(docs, spans, *(F.col(c) for c in docs.columns))
    text = F.col("__row.text")
    state = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    step = lambda a, x: F.struct(
        F.greatest(a["at"], x["end"].cast("long")).alias("at"),
        F.when((x["start"] > a["at"]) | (F.size(a["out"]) == 0), F.concat(a["out"], F.array(text.substr((a["at"] + 1).cast("int"), (x["start"] - a["at"]).cast("int")), F.lit(mark)))).otherwise(a["out"]).alias("out"))
    cut = F.aggregate("__found", state, step, lambda a: F.concat(F.array_join(a["out"], ""), text.substr((a["at"] + 1).cast("int"), F.length(text))))
    clean = F.when(F.col("__found").isNotNull(), cut).otherwise(text)
    return rows.select(*(clean.alias(c) if c == "text" else F.col(f"__row.{c}") for c in docs.columns))
