"""Text measures as column expressions, plus table jobs that add them as columns.

Expressions stay in the JVM.  The one exception is ``char_similarity``, whose
longest-block matching has no SQL form and runs as an Arrow batch function.
"""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType

from cuestrata import rules
from cuestrata.functions.blocks import block_ratio
from cuestrata.functions.edits import edit_distances

# Unicode white space (Java's \s alone is ASCII).
WS = r"[\s\u0085\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]"
#: The same set for searches through long texts: letters fail at the first ranges.
SPACE = r"[\x00-\x20\x7F-\u00A0\u1680-\u3000&&" + WS + "]"
#: The same set as characters.
SPACES = "\t\n\x0b\f\r \u0085\u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
SCRIPT = r"\u3040-\u30FF\u4E00-\u9FFF"
JAPANESE = f"[{SCRIPT}]"


# ------------------------------------------------------------------ expressions
def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it many times in ``body``, lambdas included.

    Spark evaluates whatever a lambda mentions again for each element; a lambda's own
    argument is a finished value.
    """
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column | str) -> Column:
    """Small ASCII letters; a text of ASCII alone goes the short way."""
    text = col(c)
    return F.when(_ascii(text), F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


def token_lower(c: Column | str) -> Column:
    """Small letters, for looking at ASCII letters and apostrophes alone; other letters may change as well.

    Only the Kelvin sign and the dotted capital I would become ASCII letters.
    """
    text = col(c)
    return F.when(text.contains("\u212a") | text.contains("\u0130"), ascii_lower(text)).otherwise(F.lower(text))


def strip(c: Column | str) -> Column:
    """Trim Unicode white space on both sides."""
    return F.trim(col(c), F.lit(SPACES))


def strip_left(c: Column | str) -> Column:
    return F.ltrim(col(c), F.lit(SPACES))


def strip_right(c: Column | str) -> Column:
    return F.rtrim(col(c), F.lit(SPACES))


def _ascii(text: Column) -> Column:
    return F.octet_length(text) == F.length(text)


def collapse(c: Column | str) -> Column:
    """Every run of white space becomes one space; ends trimmed.

    A text of ASCII with single spaces alone, as most lines are, is only trimmed.
    """
    def short(text):
        plain = reduce(lambda so_far, gap: so_far & ~F.contains(text, F.lit(gap)), ("  ", *"\t\n\x0b\f\r"), _ascii(text))
        return F.trim(F.when(plain, text).otherwise(F.regexp_replace(text, f"{SPACE}+", " ")))

    # an expression is looked at many times, so it is evaluated first
    return short(F.col(c)) if isinstance(c, str) else let(c, short)


def health_key(c: Column | str) -> Column:
    return F.lower(collapse(c))


def line_key(c: Column | str) -> Column:
    return ascii_lower(collapse(c))


def source_key(c: Column | str) -> Column:
    """Source phrase key: ASCII letters and digits, kana and han only."""
    # as ranges: negated, the class takes ten times as long
    return F.regexp_replace(col(c), r"[\x00-/:-@\[-`{-\u303F\u3100-\u4DFF\uA000-\x{10FFFF}]+", "")


def target_key(c: Column | str) -> Column:
    """Target phrase key: ASCII letters, digits and apostrophes, lower case."""
    return F.trim(F.regexp_replace(ascii_lower(c), r"[\x00-&(-/:-`{-\x{10FFFF}]+", " "))


def short_cue_key(c: Column | str) -> Column:
    marks = "".join("\\" + ch for ch in rules.SHORT_CUE_STRIP)
    return F.regexp_replace(col(c), f"{SPACE}|[{marks}]", "")


def exact_key(c: Column | str) -> Column:
    return F.regexp_replace(col(c), f"[ \\t\\n\\f\\r{rules.EXACT_STRIP}]", "")


def tokens(c: Column | str) -> Column:
    """Maximal runs of ASCII letters and apostrophes."""
    return F.regexp_extract_all(col(c), F.lit("([A-Za-z']+)"), F.lit(1))


def lower_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(token_lower(c), F.lit("([a-z']+)"), F.lit(1))


def double_apostrophe(c: Column | str) -> Column:
    """A token with two or more apostrophes."""
    return col(c).rlike("'[A-Za-z]*'")


def malformed_contraction(c: Column | str) -> Column:
    # letters are made small once, not for each literal
    return let(token_lower(c), lambda low: reduce(lambda hit, literal: hit | low.contains(literal), rules.MALFORMED, F.lit(False)))


def low_function_words(toks: Column) -> Column:
    """``toks`` are lower-case tokens."""
    def test(t):
        known = F.size(F.filter(t, lambda w: w.isin(*rules.FUNCTION_WORDS)))
        return F.when(F.size(t) < 6, False).otherwise(known / F.size(t) < 0.10)

    return let(toks, test)


def adjacent_repeat(toks: Column) -> Column:
    """Equal neighbouring tokens, or equal neighbouring pairs; ``toks`` lower case."""
    def test(t):
        n = F.size(t)
        single = F.exists(F.sequence(F.lit(1), n - 1), lambda i: t[i - 1] == t[i])
        double = F.exists(
            F.sequence(F.lit(0), n - 4),
            lambda i: (t[i] == t[i + 2]) & (t[i + 1] == t[i + 3]),
        )
        return F.when(n < 4, False).otherwise(single | double)

    return let(toks, test)


def titlecase_tokens(c: Column | str) -> Column:
    """ASCII words of three letters or more, one capital then small letters."""
    return F.regexp_extract_all(col(c), F.lit("[A-Z](?<![A-Za-z][A-Z])[a-z]{2,}+(?![A-Za-z])"), F.lit(0))


def has_japanese(c: Column | str) -> Column:
    return col(c).rlike(JAPANESE)


def solid_chars(c: Column | str) -> Column:
    """Number of characters other than white space."""
    text = col(c)
    bare = reduce(lambda left, gap: F.replace(left, F.lit(gap), F.lit("")), " \t\n\x0b\f\r", text)
    return F.length(F.when(_ascii(text), bare).otherwise(F.regexp_replace(text, f"{SPACE}+", "")))


def japanese_chars(c: Column | str) -> Column:
    text = col(c)
    return F.when(_ascii(text), 0).otherwise(F.length(F.regexp_replace(text, f"[^{SCRIPT}]+", "")))


def jp_ratio(c: Column | str) -> Column:
    solid = solid_chars(c)
    return F.when(solid == 0, 0.0).otherwise(japanese_chars(c) / solid)


def generic_interjection(c: Column | str) -> Column:
    """A lower-case line that is one of a few stock interjections."""
    cleaned = collapse(F.regexp_replace(col(c), r"[\x00-\x08\x0E-\x1F!-&(-@\[-`{-\x{10FFFF}]+", " "))
    return cleaned.isin(*rules.INTERJECTIONS)


def asks(c: Column | str) -> Column:
    return col(c).contains("?") | col(c).contains("？")


def exclaims(c: Column | str) -> Column:
    return col(c).contains("!") | col(c).contains("！")


def word_count(c: Column | str) -> Column:
    """White-space separated words."""
    clean = collapse(c)
    return F.when(clean == "", 0).otherwise(F.size(F.split(clean, " ")))


@F.pandas_udf(LongType())
def _edits(a: pd.Series, b: pd.Series) -> pd.Series:
    out = pd.Series([None] * len(a), dtype="Int64")
    both = np.flatnonzero((a.notna() & b.notna()).to_numpy())
    out.iloc[both] = edit_distances(a.iloc[both].tolist(), b.iloc[both].tolist())
    return out


def similarity(a: Column | str, b: Column | str) -> Column:
    """1 - edit distance / longer length; two empty strings are equal, and equal pairs skip Python."""
    a, b = col(a), col(b)
    differ, longest = a != b, F.greatest(F.length(a), F.length(b))
    return F.when(a == b, 1.0).otherwise(1 - _edits(F.when(differ, a), F.when(differ, b)) / longest)


def similar(a: Column, b: Column, floor: float) -> Column:
    """``similarity >= floor`` of short texts, looking no further than the length difference allows."""
    longest = F.greatest(F.length(a), F.length(b))
    near = 1 - F.abs(F.length(a) - F.length(b)) / longest >= floor
    return F.when(a == b, True).when(near, 1 - F.levenshtein(a, b) / longest >= floor).otherwise(False)


def f1_tokens(c: Column | str) -> Column:
    return F.regexp_extract_all(F.lower(col(c)), F.lit("([a-z0-9']+)"), F.lit(1))


def f1_score(common: Column, left: Column, right: Column) -> Column:
    """F1 of a multiset overlap; both sides empty count as equal."""
    precision = common / F.greatest(F.lit(1), right)
    recall = common / F.greatest(F.lit(1), left)
    return (
        F.when((left == 0) & (right == 0), 1.0)
        .when(common == 0, 0.0)
        .otherwise(2 * precision * recall / (precision + recall))
    )


def token_f1_expr(ref: Column | str, hyp: Column | str) -> Column:
    """Row form of multiset F1: one pass over both token lists, sorted together.

    Within a token the reference's copies come first; a copy of the hypothesis counts as
    common while it still finds one of them.
    """
    def common(pair):
        both = F.array_sort(F.concat(
            F.transform(pair["r"], lambda t: F.struct(t.alias("t"), F.lit(0).alias("s"))),
            F.transform(pair["h"], lambda t: F.struct(t.alias("t"), F.lit(1).alias("s")))))
        start = F.struct(F.lit("").alias("t"), F.lit(0).alias("left"), F.lit(0).alias("hits"))

        def step(acc, x):
            left = F.when(acc["t"] == x["t"], acc["left"]).otherwise(0)
            hit = F.when((x["s"] == 1) & (left > 0), 1).otherwise(0)
            return F.struct(
                x["t"].alias("t"), F.when(x["s"] == 0, left + 1).otherwise(left - hit).alias("left"),
                (acc["hits"] + hit).alias("hits"))

        return F.aggregate(both, start, step)["hits"]

    def score(pair):
        return let(common(pair), lambda c: f1_score(c, F.size(pair["r"]), F.size(pair["h"])))

    both = F.struct(f1_tokens(ref).alias("r"), f1_tokens(hyp).alias("h"))
    return F.when(F.lower(col(ref)) == F.lower(col(hyp)), 1.0).otherwise(let(both, score))


@F.pandas_udf(DoubleType())
def _block_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else block_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def char_similarity_expr(a: Column | str, b: Column | str) -> Column:
    """Matching-block ratio of the lower-cased strings; equal pairs skip Python."""
    la, lb = F.lower(col(a)), F.lower(col(b))
    differ = la != lb
    return F.coalesce(_block_ratio(F.when(differ, la), F.when(differ, lb)), F.lit(1.0))


# ------------------------------------------------------------------- table jobs
def _adder(name, expr):
    def job(df: DataFrame, text_col: str = "text") -> DataFrame:
        return df.withColumn(name, expr(text_col))

    job.__name__ = name
    job.__doc__ = f"Add ``{name}`` computed from ``text_col``."
    return job


add_tokens = _adder("tokens", tokens)
add_double_apostrophe = _adder("double_apostrophe", double_apostrophe)
add_malformed_contraction = _adder("malformed_contraction", malformed_contraction)
add_low_function_words = _adder("low_function_words", lambda c: low_function_words(lower_tokens(c)))
add_adjacent_repeat = _adder("adjacent_repeat", lambda c: adjacent_repeat(lower_tokens(c)))
add_titlecase_tokens = _adder("titlecase_tokens", titlecase_tokens)
add_has_japanese = _adder("has_japanese", has_japanese)
add_jp_ratio = _adder("jp_ratio", jp_ratio)
add_generic_interjection = _adder("generic_interjection", lambda c: generic_interjection(line_key(c)))


def add_normal_forms(df: DataFrame, text_col: str = "text") -> DataFrame:
    """All seven normal forms of a text, one column each."""
    return df.withColumns({
        "health_key": health_key(text_col),
        "compact_text": collapse(text_col),
        "line_key": line_key(text_col),
        "source_key": source_key(text_col),
        "target_key": target_key(text_col),
        "short_cue_key": short_cue_key(text_col),
        "exact_key": exact_key(text_col),
    })


def add_similarity(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.withColumn("similarity", similarity(left, right))


def add_char_similarity(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.withColumn("char_similarity", char_similarity_expr(left, right))


def add_token_f1(df: DataFrame, left: str, right: str) -> DataFrame:
    return df.withColumn("token_f1", token_f1_expr(left, right))


def repeated_ngram(df: DataFrame, keys: list[str], n: int = 3, text_col: str = "text") -> DataFrame:
    """Flag rows holding an n-gram that occurs again without overlapping itself.

    The n-grams of a row are sorted together with their places and compared with the first
    of their kind, inside the row: nothing is shuffled, and a line of tens of thousands of
    tokens costs a sort.  ``keys`` identify a row.
    """
    def test(toks):
        places = F.sequence(F.lit(1), F.size(toks) - n + 1)
        grams = F.array_sort(F.transform(places, lambda i: F.struct(
            F.concat_ws(" ", *[F.element_at(toks, i + k) for k in range(n)]).alias("g"), i.alias("i"))))
        start = F.struct(F.lit(None).cast("string").alias("g"), F.lit(0).alias("i"), F.lit(False).alias("hit"))

        def step(acc, x):
            same = acc["g"].eqNullSafe(x["g"])
            return F.struct(
                x["g"].alias("g"), F.when(same, acc["i"]).otherwise(x["i"]).alias("i"),
                (acc["hit"] | (same & (x["i"] - acc["i"] >= n))).alias("hit"))

        return F.when(F.size(toks) >= 2 * n, F.aggregate(grams, start, step)["hit"]).otherwise(False)

    return df.withColumn("repeated_ngram", F.coalesce(let(tokens(text_col), test), F.lit(False)))


def text_features(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Token count and the defect flags every scorer shares, computed once per row."""
    return (
        df.withColumn("__tok", lower_tokens(text_col))
        .withColumns({
            "n_tokens": F.size("__tok"),
            "malformed": malformed_contraction(text_col) | double_apostrophe(text_col),
            "low_function": low_function_words(F.col("__tok")),
            "repeats": adjacent_repeat(F.col("__tok")),
        })
        .drop("__tok")
    )
