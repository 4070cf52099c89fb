"""Rule-based text repair; each rule table is data and is applied in its order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestrata import rules
from cuestrata.functions import text as T


def _quote(literal: str) -> str:
    return "(?i)\\Q" + literal + "\\E"


def _replace_all(c: Column, pairs, word_boundary: bool = False) -> Column:
    """Case-insensitive literal replacements, one after the other.

    Each rule is first looked for in the small letters, as bytes; only a text that holds its literal goes
    through its pattern.  A text without an apostrophe, which nearly all literals have, and without one of the
    other literals is in no rule and is left alone.
    """
    bare = [source.lower() for source, _ in pairs if "'" not in source]
    before, after = ("(?<![A-Za-z0-9'])", "(?![A-Za-z0-9'])") if word_boundary else ("", "")
    table = F.array(*[F.struct(
        F.lit(source.lower()).alias("low"), F.lit(before + _quote(source) + after).alias("pattern"),
        F.lit(target.replace("\\", "\\\\").replace("$", "\\$")).alias("target")) for source, target in pairs])

    def both(text):
        return F.struct(text.alias("t"), F.lower(text).alias("low"))

    def one(acc, rule):
        new = F.regexp_replace(acc["t"], rule["pattern"], rule["target"])
        return F.when(F.contains(acc["low"], rule["low"]), T.let(new, both)).otherwise(acc)

    def worked(text):
        held = reduce(lambda so_far, literal: so_far | F.lower(text).contains(literal), bare, text.contains("'"))
        return F.when(held, F.aggregate(table, both(text), one)["t"]).otherwise(text)

    return T.let(c, worked)


def repair_contractions_expr(c: Column | str, word_boundary: bool = False) -> Column:
    out = _replace_all(T.col(c), rules.CONTRACTION_RULES, word_boundary)
    out = _replace_all(out, rules.PHRASE_RULES, word_boundary)
    for upper, lower in (rules.LINE_START_RULES[:2], rules.LINE_START_RULES[2:]):
        # the two spellings exclude each other, so one pattern replaces at most one of them
        for source, target in (upper, lower):
            out = F.regexp_replace(out, "^\\Q" + source + "\\E", target)
    return _replace_all(out, rules.POSSESSIVE_RULES)


def repair_contractions(df: DataFrame, text_col: str = "text", word_boundary: bool = False) -> DataFrame:
    """Rewrite malformed contractions.  By default rules match inside words as well."""
    return df.withColumn(text_col, repair_contractions_expr(text_col, word_boundary))


def repair_grammar_expr(c: Column | str, word_boundary: bool = False) -> Column:
    return _replace_all(T.col(c), rules.GRAMMAR_RULES, word_boundary)


def repair_grammar(df: DataFrame, text_col: str = "text", word_boundary: bool = False) -> DataFrame:
    return df.withColumn(text_col, repair_grammar_expr(text_col, word_boundary))


def collapse_repetitions_expr(c: Column | str) -> Column:
    """Of three or more sentences keep each at most twice; end marks go if any is dropped."""
    text = T.col(c)
    parts = F.filter(F.transform(F.split(text, "[.!?]"), T.strip), lambda s: s != "")
    keyed = F.transform(parts, lambda s, i: F.struct(F.lower(s).alias("k"), i.alias("i"), s.alias("s")))

    def kept(ordered):
        # sorted by (key, place), a sentence is a third copy if its key stands two places earlier
        left = F.filter(ordered, lambda s, i: (i < 2) | (ordered[F.greatest(i - 2, F.lit(0))]["k"] != s["k"]))
        return F.struct(F.size(ordered).alias("n"), left.alias("left"))

    def finish(r):
        back = F.array_sort(F.transform(r["left"], lambda s: F.struct(s["i"].alias("i"), s["s"].alias("s"))))
        joined = F.array_join(F.transform(back, lambda s: s["s"]), ". ")
        return F.when((r["n"] < 3) | (F.size(r["left"]) == r["n"]), text).otherwise(joined)

    return T.let(T.let(F.array_sort(keyed), kept), finish)


def collapse_repetitions(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn(text_col, collapse_repetitions_expr(text_col))


#: All but small letters, digits, apostrophe and space, as ranges: negated, the class takes ten times as long.
MARK = r"[\x00-\x1F!-&(-/:-`{-\x{10FFFF}]"
#: Marks around the letters of a token; a token of marks alone keeps them.
AROUND = rf"(?={MARK})(?:(?<![^ ]){MARK}++(?=[a-z0-9'])|(?<=[a-z0-9']){MARK}++(?![^ ]))"
#: A key that comes twice in a row, or two keys that do.
AGAIN = r"(?<![^ ])([^ ]++(?: [^ ]++)?) \1(?![^ ])"


def collapse_token_loops_expr(c: Column | str) -> Column:
    """Drop a token equal to the one before, then turn non-overlapping A B A B into A B.

    Equal neighbours share one key, so comparing with the row before is the same as with
    the token kept last.  In the second pass, a token is the first of a loop if it equals
    the token two ahead and its follower does too; loops that overlap an earlier loop are
    left alone, which depends only on the place inside a stretch of such tokens, so whole stretches are
    handled at once and a line costs time in proportion to its length.
    """
    def drop_repeats(ts):
        return F.filter(ts, lambda t, i: (i == 0) | (ts[F.greatest(i - 1, F.lit(0))]["k"] != t["k"]))

    def drop_loops(once):
        n = F.size(once)
        heads = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.when(
            i + 3 < n, (once[i]["k"] == once[i + 2]["k"]) & (once[i + 1]["k"] == once[i + 3]["k"])).otherwise(False))

        def stretches(hs):
            """First and last of each run of heads without a gap."""
            firsts = F.filter(hs, lambda h, i: (i == 0) | (hs[F.greatest(i - 1, F.lit(0))] != h - 1))
            lasts = F.filter(hs, lambda h, i: (i == F.size(hs) - 1) | (hs[F.least(i + 1, F.size(hs) - 1)] != h + 1))
            return F.arrays_zip(firsts.alias("first"), lasts.alias("last"))

        start = F.struct(F.lit(0).alias("skip"), F.array().cast("array<struct<a:int,b:int>>").alias("taken"))

        def step(acc, s):
            """Every fourth head of a stretch is taken, from the first one behind the loop before."""
            enter = F.greatest(acc["skip"], s["first"])
            there = enter <= s["last"]
            return F.struct(
                F.when(there, s["last"] - (s["last"] - enter) % 4 + 4).otherwise(acc["skip"]).alias("skip"),
                F.when(there, F.concat(acc["taken"], F.array(F.struct(enter.alias("a"), s["last"].alias("b"))))).otherwise(acc["taken"]).alias("taken"))

        def without(taken):
            gone = F.flatten(F.transform(taken, lambda t: F.flatten(F.transform(F.sequence(t["a"], t["b"], F.lit(4)), lambda i: F.array(i + 2, i + 3)))))
            return F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), n - 1), gone), lambda i: once[i]["t"]), " ")

        return T.let(F.aggregate(T.let(heads, stretches), start, step)["taken"], without)

    def worked(line):
        toks = F.arrays_zip(F.split(line["flat"], " ").alias("t"), F.split(line["keyed"], " ").alias("k"))
        return T.let(T.let(toks, drop_repeats), drop_loops)

    def line(text):
        # the keys of all tokens come from one pass over the line
        return T.let(T.collapse(text), lambda flat: F.struct(
            text.alias("text"), flat.alias("flat"), F.regexp_replace(T.ascii_lower(flat), AROUND, "").alias("keyed")))

    # most lines repeat nothing and need no array
    return T.let(T.let(T.col(c), line), lambda s: F.when(~F.contains(s["flat"], F.lit(" ")), s["text"]).when(
        ~s["keyed"].rlike(AGAIN), s["flat"]).otherwise(worked(s)))


def collapse_token_loops(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn(text_col, collapse_token_loops_expr(text_col))


def tidy_expr(c: Column | str) -> Column:
    flat = T.collapse(c)
    return T.strip(F.replace(F.replace(flat, F.lit("()"), F.lit("")), F.lit("( )"), F.lit("")))


def tidy(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn(text_col, tidy_expr(text_col))


def capitalise_lines_expr(c: Column | str) -> Column:
    lines = F.split(F.regexp_replace(F.regexp_replace(T.col(c), "\r\n", "\n"), "\n$", ""), "\n")

    def raised(line):
        lead = F.regexp_extract(line, f"^({T.WS}*)", 1)
        at = F.length(lead) + 1
        first = F.substring(line, at, F.lit(1))
        return F.when(first.rlike("[a-z]"), F.concat(
            lead, F.upper(first), F.substring(line, at + 1, F.length(line)))).otherwise(line)

    return F.array_join(F.transform(lines, raised), "\n")


def capitalise_lines(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn(text_col, capitalise_lines_expr(text_col))


def can_merge_expr(left: Column | str, right: Column | str) -> Column:
    """May two neighbouring cue texts become one?"""
    a, b = T.strip(left), T.strip(right)
    blocked = (
        F.concat(a, b).rlike(r"[\[\]]") | (T.word_count(a) > 8) | (T.word_count(b) > 8)
        | b.rlike("^[A-Z]") | a.rlike("[.?!:]$"))
    return (T.col(left) != "") & (T.col(right) != "") & ~blocked


def merge_expr(left: Column | str, right: Column | str) -> Column:
    a = T.strip_right(left)
    b = T.strip_left(right)
    return F.when(a == "", b).when(b == "", a).otherwise(F.concat_ws(" ", a, b))


def _own(table: DataFrame) -> DataFrame:
    """The library's rule tables are short and are broadcast; a caller's table is left to the optimiser."""
    return F.broadcast(table)


def dictionary_translate(
    df: DataFrame, source_lang: Column | str = "ja", target_lang: str = "en", text_col: str = "text",
    exact: DataFrame | None = None, inline=rules.INLINE_PHRASES,
) -> DataFrame:
    """Translate by dictionary: a whole line if known, else ordered in-line replacements."""
    if target_lang.lower() != "en":
        return df
    exact = _own(rules.rule_frame(df.sparkSession, rules.EXACT_PHRASES)) if exact is None else exact
    lang = source_lang if isinstance(source_lang, Column) else F.lit(source_lang)
    text = F.col(text_col)
    wanted = (lang.isin("ja", "jpn") | T.has_japanese(text_col)) & (T.strip(text_col) != "")
    replaced = reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), inline, text)
    known = exact.select(F.col("source").alias("__k"), F.col("target").alias("__hit"))
    out = df.withColumn("__k", T.exact_key(text_col)).join(known, "__k", "left")
    new = F.coalesce(F.col("__hit"), F.when(replaced == text, text).otherwise(T.collapse(replaced)))
    return out.withColumn(text_col, F.when(wanted, new).otherwise(text)).select(*df.columns)


def repair_short_cues(
    pairs: DataFrame, source_col: str = "src", target_col: str = "tgt", table: DataFrame | None = None
) -> DataFrame:
    """Replace the translation of well-known short source lines."""
    table = _own(rules.rule_frame(pairs.sparkSession, rules.SHORT_CUES)) if table is None else table
    known = table.select(F.col("source").alias("__k"), F.col("target").alias("__hit"))
    out = pairs.withColumn("__k", T.short_cue_key(source_col)).join(known, "__k", "left")
    return out.withColumn(target_col, F.coalesce("__hit", target_col)).select(*pairs.columns)


def normalise_lang(df: DataFrame, code_col: str = "lang", table: DataFrame | None = None) -> DataFrame:
    """Add ``lang_tag``: the model's tag of a language code, unknown codes unchanged."""
    table = _own(rules.rule_frame(df.sparkSession, rules.LANG_CODES, ("code", "tag"))) if table is None else table
    known = table.select(F.col("code").alias("__c"), F.col("tag").alias("__tag"))
    out = df.withColumn("__c", F.lower(code_col)).join(known, "__c", "left")
    return out.withColumn("lang_tag", F.coalesce(F.col("__tag"), F.col(code_col))).drop("__c", "__tag")


def clean_translation(cues: DataFrame, keys: list[str] = ("recording_id",)) -> DataFrame:
    """All repairs in their order: names, contractions, grammar, loops, spacing, capitals."""
    from cuestrata.operators.names import canonical_names

    df = canonical_names(cues, list(keys))
    df = repair_grammar(repair_contractions(df))
    df = tidy(collapse_token_loops(collapse_repetitions(df)))
    return capitalise_lines(df)
