"""One wording per repeated source phrase."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuestrata.functions import text as T

KEYS = ["recording_id"]


def _rewrite(original: Column, canonical: Column) -> Column:
    """``canonical`` with the original's initial capital and closing marks."""
    capital = T.strip(original).rlike("^[A-Z]")
    first = F.substring(canonical, 1, 1)
    raised = F.when(capital & first.rlike("[a-z]"), F.concat(F.upper(first), F.substring(canonical, F.lit(2), F.length(canonical))))
    raised = F.coalesce(raised, canonical)
    marks = F.regexp_extract(T.strip(original), r"([.!?]*)$", 1)
    return F.when((marks == "") | raised.endswith(marks), raised).otherwise(F.concat(raised, marks))


def phrase_consistency(
    pairs: DataFrame, keys: list[str] = KEYS, order: list[str] | None = None, lang: str = "en", min_cues: int = 4,
    source_bytes: tuple[int, int] = (2, 64), target_words: int = 10,
) -> DataFrame:
    """Rewrite stray wordings of a source phrase to the most used one.

    A phrase has ``source_bytes`` bytes (least, most) and at most ``target_words`` words in its
    wording; longer lines are sentences, which are not made alike.
    ``pairs`` has ``src`` and ``tgt`` of each cue.  Adds ``new_tgt`` and ``rewritten``.
    Phrases are counted by (source, wording) first, so a phrase repeated everywhere is
    folded before it is shuffled.
    """
    if lang.lower() != "en":
        return pairs.withColumns({"new_tgt": F.col("tgt"), "rewritten": F.lit(False)})
    at = F.struct(*(order or ["pos"]))
    df = pairs.withColumns({"__s": T.source_key("src"), "__t": T.target_key("tgt"), "__d": T.collapse("tgt")})
    usable = (F.octet_length("__s").between(*source_bytes)) & (F.col("__t") != "") & (T.word_count("__t") <= target_words)
    wordings = df.where(usable).groupBy(*keys, "__s", "__t").agg(
        F.count(F.lit(1)).alias("__n"), F.min_by("__d", at).alias("__d"))
    top = F.min(F.struct((-F.col("__n")).alias("n"), F.col("__t").alias("t"), F.col("__d").alias("d")))
    phrases = wordings.groupBy(*keys, "__s").agg(
        F.sum("__n").alias("__all"), F.count(F.lit(1)).alias("__var"), top.alias("__top"))
    enough = (F.col("__all") >= 3) & (F.col("__var") >= 2) & (-F.col("__top.n") / F.col("__all") >= 0.50)
    sized = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("__cues")).where(F.col("__cues") >= min_cues)
    canonical = phrases.where(enough).join(sized, keys, "left_semi").select(
        *keys, "__s", F.col("__top.d").alias("__canon"), T.target_key("__top.d").alias("__ck"))
    # only short sources can be phrases; all other rows stay where they are
    phrase = F.coalesce(F.octet_length("__s").between(*source_bytes), F.lit(False))
    out = df.where(phrase).join(canonical, [*keys, "__s"], "left")
    words = lambda c: T.word_count(c)
    cur, canon = F.col("__t"), F.col("__ck")
    short = (words("__t") <= 4) & (words("__ck") <= 4) & (cur.startswith(canon) | canon.startswith(cur))
    stray = canon.isNotNull() & (cur != "") & (canon != "") & (cur != canon)
    change = F.coalesce(stray & (T.similar(cur, canon, 0.60) | short), F.lit(False))
    told = out.select(
        *pairs.columns, F.when(change, _rewrite(F.col("tgt"), F.col("__canon"))).otherwise(F.col("tgt")).alias("new_tgt"), change.alias("rewritten"))
    rest = df.where(~phrase).select(*pairs.columns, F.col("tgt").alias("new_tgt"), F.lit(False).alias("rewritten"))
    return told.unionByName(rest)
