"""Near-equal names: candidate search without comparing all pairs, and its two users."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from cuestrata.functions import text as T
from cuestrata.session import stage

KEYS = ["recording_id"]
DIRECT = 64  # names of one recording and first letter that are simply compared with each other
CAPITAL = r"^[^\p{L}\p{N}]*+\p{Lu}"  # a white-space token that begins with a capital, behind its marks
OUTER = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"  # marks around a word


def near_pairs(words: DataFrame, keys: list[str], word: str, edits: Callable[[Column], Column], max_gap: int = 2) -> DataFrame:
    """Pairs (``a``, ``b``) of distinct words within an edit distance, per group and first letter.

    ``edits`` gives the number of edits allowed from the length of the longer word;
    length differences above ``max_gap`` are never similar.

    Exact by the pigeonhole principle: cut the shorter word, less its first letter, into
    ``edits + 1`` pieces; for some i, piece i occurs unchanged in the longer word with at
    most i edits before it and the rest behind it, which leaves few places to look.  Words
    only meet on such a piece, so no group of names is ever paired with itself.  Words of
    at most ``edits + 1`` letters have no such pieces and are left out (``_short_pairs``).

    Up to ``DIRECT`` words of one group and first letter have fewer pairs than pieces and are compared directly.
    """
    base = words.select(
        *keys, F.col(word).alias("__w"), F.length(word).alias("__len"), F.substring(word, 1, 1).alias("__c"))
    groups = [*keys, "__c"]
    large = stage(base.groupBy(*groups).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > DIRECT).select(*groups), "large")
    return _direct_pairs(base.join(large, groups, "left_anti"), keys, edits, max_gap).unionByName(
        _piece_pairs(base.join(large, groups, "left_semi"), keys, edits, max_gap))


def _direct_pairs(base: DataFrame, keys: list[str], edits: Callable[[Column], Column], max_gap: int) -> DataFrame:
    """``near_pairs`` of small groups, each word with each."""
    groups = [*keys, "__c"]
    left = base.select(*groups, F.col("__w").alias("__short_word"), "__len")
    right = base.select(*groups, F.col("__w").alias("__long_word"), F.col("__len").alias("__long"), edits(F.col("__len")).cast("int").alias("__d"))
    met = left.join(right.where("__d > 0"), groups).where(
        ((F.col("__len") < F.col("__long")) | ((F.col("__len") == F.col("__long")) & (F.col("__short_word") < F.col("__long_word"))))
        & (F.col("__len") > F.col("__d") + 1) & (F.col("__long") - F.col("__len") <= F.least(F.lit(max_gap), F.col("__d"))))
    return _within(met, keys).distinct()


def _within(met: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of words that have met, within the edits allowed."""
    return met.withColumn("edit_distance", F.levenshtein("__short_word", "__long_word")).where(
        F.col("edit_distance") <= F.col("__d")
    ).select(
        *keys, F.least("__short_word", "__long_word").alias("a"),
        F.greatest("__short_word", "__long_word").alias("b"), "edit_distance",
        F.col("__long").alias("longest"))


def _piece_pairs(base: DataFrame, keys: list[str], edits: Callable[[Column], Column], max_gap: int) -> DataFrame:
    """``near_pairs`` of large groups, by pieces."""
    def piece(i, parts, length):
        """Where piece ``i`` of a word begins and how long it is; the first letter is left out."""
        at = F.floor(i * (length - 1) / parts).cast("int")
        return at, F.floor((i + 1) * (length - 1) / parts).cast("int") - at

    allowed = F.array_distinct(F.transform(
        F.sequence(F.col("__len"), F.col("__len") + max_gap), lambda n: edits(n).cast("int")))
    index = (
        base.withColumn("__d", F.explode(allowed))
        .where((F.col("__d") > 0) & (F.col("__len") > F.col("__d") + 1))
        .withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__d"))))
    )
    at, size = piece(F.col("__i"), F.col("__d") + 1, F.col("__len"))
    index = index.select(
        *keys, "__c", "__d", "__len", "__i", F.col("__w").alias("__short_word"),
        F.substring(F.col("__w"), at + 2, size).alias("__piece"))

    probe = (
        base.withColumnRenamed("__len", "__long").withColumn("__d", edits(F.col("__long")).cast("int")).where("__d > 0")
        .withColumn("__len", F.explode(F.sequence(
            F.greatest(F.lit(1), F.col("__long") - F.least(F.lit(max_gap), F.col("__d"))), F.col("__long"))))
        .where(F.col("__len") > F.col("__d") + 1)
        .withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__d"))))
    )
    at, size = piece(F.col("__i"), F.col("__d") + 1, F.col("__len"))
    grown, behind = F.col("__long") - F.col("__len"), F.col("__d") - F.col("__i")
    probe = probe.withColumns({
        "__size": size, "__low": F.greatest(F.lit(0), at - F.col("__i"), at + grown - behind),
        "__end": F.least(at + F.col("__i"), at + grown + behind)})
    probe = probe.withColumn("__high", F.least(F.col("__long") - 1 - F.col("__size"), F.col("__end"))).where("__low <= __high")
    probe = probe.select(
        *keys, "__c", "__long", "__d", "__len", "__i", F.col("__w").alias("__long_word"),
        F.explode(F.array_distinct(F.transform(
            F.sequence(F.col("__low"), F.col("__high")),
            lambda k: F.substring(F.col("__w"), k + 2, F.col("__size"))))).alias("__piece"))

    met = index.join(probe, [*keys, "__c", "__d", "__len", "__i", "__piece"])
    met = met.where(
        (F.col("__short_word") != F.col("__long_word"))
        & ((F.col("__len") < F.col("__long")) | (F.col("__short_word") < F.col("__long_word"))))
    return _within(met.select(*keys, "__short_word", "__long_word", "__long", "__d").distinct(), keys)


def name_inconsistency(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Share of name mentions that look like a misspelling of another name."""
    names = cues.select(*keys, F.explode(T.titlecase_tokens("text")).alias("name"))
    counts = names.groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("freq"))
    counts = stage(counts.withColumn("__low", T.ascii_lower("name")), "names")
    # similarity of at least 0.78 on a longer length L allows L - ceil(0.78 L) edits
    pairs = near_pairs(counts, keys, "__low", lambda n: F.floor(n - F.ceil(n * 78 / 100)))
    fa = counts.select(*keys, F.col("__low").alias("a"), F.col("freq").alias("__fa"))
    fb = counts.select(*keys, F.col("__low").alias("b"), F.col("freq").alias("__fb"))
    shared = pairs.join(fa, [*keys, "a"]).join(fb, [*keys, "b"]).groupBy(*keys).agg(
        F.sum(F.least("__fa", "__fb")).alias("__odd"))
    mentions = counts.groupBy(*keys).agg(F.sum("freq").alias("mentions"))
    groups = cues.select(*keys).distinct()
    out = groups.join(mentions, keys, "left").join(shared, keys, "left")
    mentions_n = F.coalesce("mentions", F.lit(0))
    ratio = F.when(mentions_n < 4, 0.0).otherwise(F.least(F.lit(1.0), F.coalesce("__odd", F.lit(0)) / F.col("mentions")))
    return out.select(*keys, mentions_n.alias("mentions"), ratio.alias("name_inconsistency"))


def name_words(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Capitalised words with their counts, per recording."""
    return (
        cues.select(*keys, F.explode(F.split("text", f"{T.SPACE}+")).alias("__raw"))
        .where(F.col("__raw").rlike(CAPITAL))
        .select(*keys, F.regexp_replace("__raw", OUTER, "").alias("word"))
        .where(F.octet_length("word") >= 2)
        .groupBy(*keys, "word").agg(F.count(F.lit(1)).alias("freq"))
    )


def name_leaders(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Map each minor spelling to its leader: (keys, ``word``, ``canonical``).

    Words are ranked by (count desc, word asc).  Taken in that order, a word within two
    edits of an earlier leader follows the first such leader, otherwise it leads.  Neighbours share
    their first letter, so the pairs of one letter of a recording are streamed by the rank of
    their better word: once a word comes up, all that outrank it are settled.
    """
    words = stage(name_words(cues, keys), "words")
    near = near_pairs(words, keys, "word", lambda n: F.when(n > 0, 2)).where("edit_distance >= 1")
    short = _short_pairs(words, keys)
    near = near.select(*keys, "a", "b").union(short).distinct()
    fa = words.select(*keys, F.col("word").alias("a"), F.col("freq").alias("__fa"))
    fb = words.select(*keys, F.col("word").alias("b"), F.col("freq").alias("__fb"))
    edges = near.join(fa, [*keys, "a"]).join(fb, [*keys, "b"])
    a_first = (F.col("__fa") > F.col("__fb")) | ((F.col("__fa") == F.col("__fb")) & (F.col("a") < F.col("b")))
    edges = edges.select(
        *keys, F.substring("a", 1, 1).alias("__c"),
        F.when(a_first, F.col("__fa")).otherwise(F.col("__fb")).alias("__f"),
        F.when(a_first, F.col("a")).otherwise(F.col("b")).alias("canonical"),
        F.when(a_first, F.col("b")).otherwise(F.col("a")).alias("word"))
    ranked = edges.repartition(*keys, "__c").sortWithinPartitions(*keys, "__c", F.col("__f").desc(), "canonical")
    names = [*keys, "word", "canonical"]

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Followers of leaders; held are the followers of one letter of one recording."""
        group, follows = None, set()
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            keep = []
            for i, (*here, upper, lower) in enumerate(zip(*columns, strict=True)):
                if here != group:
                    group, follows = here, set()
                if upper not in follows and lower not in follows:
                    follows.add(lower)
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select(names)

    schema = T_.StructType([*(ranked.schema[k] for k in keys), T_.StructField("word", T_.StringType()), T_.StructField("canonical", T_.StringType())])
    return ranked.select(*keys, "__c", "canonical", "word").mapInArrow(settle, schema)


def _short_pairs(words: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs within two edits whose shorter word has at most three letters.

    Such words share what is left after deleting up to two letters behind the first.
    """
    base = words.where(F.length("word") <= 5).select(
        *keys, "word", F.substring("word", 1, 1).alias("__c"), F.substring("word", 2, 4).alias("__rest"))

    def drop_one(arr):
        return F.flatten(F.transform(arr, lambda s: F.transform(
            F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(s))),
            lambda i: F.concat(F.substring(s, F.lit(1), i - 1), F.substring(s, i + 1, F.length(s))))))

    once = F.array_distinct(F.concat(F.array("__rest"), drop_one(F.array("__rest"))))
    keyed = base.withColumn("__once", once).select(
        *keys, "__c", "word", F.explode(F.array_distinct(F.concat("__once", drop_one(F.col("__once"))))).alias("__k"))
    left = keyed.where(F.length("word") <= 3).withColumnRenamed("word", "a")
    right = keyed.withColumnRenamed("word", "b")
    met = left.join(right, [*keys, "__c", "__k"]).where(F.col("a") != F.col("b"))
    met = met.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return met.where(F.levenshtein("a", "b") <= 2)


def canonical_names(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Replace minor spellings of a name by their leader, as whole words.

    All words are replaced at once: a white-space token is looked up without its outer
    marks, and failing that by each run of letters and digits inside it ("Sakra's").
    """
    mapping = name_leaders(cues, keys)
    raw = F.regexp_extract_all(F.col("text"), F.lit(r"(\s+|\S+)"), F.lit(1))
    runs = F.regexp_extract_all(F.col("__raw"), F.lit(r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"), F.lit(1))
    core = F.regexp_replace(F.col("__raw"), OUTER, "")
    # words are cut at white space; places count the white space between them as well, as ``raw`` does
    words = cues.select(*keys, "pos", F.col("text").rlike(r"^\s").cast("int").alias("__lead"), F.posexplode(F.split("text", r"\s+")).alias("__k", "__raw"))
    units = words.where(F.col("__raw").rlike(r"\p{Lu}")).select(*keys, "pos", (2 * F.col("__k") - F.col("__lead")).alias("__i"), "__raw")
    units = units.select("*", F.explode(F.concat(
        F.array(F.struct(F.lit(-1).alias("j"), core.alias("w"))),
        F.transform(runs, lambda r, j: F.struct(j.alias("j"), r.alias("w"))))).alias("__u"))
    units = units.withColumns({"word": F.col("__u")["w"], "__j": F.col("__u")["j"]}).where(F.col("word").rlike(r"^\p{Lu}"))
    hits = units.join(mapping, [*keys, "word"]).groupBy(*keys, "pos", "__i").agg(
        F.any_value("__raw").alias("__raw"),
        F.map_from_entries(F.collect_list(F.struct("__j", "canonical"))).alias("__m"))
    whole = F.try_element_at("__m", F.lit(-1))
    head, tail = F.regexp_extract("__raw", r"^([^\p{L}\p{N}]*)", 1), F.regexp_extract("__raw", r"([^\p{L}\p{N}]*)$", 1)
    inner = F.array_join(F.transform(runs, lambda r, j: F.coalesce(F.try_element_at("__m", j), r)), "")
    hits = hits.withColumn("__new", F.when(whole.isNotNull(), F.concat(head, whole, tail)).otherwise(inner))
    fixes = hits.groupBy(*keys, "pos").agg(F.map_from_entries(F.collect_list(F.struct("__i", "__new"))).alias("__fixes"))
    rewritten = F.array_join(F.transform(raw, lambda p, i: F.coalesce(F.try_element_at("__fixes", i), p)), "")
    return cues.join(fixes, [*keys, "pos"], "left").withColumn(
        "text", F.when(F.col("__fixes").isNotNull(), rewritten).otherwise(F.col("text"))).drop("__fixes")
