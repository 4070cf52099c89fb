from pyspark.sql import functions as F

from cuestrata.functions import repair as R
from cuestrata.functions import text as T


def one(spark, fn, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    return [r.text for r in fn(df).orderBy("i").collect()]


def test_contractions_follow_rule_order(spark):
    assert one(
        spark, R.repair_contractions, "I'm's here and I'm let you know.",
        "This's right. This's it. It's hasn't done, it's be weird.", "All I'm tired", "cost: $5 \\ I'm doing",
    ) == ["I'm here and I'll let you know.", "This is right. This is it. It hasn't done, It's weird.", "I'm tired", "cost: $5 \\ I doing"]


def test_word_boundary_option_spares_longer_words(spark):
    assert one(spark, lambda d: R.repair_contractions(d, word_boundary=True), "I'm doing") == ["I'm doing"]


def test_grammar(spark):
    assert one(spark, R.repair_grammar, "I'm was wrong. I'm had enough. I'm looks fine.") == ["I was wrong. I had enough. It looks fine."]


def test_token_loops(spark):
    assert one(spark, R.collapse_token_loops, "go go go now now", "wait a wait a second", "a b a b a b", "x") == [
        "go now", "wait a second", "a b a b", "x"]


def test_sentence_repeats_keep_two(spark):
    assert one(spark, R.collapse_repetitions, "Go. go! GO? Now.", "Go. Go.") == ["Go. go. Now", "Go. Go."]


def test_tidy_and_capitals(spark):
    assert one(spark, R.tidy, " a  ()\n b ( ) ") == ["a  b"]
    assert one(spark, R.capitalise_lines, "one\n  two\nÉx") == ["One\n  Two\nÉx"]


def test_dictionary(spark):
    df = spark.createDataFrame([("こんにちは",), ("私 です",), ("plain",), (" ",)], "text string")
    assert [r.text for r in R.dictionary_translate(df).collect()] == ["hello", "I is", "plain", " "]
    assert [r.text for r in R.dictionary_translate(df, target_lang="fr").collect()][0] == "こんにちは"


def test_short_cues(spark):
    df = spark.createDataFrame([("え？", "a"), ("待って待って", "b"), ("なにか", "c")], "src string, tgt string")
    assert [r.tgt for r in R.repair_short_cues(df).collect()] == ["Huh?", "Wait, wait.", "c"]


def test_flags(spark):
    df = spark.createDataFrame([
        ("I'm's going to the shop",), ("wait a wait a minute",), ("no no no no",), ("zq xw ty uu oo pp ll",), ("it''s",)], "text string")
    got = T.text_features(df).collect()
    assert [r.malformed for r in got] == [True, False, False, False, True]
    assert [r.repeats for r in got] == [False, True, True, False, False]
    assert [r.low_function for r in got] == [False, False, False, True, False]


def test_similarity_counts_code_points(spark):
    df = spark.createDataFrame([("été", "eté"), ("", ""), ("abc", "")], "a string, b string")
    got = [round(r.similarity, 4) for r in T.add_similarity(df, "a", "b").collect()]
    assert got == [0.6667, 1.0, 0.0]


def test_f1_and_char_similarity(spark):
    df = spark.createDataFrame([("a a b", "a b b c"), ("", ""), ("x", "y"), ("Same", "sAME")], "a string, b string")
    got = T.add_char_similarity(T.add_token_f1(df, "a", "b"), "a", "b").collect()
    assert [round(r.token_f1, 4) for r in got] == [0.5714, 1.0, 0.0, 1.0]
    from difflib import SequenceMatcher
    assert round(got[0].char_similarity, 6) == round(SequenceMatcher(None, "a a b", "a b b c").ratio(), 6)
    assert got[3].char_similarity == 1.0


def test_repeated_ngram_needs_distance(spark):
    df = spark.createDataFrame([(1, "a b c a b c"), (2, "a a a a"), (3, "a b c d")], "id int, text string")
    got = {r.id: r.repeated_ngram for r in T.repeated_ngram(df, ["id"]).collect()}
    assert got == {1: True, 2: False, 3: False}


def test_wide_space_counts_as_space(spark):
    df = spark.createDataFrame([("a　b",)], "text string")
    assert df.select(T.collapse("text")).first()[0] == "a b"
    assert df.select(F.length(T.source_key("text"))).first()[0] == 2
