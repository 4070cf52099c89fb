"""Word lists, rewrite rules, dictionaries and profile limits.

Every table in this module is data that results depend on.  Code elsewhere reads
it; nothing here computes.  Tables over text rules become small DataFrames through
``rule_frame`` so that callers may pass their own rows instead.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PROFILES = ("fast", "balanced", "strict")

# ---------------------------------------------------------------- fixed values
# Quality limits per profile.
RECORDING_LIMITS = {
    "fast": {"min_cues": 240, "max_top_line": 0.35, "max_overlap": 0.40, "min_non_empty": 0.65},
    "balanced": {"min_cues": 200, "max_top_line": 0.30, "max_overlap": 0.35, "min_non_empty": 0.70},
    "strict": {"min_cues": 80, "max_top_line": 0.20, "max_overlap": 0.25, "min_non_empty": 0.90},
}
CHUNK_LIMITS = {
    "fast": {"min_cues": 120, "max_top_line": 0.75, "max_overlap": 0.60, "min_non_empty": 0.60},
    "balanced": {"min_cues": 60, "max_top_line": 0.60, "max_overlap": 0.45, "min_non_empty": 0.70},
    "strict": {"min_cues": 30, "max_top_line": 0.45, "max_overlap": 0.35, "min_non_empty": 0.80},
}
SEMANTIC_LIMITS = {
    "fast": {
        "anomaly_ratio": 0.35, "malformed_ratio": 0.25, "low_function_ratio": 0.35,
        "adjacent_repeat_ratio": 0.30, "scene_low_ratio": 0.45, "name_inconsistency": 0.20,
    },
    "balanced": {
        "anomaly_ratio": 0.25, "malformed_ratio": 0.15, "low_function_ratio": 0.22,
        "adjacent_repeat_ratio": 0.18, "scene_low_ratio": 0.30, "name_inconsistency": 0.12,
    },
    "strict": {
        "anomaly_ratio": 0.03, "malformed_ratio": 0.01, "low_function_ratio": 0.08,
        "adjacent_repeat_ratio": 0.02, "scene_low_ratio": 0.04, "name_inconsistency": 0.03,
    },
}
TRANSLATION_FLOOR = {"fast": 0.58, "balanced": 0.68, "strict": 0.84}
CONFIDENCE_FLOOR = {"fast": 0.42, "balanced": 0.50, "strict": 0.56}
MONITOR_FLOOR = {"fast": 0.55, "balanced": 0.65, "strict": 0.75}
TAG_BIAS = {"fast": -0.04, "balanced": 0.0, "strict": 0.05}
SPEED_GPU = {"fast": 22.0, "balanced": 16.0, "strict": 10.0}
SPEED_CPU = {"fast": 1.4, "balanced": 1.0, "strict": 0.8}
HISTORY_ROWS = 400

# ---------------------------------------------------------------- fixed values
# Word lists.
FUNCTION_WORDS = [
    "the", "a", "an", "and", "or", "but", "if", "to", "of", "in", "on", "for", "with", "is", "are", "was",
    "were", "be", "been", "being", "i", "you", "he", "she", "it", "we", "they", "me", "my", "your", "our",
    "their", "this", "that", "these", "those", "not", "do", "did", "does", "have", "has", "had", "can",
    "could", "will", "would", "should", "as", "at", "from",
]
MALFORMED = [
    "i'm's", "you're's", "we're's", "they're's", "he's's",
    "she's's", "it's's", "let's's", "i'm be", "i'm let",
]
INTERJECTIONS = [
    "oh my god", "huh", "what", "yeah", "wait", "wait a minute", "hold on a second",
]
QUESTION_LOOP = ["what's", "what", "matter", "mean"]
HARD_TAGS = ["scene_hard", "cue_fast", "cue_exclaim", "overlap_risk", "rapid_dialogue"]

# ---------------------------------------------------------------- fixed values
# Case-insensitive literal rewrites, applied in this order.
CONTRACTION_RULES = [
    ("I'm's", "I'm"), ("you're's", "you're"), ("we're's", "we're"),
    ("they're's", "they're"), ("he's's", "he's"), ("she's's", "she's"),
    ("it's's", "it's"), ("let's's", "let's"), ("I'm'll", "I'll"),
    ("This's", "This is"), ("this's", "this is"),
]
PHRASE_RULES = [
    ("This's right", "That's right"), ("this's right", "that's right"),
    ("This's it", "This is it"), ("this's it", "this is it"),
    ("The's", "There's"), ("the's", "there's"),
    ("It's be", "It's"), ("it's be", "it's"),
    ("It's hasn't", "It hasn't"), ("it's hasn't", "it hasn't"),
    ("I'm be", "I'll be"), ("I'm let", "I'll let"), ("I'm got", "I've got"),
    ("I'm take", "I'll take"), ("I'm leave", "I'll leave"), ("I'm tell", "I'll tell"),
    ("I'm give", "I'll give"), ("I'm like to", "I'd like to"), ("i'm like to", "i'd like to"),
    ("I'm do", "I do"), ("i'm do", "i do"),
    ("I'm put it", "I'm putting it"), ("i'm put it", "i'm putting it"),
    ("I was asked him", "I asked him"), ("i was asked him", "i asked him"),
    ("puttingting", "putting"),
    ("I'll been", "I've been"), ("i'll been", "i've been"),
    ("Well're's", "Where's"), ("well're's", "where's"),
    ("Well're", "We're"), ("well're", "we're"),
    ("Whoa're's", "Where's"), ("whoa're's", "where's"),
    ("Whoa're", "We're"), ("whoa're", "we're"),
    ("What're's", "Where's"), ("what're's", "where's"),
    ("What're was", "Where was"), ("what're was", "where was"),
    ("How's we", "How do we"), ("how's we", "how do we"),
]
# Rewrites of a line's beginning: exact case, at most one of each pair.
LINE_START_RULES = [
    ("All I'm ", "I'm "), ("all i'm ", "i'm "),
    ("All I think ", "I think "), ("all i think ", "i think "),
]
POSSESSIVE_RULES = [("'s's", "'s")]
GRAMMAR_RULES = [
    ("I'm was", "I was"), ("I'm were", "I was"), ("I'm had", "I had"),
    ("I'm has", "I have"), ("I'm have", "I have"), ("I'm did", "I did"),
    ("I'm done", "I've done"), ("I'm said", "I said"), ("I'm asked", "I asked"),
    ("I'm ask", "I ask"), ("I'm get", "I get"), ("I'm got", "I've got"),
    ("I'm see", "I see"), ("I'm know", "I know"), ("I'm need", "I need"),
    ("I'm want", "I want"), ("I'm love", "I love"), ("I'm think", "I think"),
    ("I'm thought", "I thought"), ("I'm make", "I make"), ("I'm made", "I made"),
    ("I'm looks", "It looks"), ("I'm look", "I look"), ("I'm scary", "I'm scared"),
]

# ---------------------------------------------------------------- fixed values
# Whole-line and in-line dictionaries, Japanese to English.
EXACT_PHRASES = [
    ("こんにちは", "hello"), ("こんばんは", "good evening"),
    ("おはよう", "good morning"), ("おはようございます", "good morning"),
    ("ありがとう", "thank you"), ("ありがとうございます", "thank you"),
    ("すみません", "excuse me"), ("ごめんなさい", "I'm sorry"),
    ("はい", "yes"), ("いいえ", "no"), ("行こう", "let's go"),
    ("大丈夫", "it's okay"), ("危ない", "watch out"), ("何", "what"),
]
INLINE_PHRASES = [
    ("です", "is"), ("でした", "was"), ("ます", ""), ("ません", "not"),
    ("ありがとう", "thank you"), ("ございます", ""), ("すみません", "excuse me"),
    ("ごめんなさい", "I'm sorry"), ("こんにちは", "hello"), ("こんばんは", "good evening"),
    ("おはよう", "good morning"), ("危ない", "watch out"), ("大丈夫", "it's okay"),
    ("行こう", "let's go"), ("行く", "go"), ("来て", "come"), ("待って", "wait"),
    ("お願い", "please"), ("何", "what"), ("誰", "who"), ("どこ", "where"),
    ("なぜ", "why"), ("私", "I"), ("あなた", "you"),
]
SHORT_CUES = [
    ("え", "Huh?"), ("えっ", "Huh?"), ("えぇ", "Huh?"), ("あれ", "Huh?"), ("あれっ", "Huh?"),
    ("はい", "Yeah."), ("うん", "Yeah."), ("うんうん", "Yeah."),
    ("ほんと", "Really?"), ("ほんとう", "Really?"), ("本当", "Really?"),
    ("で", "And?"), ("ちょっと", "Wait."), ("待って", "Wait."), ("ちょっと待って", "Wait."),
    ("待って待って", "Wait, wait."), ("ありがとう", "Thank you."),
    ("ありがとうございます", "Thank you."), ("行くか", "Let's go."),
    ("せーの", "Ready..."), ("せーのー", "Ready..."),
]
SHORT_CUE_STRIP = "。、！？!?….,，・ー-～~「」『』（）()　"
EXACT_STRIP = "。！？"
LANG_CODES = [
    ("ja", "jpn_Jpan"), ("jpn", "jpn_Jpan"), ("en", "eng_Latn"), ("eng", "eng_Latn"),
    ("zh", "zho_Hans"), ("zho", "zho_Hans"), ("cmn", "zho_Hans"),
    ("ko", "kor_Hang"), ("kor", "kor_Hang"), ("es", "spa_Latn"), ("spa", "spa_Latn"),
    ("fr", "fra_Latn"), ("fra", "fra_Latn"), ("de", "deu_Latn"), ("deu", "deu_Latn"),
    ("pt", "por_Latn"), ("por", "por_Latn"), ("ru", "rus_Cyrl"), ("rus", "rus_Cyrl"),
    ("ar", "arb_Arab"), ("ara", "arb_Arab"), ("hi", "hin_Deva"), ("hin", "hin_Deva"),
    ("it", "ita_Latn"), ("ita", "ita_Latn"), ("th", "tha_Thai"), ("tha", "tha_Thai"),
    ("vi", "vie_Latn"), ("vie", "vie_Latn"), ("tr", "tur_Latn"), ("tur", "tur_Latn"),
    ("pl", "pol_Latn"), ("pol", "pol_Latn"), ("nl", "nld_Latn"), ("nld", "nld_Latn"),
    ("sv", "swe_Latn"), ("swe", "swe_Latn"),
]
PLACEHOLDER_MARKS = ["(simulated) subtitle #", "ai processing..."]


def rule_frame(spark: SparkSession, rows, names=("source", "target")) -> DataFrame:
    """A rule table as a DataFrame, with ``ord`` giving the order of application."""
    schema = "ord int, " + ", ".join(f"{n} string" for n in names)
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], schema)


def limits_frame(spark: SparkSession, limits: dict) -> DataFrame:
    """Profile limits as a table with one row per profile."""
    names = list(next(iter(limits.values())))
    schema = "profile string, " + ", ".join(f"{n} double" for n in names)
    rows = [(p, *[float(v[n]) for n in names]) for p, v in limits.items()]
    return spark.createDataFrame(rows, schema)
