"""Timed-text tables derived from the driver's tables, for queries and the bench.

Every view is a rule over whole base tables; the same rule is stated in SQL in
``oracle.py``.  One document is one recording and one of its lines is one cue.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuestrata.functions import text as T
from cuestrata.operators.ordered import scan
from cuestrata.session import stage


SCHEMAS = {
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "pages": "page_id BIGINT, url STRING, html STRING",
    "conversations": "conv_id BIGINT, turn BIGINT, role STRING, text STRING",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf.rstrip('/')}/{name}.parquet")


_TABLES: dict[tuple[str, str], DataFrame] = {}


def cues(spark, sf, extra: tuple[str, ...] = ()) -> DataFrame:
    """recording_id, pos, start_ms, end_ms, text, lang (and ``source``).

    The canonical cue table: derived from ``documents`` once per session, written to the
    shared folder clustered by recording, and read from there by every query.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TABLES:
        _TABLES[key] = stage(derive_cues(spark, sf), "cues")
    return _TABLES[key].select("recording_id", "pos", "start_ms", "end_ms", "text", "lang", *extra)


def derive_cues(spark, sf) -> DataFrame:
    docs = table(spark, sf, "documents")
    lines = docs.select(
        F.col("doc_id").alias("recording_id"), "lang", "source", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("text", F.trim("line"))
    dur = F.greatest(F.lit(300), F.length("text") * 66).cast("bigint")
    gap = (((F.col("recording_id") * 7 + F.col("pos") * 13) % 10 - 1) * 250).cast("bigint")
    # the lines of one recording came out of one row of ``documents``
    upto = "PARTITION BY recording_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    timed = lines.withColumns({"dur": dur, "gap": gap}).withColumn(
        "start_ms", F.expr(f"CAST(coalesce(sum(dur + gap) OVER ({upto}), 0) AS BIGINT)"))
    return timed.select(
        "recording_id", "pos", "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"), "text", "lang", "source")


def source_cues(spark, sf) -> DataFrame:
    """All documents of a source one after the other, as one recording."""
    c = cues(spark, sf, ("source",))
    day = F.col("recording_id") * 100_000_000
    return c.select(
        F.col("source").alias("recording_id"), (F.col("recording_id") * 1_000_000 + F.col("pos")).alias("pos"),
        (F.col("start_ms") + day).alias("start_ms"), (F.col("end_ms") + day).alias("end_ms"), "text")


def ref_cues(spark, sf) -> DataFrame:
    return cues(spark, sf).where("pos % 4 <> 1")


def hyp_cues(spark, sf) -> DataFrame:
    return cues(spark, sf).where("pos % 11 <> 10").selectExpr(
        "recording_id", "pos", "greatest(0, start_ms + ((recording_id + pos) % 5 - 2) * 100) AS start_ms",
        "end_ms + ((recording_id + pos) % 3 - 1) * 100 AS end_ms", "CASE WHEN pos % 3 = 0 THEN lower(text) ELSE text END AS text")


def chunk_cues(spark, sf) -> DataFrame:
    c = cues(spark, sf).withColumn("k", F.floor(F.col("start_ms") / 30000))
    first = c.selectExpr(
        "recording_id", "CAST(k AS INT) AS chunk_index", "pos", "start_ms - k * 30000 AS start_ms", "end_ms - k * 30000 AS end_ms", "text")
    again = c.where("start_ms % 30000 >= 28000").selectExpr(
        "recording_id", "CAST(k AS INT) + 1 AS chunk_index", "pos", "start_ms + 200 - (k + 1) * 30000 AS start_ms",
        "end_ms + 200 - (k + 1) * 30000 AS end_ms", "text")
    return first.unionByName(again)


def chunk_offsets(chunks: DataFrame) -> DataFrame:
    return chunks.select("recording_id", "chunk_index").distinct().withColumn(
        "offset_ms", F.col("chunk_index").cast("bigint") * 30000)


def asr_segments(spark, sf) -> DataFrame:
    return cues(spark, sf).where("pos % 7 <> 3").selectExpr(
        "recording_id", "pos", "start_ms + (pos % 3) * 100 AS start_ms", "end_ms + (pos % 2) * 400 AS end_ms",
        "-1.0e0 * ((recording_id + pos * 3) % 20) / 10 AS avg_logprob", "((recording_id * 3 + pos) % 10) / 10.0e0 AS no_speech_prob",
        "1.0e0 + ((recording_id + pos) % 8) / 4.0e0 AS compression_ratio", "((recording_id + pos * 7) % 10) / 10.0e0 AS word_prob_mean",
        "((recording_id * 5 + pos) % 10) / 10.0e0 AS low_word_prob_ratio")


def pairs(spark, sf) -> DataFrame:
    return cues(spark, sf).selectExpr(
        "lang AS recording_id", "recording_id AS doc_id", "pos", "concat('w', CAST(length(text) % 20 AS STRING)) AS src",
        "CASE WHEN (recording_id + pos) % 5 = 0 THEN concat('Line n', CAST(length(text) % 20 AS STRING), ' xx.') "
        "ELSE concat('Line n', CAST(length(text) % 20 AS STRING), '.') END AS tgt")


def run_log(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS run_id", "o_orderdate AS ts",
        "CASE WHEN o_custkey % 3 = 0 THEN 'none' WHEN o_custkey % 3 = 1 THEN 'cuda' ELSE 'rocm' END AS gpu_backend",
        "CAST((o_custkey % 4) * 4096 AS BIGINT) AS gpu_vram_mb", "CAST(1 + o_custkey % 32 AS INT) AS cpu_cores",
        "CAST(2048 * (1 + o_custkey % 16) - 1 AS BIGINT) AS total_ram_mb", "substr(o_orderpriority, 1, 1) AS source_lang",
        "'en' AS target_lang", "o_orderstatus AS input_kind", "o_orderstatus <> 'F' AS success", "o_totalprice / 1000 AS elapsed_secs",
        "CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 100 END AS audio_duration_secs",
        "(o_orderkey % 100) / 100.0e0 AS avg_difficulty", "CAST(o_orderkey % 40 AS INT) AS scene_count",
        "concat('plan-', CAST(o_orderkey % 17 AS STRING)) AS plan",
        "concat('dev', CAST(o_custkey % 5 AS STRING)) AS device_fingerprint",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'fast' ELSE 'strict' END AS quality_profile",
        "concat('h', CAST(o_orderkey % 4 AS STRING)) AS content_profile_hash",
        "CAST(o_orderkey % 200 AS INT) AS output_cues", "CASE WHEN o_orderkey % 7 = 0 THEN 0.5e0 ELSE 0.9e0 END AS output_non_empty_ratio",
        "(o_orderkey % 50) / 100.0e0 AS output_top_line_ratio")


def run_queries(spark, sf) -> DataFrame:
    """Every order as a workload that asks for a plan."""
    return table(spark, sf, "orders").selectExpr(
        "o_orderkey AS query_id", "substr(o_orderpriority, 1, 1) AS source_lang", "'EN' AS target_lang", "o_orderstatus AS input_kind",
        "CASE WHEN o_orderkey % 2 = 0 THEN 'fast' ELSE 'strict' END AS quality_profile",
        "concat('h', CAST(o_custkey % 4 AS STRING)) AS content_profile_hash",
        "concat('dev', CAST(o_orderkey % 5 AS STRING)) AS device_fingerprint",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'cuda' ELSE 'rocm' END AS backend",
        "CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST((1 + o_custkey % 3) * 4096 AS BIGINT) END AS vram_mb",
        "CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE (o_custkey % 100) / 100.0e0 END AS avg_difficulty",
        "CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS INT) END AS scene_count")


def chunk_events(spark, sf) -> DataFrame:
    return table(spark, sf, "events").selectExpr(*CHUNK_EVENT_COLS)


CHUNK_EVENT_COLS = [
    "user_id AS run_id", "CAST(event_id % 20 AS INT) AS chunk_index", "event_id", "ts", "event_type <> 'error' AS success",
    "value AS actual_secs", "50.0e0 AS predicted_secs", "(event_id % 100) / 100.0e0 AS quality_score", "event_type = 'view' AS from_cache",
    "CASE WHEN event_id % 3 = 0 THEN 'Timed out' ELSE 'bad audio' END AS reason",
]


def event_intervals(spark, sf) -> DataFrame:
    """Activity of each user as overlapping intervals in ms."""
    e = table(spark, sf, "events")
    at = F.unix_millis(F.col("ts").cast("timestamp"))
    return e.select(
        F.col("user_id").alias("recording_id"), at.alias("start_ms"),
        (at + F.floor(F.col("value") * 1000)).cast("bigint").alias("end_ms"))


def event_stream(spark, sf) -> DataFrame:
    """The events table as a stream source."""
    return spark.readStream.schema(SCHEMAS["events"]).option("pathGlobFilter", "events.parquet").parquet(sf)


def speech(spark, sf) -> DataFrame:
    """Two of three cues, as speech."""
    return cues(spark, sf).where("(recording_id + pos) % 3 <> 2").select("recording_id", "start_ms", "end_ms")


def recordings(spark, sf) -> DataFrame:
    """recording_id and duration_ms: three seconds past the last cue."""
    return cues(spark, sf).groupBy("recording_id").agg((F.max("end_ms") + 3000).alias("duration_ms"))


def frames(spark, sf) -> DataFrame:
    """Frame energies: a tenth of a second per cue."""
    return cues(spark, sf).selectExpr(
        "recording_id", "pos", "CAST(pos AS BIGINT) * 100 AS start_ms", "(CAST(pos AS BIGINT) + 1) * 100 AS end_ms",
        "-20.0e0 - (recording_id * 31 + (pos div 5) * 17) % 40 AS energy_db")


def messy(spark, sf) -> DataFrame:
    """Cues with defects planted by rule, so that every repair has work to do."""
    return cues(spark, sf).withColumn("text", F.expr(MESSY)).select("recording_id", "pos", "start_ms", "end_ms", "text")


MESSY = (
    "CASE CAST((recording_id + pos) % 8 AS INT) "
    "WHEN 0 THEN concat('I''m''s here. ', text) WHEN 1 THEN concat(text, ' this''s right, I''m do it') "
    "WHEN 2 THEN concat('All I''m ', text, ' I''m had it') WHEN 3 THEN concat('go go  go ', text, ' wait a wait a second') "
    "WHEN 4 THEN concat('no way. No way! no way. ', text) WHEN 5 THEN concat('the''s () ', text, ' ( )') "
    "WHEN 6 THEN concat('sakura ', lower(text)) ELSE text END")


def snippets(spark, sf) -> DataFrame:
    """Every three words of a cue as a cue of their own, close together; some are blank."""
    words = F.split("text", " ")
    c = cues(spark, sf).withColumn("w", T.let(words, lambda ws: F.transform(
        F.sequence(F.lit(0), F.floor((F.size(ws) - 1) / 3).cast("int")), lambda i: F.concat_ws(" ", *(F.get(ws, i * 3 + j) for j in range(3))))))
    # lines are numbered before they are cut, by the pieces they have
    c = scan(c.select("recording_id", "pos", "w"), ["recording_id"], ["pos"], {"before": ("sum_before", F.size("w").cast("bigint"))})
    c = c.select("recording_id", "before", F.posexplode("w").alias("k", "w"))
    piece = F.when(F.col("k") % 11 == 10, "").when(F.col("k") % 6 == 5, F.concat_ws(" ", "w", F.lit("of the"))).otherwise(F.col("w"))
    c = c.withColumn("text", piece).drop("w")
    c = c.withColumn("pos", (F.col("before") + F.col("k")).cast("int"))
    at = F.col("pos").cast("bigint") * 1500
    return c.select("recording_id", "pos", at.alias("start_ms"), (at + 1400 + (F.col("pos") % 7) * 30).alias("end_ms"), "text")


def japanese(spark, sf) -> DataFrame:
    """Cues opened by a dictionary word, or made of one."""
    return cues(spark, sf).withColumn("text", F.expr(JAPANESE)).select("recording_id", "pos", "text", "lang")


JAPANESE = (
    "CASE CAST((recording_id + pos) % 6 AS INT) WHEN 0 THEN 'こんにちは。' WHEN 1 THEN concat('私  ', text, ' です') "
    "WHEN 2 THEN 'え？' WHEN 3 THEN concat('待って', text) WHEN 4 THEN '待って待って' ELSE text END")


def srt_texts(spark, sf, whole: bool = False) -> DataFrame:
    """Every document as the text of a subtitle file, one block per line.

    Minutes are cut to two digits, as the SQL of ``read_srt`` prints them; ``whole`` keeps all of theirs.
    """
    docs = table(spark, sf, "documents")
    pad = lambda c: F.format_string("%02d", c) if whole else F.lpad(c.cast("string"), 2, "0")

    def block(line, i):
        head = F.when(i % 5 == 4, F.lit("")).otherwise(F.concat((i + 1).cast("string"), F.lit("\n")))
        at = lambda s: F.concat(F.lit("00:"), pad(F.floor(s / 60)), F.lit(":"), pad(s % 60), F.lit(",250"))
        ends = F.when(i % 9 == 8, i * 2 - 1).otherwise(i * 2 + 1)
        return F.concat(head, at(i * 2), F.lit(" --> "), at(ends), F.lit("\n"), line)

    return docs.select("doc_id", F.array_join(F.transform(F.split("text", "\n"), block), "\n\n").alias("srt"))
