"""SQL building blocks: the derived views and shared measures, stated for DuckDB."""

from __future__ import annotations

from cuestrata import rules


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(items) -> str:
    return "[" + ", ".join(q(i) for i in items) + "]"


def ctes(*parts: str) -> str:
    """``WITH`` clause of the parts and everything they need, in order."""
    done: dict[str, str] = {}

    def need(name):
        if name in done:
            return
        deps, body = BLOCKS[name]
        for d in deps:
            need(d)
        once = "MATERIALIZED " if name == "aligned" else ""  # a large join that several parts read
        done[name] = f"{name} AS {once}({body})"

    for p in parts:
        need(p)
    return "WITH RECURSIVE " + ",\n".join(done.values())


def collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def ascii_lower(c: str) -> str:
    return f"translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def ascii_tokens(c: str) -> str:
    """Lower-case runs of ASCII letters and apostrophes."""
    return f"regexp_extract_all({ascii_lower(c)}, '[a-z'']+')"


def malformed(c: str) -> str:
    hits = " OR ".join(f"contains({ascii_lower(c)}, {q(m)})" for m in rules.MALFORMED)
    return f"({hits} OR regexp_matches({c}, '''[A-Za-z]*'''))"


def low_function(t: str) -> str:
    return (
        f"(CASE WHEN len({t}) < 6 THEN false ELSE "
        f"len(list_filter({t}, lambda x: list_contains({strings(rules.FUNCTION_WORDS)}, x))) / len({t}) < 0.10 END)")


def repeats(t: str) -> str:
    return (
        f"(CASE WHEN len({t}) < 4 THEN false ELSE "
        f"len(list_filter(range(1, len({t})), lambda i: {t}[i] = {t}[i + 1])) > 0 OR "
        f"len(list_filter(range(1, len({t}) - 2), lambda i: {t}[i] = {t}[i + 2] AND {t}[i + 1] = {t}[i + 3])) > 0 END)")


def interjection(c: str) -> str:
    cleaned = collapse(f"regexp_replace({c}, '[^A-Za-z''\\s]', ' ', 'g')")
    return f"({cleaned} IN ({', '.join(q(i) for i in rules.INTERJECTIONS)}))"


# Distances count bytes in this engine: give each accented letter of the data one byte.
ACCENTS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöü"
ACCENT_BYTES = "\x01\x02\x03\x04\x05\x06\x07\x0e\x0f\x10\x11\x12\x13\x14\x15\x16\x17\x18\x19\x1a\x1b"


def one_byte(c: str) -> str:
    codes = " || ".join(f"chr({ord(b)})" for b in ACCENT_BYTES)
    return f"translate({c}, {q(ACCENTS)}, {codes})"


def clamp(e: str, lo="0.0", hi="1.0") -> str:
    return f"greatest({lo}, least({hi}, {e}))"


def clock(ms: str) -> str:
    v = f"greatest(0, {ms})"
    return f"printf('%02d:%02d:%02d,%03d', {v} // 3600000, ({v} // 60000) % 60, ({v} // 1000) % 60, {v} % 1000)"


LINES = """
SELECT doc_id AS recording_id, CAST(unnest(generate_series(0, len(string_split(text, chr(10))) - 1)) AS INT) AS pos,
       trim(unnest(string_split(text, chr(10)))) AS text, lang, source FROM documents"""
CUES = """
SELECT recording_id, pos, lang, source, text, s AS start_ms, s + dur AS end_ms FROM (
  SELECT *, CAST(coalesce(sum(dur + gap) OVER (PARTITION BY recording_id ORDER BY pos
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s
  FROM (SELECT *, CAST(greatest(300, length(text) * 66) AS BIGINT) AS dur,
               CAST(((recording_id * 7 + pos * 13) % 10 - 1) * 250 AS BIGINT) AS gap FROM l) t) u"""

BLOCKS: dict[str, tuple[list[str], str]] = {
    "l": ([], LINES),
    "cues": (["l"], CUES),
    "source_cues": (["cues"], """
SELECT source AS recording_id, recording_id * 1000000 + pos AS pos, start_ms + recording_id * 100000000 AS start_ms,
       end_ms + recording_id * 100000000 AS end_ms, text FROM cues"""),
    "ref_cues": (["cues"], "SELECT * FROM cues WHERE pos % 4 <> 1"),
    "hyp_cues": (["cues"], """
SELECT recording_id, pos, greatest(0, start_ms + ((recording_id + pos) % 5 - 2) * 100) AS start_ms,
       end_ms + ((recording_id + pos) % 3 - 1) * 100 AS end_ms, CASE WHEN pos % 3 = 0 THEN lower(text) ELSE text END AS text
FROM cues WHERE pos % 11 <> 10"""),
    "chunk_cues": (["cues"], """
SELECT recording_id, CAST(start_ms // 30000 AS INT) AS chunk_index, pos, start_ms - (start_ms // 30000) * 30000 AS start_ms,
       end_ms - (start_ms // 30000) * 30000 AS end_ms, text FROM cues
UNION ALL SELECT recording_id, CAST(start_ms // 30000 AS INT) + 1, pos, start_ms + 200 - (start_ms // 30000 + 1) * 30000,
       end_ms + 200 - (start_ms // 30000 + 1) * 30000, text FROM cues WHERE start_ms % 30000 >= 28000"""),
    "asr_segments": (["cues"], """
SELECT recording_id, pos, start_ms + (pos % 3) * 100 AS start_ms, end_ms + (pos % 2) * 400 AS end_ms,
       -1.0e0 * ((recording_id + pos * 3) % 20) / 10 AS avg_logprob, ((recording_id * 3 + pos) % 10) / 10.0e0 AS no_speech_prob,
       1.0e0 + ((recording_id + pos) % 8) / 4.0e0 AS compression_ratio, ((recording_id + pos * 7) % 10) / 10.0e0 AS word_prob_mean,
       ((recording_id * 5 + pos) % 10) / 10.0e0 AS low_word_prob_ratio FROM cues WHERE pos % 7 <> 3"""),
    "pairs": (["cues"], """
SELECT lang AS recording_id, recording_id AS doc_id, pos, concat('w', CAST(length(text) % 20 AS VARCHAR)) AS src,
       CASE WHEN (recording_id + pos) % 5 = 0 THEN concat('Line n', CAST(length(text) % 20 AS VARCHAR), ' xx.')
       ELSE concat('Line n', CAST(length(text) % 20 AS VARCHAR), '.') END AS tgt FROM cues"""),
    "run_log": ([], """
SELECT o_orderkey AS run_id, o_orderdate AS ts,
       CASE WHEN o_custkey % 3 = 0 THEN 'none' WHEN o_custkey % 3 = 1 THEN 'cuda' ELSE 'rocm' END AS gpu_backend,
       CAST((o_custkey % 4) * 4096 AS BIGINT) AS gpu_vram_mb, CAST(1 + o_custkey % 32 AS INT) AS cpu_cores,
       CAST(2048 * (1 + o_custkey % 16) - 1 AS BIGINT) AS total_ram_mb, substr(o_orderpriority, 1, 1) AS source_lang,
       'en' AS target_lang, o_orderstatus AS input_kind, o_orderstatus <> 'F' AS success, o_totalprice / 1000 AS elapsed_secs,
       CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_totalprice / 100 END AS audio_duration_secs,
       (o_orderkey % 100) / 100.0e0 AS avg_difficulty, CAST(o_orderkey % 40 AS INT) AS scene_count,
       concat('plan-', CAST(o_orderkey % 17 AS VARCHAR)) AS plan, concat('dev', CAST(o_custkey % 5 AS VARCHAR)) AS device_fingerprint,
       CASE WHEN o_orderkey % 3 = 0 THEN 'fast' ELSE 'strict' END AS quality_profile,
       concat('h', CAST(o_orderkey % 4 AS VARCHAR)) AS content_profile_hash, CAST(o_orderkey % 200 AS INT) AS output_cues,
       CASE WHEN o_orderkey % 7 = 0 THEN 0.5e0 ELSE 0.9e0 END AS output_non_empty_ratio,
       (o_orderkey % 50) / 100.0e0 AS output_top_line_ratio FROM orders"""),
    "history": (["run_log"], "SELECT * FROM run_log ORDER BY ts DESC, run_id DESC LIMIT 400"),
    "usable": (["run_log"], """
SELECT * FROM run_log WHERE success AND coalesce(output_non_empty_ratio, 1.0) >= 0.80
  AND (coalesce(output_cues, 0) < 80 OR coalesce(output_top_line_ratio, 0.0) <= 0.30)"""),
    "run_queries": ([], """
SELECT o_orderkey AS query_id, substr(o_orderpriority, 1, 1) AS source_lang, 'en' AS target_lang, o_orderstatus AS input_kind,
       CASE WHEN o_orderkey % 2 = 0 THEN 'fast' ELSE 'strict' END AS quality_profile,
       concat('h', CAST(o_custkey % 4 AS VARCHAR)) AS content_profile_hash, concat('dev', CAST(o_orderkey % 5 AS VARCHAR)) AS device_fingerprint,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN o_orderkey % 3 = 1 THEN 'cuda' ELSE 'rocm' END AS backend,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST((1 + o_custkey % 3) * 4096 AS BIGINT) END AS vram_mb,
       CASE WHEN o_custkey % 11 = 0 THEN NULL ELSE (o_custkey % 100) / 100.0e0 END AS avg_difficulty,
       CASE WHEN o_custkey % 13 = 0 THEN NULL ELSE CAST(o_custkey % 40 AS INT) END AS scene_count FROM orders"""),
    "chunk_events": ([], """
SELECT user_id AS run_id, CAST(event_id % 20 AS INT) AS chunk_index, event_id, ts, event_type <> 'error' AS success, value AS actual_secs,
       50.0e0 AS predicted_secs, (event_id % 100) / 100.0e0 AS quality_score, event_type = 'view' AS from_cache,
       CASE WHEN event_id % 3 = 0 THEN 'Timed out' ELSE 'bad audio' END AS reason FROM events"""),
    "event_iv": ([], """
SELECT user_id AS recording_id, epoch_us(ts) // 1000 AS start_ms, CAST(epoch_us(ts) // 1000 + floor(value * 1000) AS BIGINT) AS end_ms FROM events"""),
    "speech": (["cues"], "SELECT recording_id, start_ms, end_ms FROM cues WHERE (recording_id + pos) % 3 <> 2"),
    "recordings": (["cues"], "SELECT recording_id, max(end_ms) + 3000 AS duration_ms FROM cues GROUP BY 1"),
    "feats": (["cues"], f"""
SELECT *, len(tok) AS n_tokens, {malformed('text')} AS malformed, {low_function('tok')} AS low_function, {repeats('tok')} AS repeats
FROM (SELECT *, {ascii_tokens('text')} AS tok FROM cues)"""),
    "ends": (["cues"], """
SELECT *, max(end_ms) OVER (PARTITION BY recording_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM cues"""),
    "scenes": (["ends"], """
SELECT *, CAST(sum(brk) OVER (PARTITION BY recording_id ORDER BY pos) AS BIGINT) AS scene_id FROM (
  SELECT *, CASE WHEN pe IS NULL OR start_ms - pe >= 1500 OR end_ms - pe >= 420000 THEN 1 ELSE 0 END AS brk FROM ends)"""),
    "scenes_o": (["ends"], """
SELECT *, CAST(sum(brk) OVER (PARTITION BY recording_id ORDER BY pos) AS BIGINT) AS scene_id FROM (
  SELECT *, CASE WHEN pe IS NULL OR start_ms - pe >= 1500 OR start_ms - pe <= -100 THEN 1 ELSE 0 END AS brk FROM ends)"""),
    "scored": (["scenes", "feats"], f"""
SELECT recording_id, scene_id, n, difficulty, score, CASE WHEN difficulty >= 0.7 THEN 0.7e0 WHEN difficulty <= 0.3 THEN 0.9e0 ELSE 0.8e0 END AS floor FROM (
  SELECT recording_id, scene_id, count(*) AS n,
    {clamp('''0.20e0 + CASE WHEN sum(end_ms - start_ms) <= 1800 * count(*) THEN 0.28e0 ELSE 0.10e0 END
      + CASE WHEN sum(n_tokens) >= 8 * count(*) THEN 0.22e0 ELSE 0.08e0 END
      + CASE WHEN sum(fast)::DOUBLE / count(*) >= 0.35 THEN 0.22e0 ELSE 0.05e0 END''', '0.1e0', '0.95e0')} AS difficulty,
    {clamp('''1.0e0 - (((sum(malformed::INT) + sum((repeats OR low_function)::INT))::DOUBLE / count(*)) * 1.35e0
      + (sum(malformed::INT)::DOUBLE / count(*)) * 1.55e0)''', '0.0e0', '1.0e0')} AS score
  FROM (SELECT s.recording_id, s.scene_id, s.start_ms, s.end_ms, f.n_tokens, f.malformed, f.repeats, f.low_function,
          CASE WHEN greatest(0, s.start_ms - coalesce(lag(s.end_ms) OVER (PARTITION BY s.recording_id, s.scene_id ORDER BY s.pos), 0)) < 150
               THEN 1 ELSE 0 END AS fast
        FROM scenes s JOIN feats f USING (recording_id, pos)) GROUP BY 1, 2)"""),
    "title": (["cues"], r"""
SELECT recording_id, name, count(*) AS freq FROM (
  SELECT recording_id, unnest(list_filter(regexp_split_to_array(text, '[^A-Za-z]+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{2,}'))) AS name FROM cues)
GROUP BY 1, 2"""),
    "incons": (["title", "cues"], """
SELECT recording_id, mentions, CASE WHEN mentions < 4 THEN 0.0e0 ELSE least(1.0e0, coalesce(odd, 0)::DOUBLE / mentions) END AS name_inconsistency FROM (
  SELECT d.recording_id, CAST(coalesce(m.n, 0) AS BIGINT) AS mentions, o.odd FROM (SELECT DISTINCT recording_id FROM cues) d
  LEFT JOIN (SELECT recording_id, sum(freq) AS n FROM title GROUP BY 1) m USING (recording_id)
  LEFT JOIN (SELECT a.recording_id, sum(least(a.freq, b.freq)) AS odd FROM title a JOIN title b
             ON a.recording_id = b.recording_id AND a.name < b.name AND a.name[1] = b.name[1] AND abs(length(a.name) - length(b.name)) <= 2
             AND 100 * levenshtein(lower(a.name), lower(b.name)) <= 22 * greatest(length(a.name), length(b.name)) GROUP BY 1) o USING (recording_id))"""),
    "semantic": (["feats", "scored", "incons"], """
SELECT f.*, s.scene_low_ratio, s.scene_count, i.name_inconsistency FROM (
  SELECT recording_id, count(*) AS cue_count, avg((malformed OR low_function OR repeats)::INT) AS anomaly_ratio,
         avg(malformed::INT) AS malformed_ratio, avg(low_function::INT) AS low_function_ratio, avg(repeats::INT) AS adjacent_repeat_ratio
  FROM feats GROUP BY 1) f
JOIN (SELECT recording_id, count(*) AS scene_count, avg((score < floor)::INT) AS scene_low_ratio FROM scored GROUP BY 1) s USING (recording_id)
JOIN incons i USING (recording_id)"""),
    "health": (["ends"], f"""
SELECT recording_id, cue_count, CAST(coalesce(top, 0) AS DOUBLE) / cue_count AS top_line_ratio,
       CASE WHEN cue_count > 1 THEN CAST(overs AS DOUBLE) / (cue_count - 1) ELSE 0.0e0 END AS overlap_ratio,
       CAST(filled AS DOUBLE) / cue_count AS non_empty_ratio FROM (
  SELECT recording_id, count(*) AS cue_count, sum((start_ms < coalesce(pe, start_ms))::INT) AS overs,
         sum(({collapse('text')} <> '')::INT) AS filled FROM ends GROUP BY 1)
LEFT JOIN (SELECT recording_id, max(c) AS top FROM (
  SELECT recording_id, lower({collapse('text')}) AS k, count(*) AS c FROM cues GROUP BY 1, 2) WHERE k <> '' GROUP BY 1) USING (recording_id)"""),
    "source_scored": (["scenes"], f"""
SELECT *, CASE WHEN n >= 8 THEN 0.82e0 WHEN n >= 4 THEN 0.76e0 ELSE 0.70e0 END AS floor FROM (
  SELECT recording_id, scene_id, n, {clamp('''1.0e0 - (coalesce(top, 0)::DOUBLE / n * 1.45e0
    + CASE WHEN n > 1 THEN overs::DOUBLE / (n - 1) ELSE 0.0e0 END * 1.35e0 + (1.0e0 - filled::DOUBLE / n) * 1.6e0
    + short::DOUBLE / n * 0.55e0 + tiny::DOUBLE / n * 0.8e0 + dup::DOUBLE / n * 0.95e0)''', '0.0e0', '1.0e0')} AS score
  FROM (SELECT recording_id, scene_id, count(*) AS n, sum((start_ms < coalesce(spe, start_ms))::INT) AS overs, sum((k <> '')::INT) AS filled,
          sum((end_ms - start_ms < 450)::INT) AS short, sum((end_ms - start_ms < 200)::INT) AS tiny, sum((k <> '' AND k = coalesce(pk, ''))::INT) AS dup
        FROM (SELECT *, max(end_ms) OVER (PARTITION BY recording_id, scene_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS spe,
                lag(k) OVER (PARTITION BY recording_id, scene_id ORDER BY pos) AS pk
              FROM (SELECT *, lower({collapse('text')}) AS k FROM scenes)) GROUP BY 1, 2)
  LEFT JOIN (SELECT recording_id, scene_id, max(c) AS top FROM (
    SELECT recording_id, scene_id, lower({collapse('text')}) AS k, count(*) AS c FROM scenes GROUP BY 1, 2, 3) WHERE k <> '' GROUP BY 1, 2) USING (recording_id, scene_id))"""),
    "merged": (["event_iv"], """
SELECT recording_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
  SELECT *, sum(brk) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms) AS g FROM (
    SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM event_iv)) GROUP BY recording_id, g"""),
    "speech_m": (["speech"], """
SELECT recording_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
  SELECT *, sum(brk) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms) AS g FROM (
    SELECT *, CASE WHEN start_ms <= max(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms, end_ms
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS brk FROM speech)) GROUP BY recording_id, g"""),
    "gaps": (["speech_m", "recordings"], """
SELECT recording_id, a AS start_ms, b AS end_ms FROM (
  SELECT recording_id, coalesce(lag(end_ms) OVER (PARTITION BY recording_id ORDER BY start_ms), 0) AS a, start_ms AS b FROM speech_m
  UNION ALL SELECT recording_id, coalesce(max(s.end_ms), 0), r.duration_ms FROM recordings r LEFT JOIN speech_m s USING (recording_id)
            GROUP BY recording_id, r.duration_ms) WHERE b > a"""),
    "cscenes": (["gaps", "recordings", "speech_m"], """
SELECT b.recording_id, b.f AS scene_start_ms, b.t AS scene_end_ms, b.t - b.f AS duration_ms,
  least(1.0e0, coalesce(sum(CASE WHEN s.start_ms IS NOT NULL THEN greatest(0, least(b.t, s.end_ms) - greatest(b.f, s.start_ms)) END), 0) / greatest(b.t - b.f, 1)) AS speech_density
FROM (SELECT recording_id, coalesce(lag(t) OVER (PARTITION BY recording_id ORDER BY t), 0.0e0) AS f, t FROM (
        SELECT g.recording_id, (g.start_ms + g.end_ms) / 2.0e0 AS t FROM gaps g JOIN recordings r USING (recording_id)
        WHERE g.end_ms - g.start_ms >= 1500 AND (g.start_ms + g.end_ms) / 2.0e0 < r.duration_ms
        UNION ALL SELECT recording_id, duration_ms::DOUBLE FROM recordings)) b
LEFT JOIN speech_m s ON s.recording_id = b.recording_id AND s.start_ms < b.t AND s.end_ms > b.f GROUP BY b.recording_id, b.f, b.t"""),
    "classed": (["cscenes"], """
SELECT *, CASE WHEN speech_density <= 0.20 THEN 'ambient' WHEN speech_density >= 0.90 AND duration_ms < 60000 THEN 'rapid-dialogue'
    WHEN speech_density >= 0.90 THEN 'dialogue-dense' WHEN duration_ms >= 420000 THEN 'long-scene' ELSE 'dialogue' END AS scene_type,
  CAST(1 + (speech_density >= 0.85)::INT + (duration_ms <= 45000 AND speech_density >= 0.75)::INT + (difficulty >= 0.70)::INT AS INT) AS speakers,
  CASE WHEN speech_density >= 0.90 OR difficulty >= 0.80 THEN 'high' WHEN speech_density >= 0.55 OR difficulty >= 0.45 THEN 'medium' ELSE 'low' END AS energy,
  CASE WHEN difficulty >= 0.80 THEN 'intense' WHEN speech_density <= 0.25 THEN 'calm' WHEN speech_density >= 0.85 THEN 'urgent' ELSE 'neutral' END AS emotion
FROM (SELECT *, greatest(0.1e0, least(0.95e0, 0.18e0
    + CASE WHEN duration_ms < 25000 THEN 0.25e0 WHEN duration_ms < 60000 THEN 0.15e0 WHEN duration_ms > 600000 THEN 0.18e0 ELSE 0.05e0 END
    + CASE WHEN speech_density >= 0.92 THEN 0.35e0 WHEN speech_density >= 0.75 THEN 0.22e0 WHEN speech_density <= 0.20 THEN 0.28e0 ELSE 0.12e0 END)) AS difficulty
  FROM cscenes)"""),
    "seg_conf": (["asr_segments"], """
SELECT *, greatest(0.0e0, least(1.0e0, greatest(0.0e0, least(1.0e0, exp(avg_logprob))) * 0.55e0 + least(1.0e0, word_prob_mean) * 0.45e0 - no_speech_prob * 0.45e0
    - least(0.35e0, greatest(0.0e0, compression_ratio - 2.0e0) / 2.0e0) - least(0.25e0, low_word_prob_ratio * 0.35e0))) AS score,
  compression_ratio > 2.4 OR (no_speech_prob > 0.70 AND avg_logprob <= -1.25) OR avg_logprob <= -1.60
    OR (word_prob_mean > 0 AND (word_prob_mean < 0.45 OR low_word_prob_ratio > 0.55)) AS suspicious FROM asr_segments"""),
    "cue_conf": (["cues", "seg_conf"], """
SELECT c.recording_id, c.pos, sum(s.score * ov) / sum(ov) AS score, sum(s.avg_logprob * ov) / sum(ov) AS avg_logprob,
  sum(s.no_speech_prob * ov) / sum(ov) AS no_speech_prob, sum(s.compression_ratio * ov) / sum(ov) AS compression_ratio,
  sum(s.word_prob_mean * ov) / sum(ov) AS word_prob_mean, sum(s.low_word_prob_ratio * ov) / sum(ov) AS low_word_prob_ratio,
  bool_or(s.suspicious) AS suspicious
FROM cues c LEFT JOIN (
  SELECT c.recording_id, c.pos, least(c.end_ms, s.end_ms) - greatest(c.start_ms, s.start_ms) AS ov, s.score, s.avg_logprob, s.no_speech_prob,
    s.compression_ratio, s.word_prob_mean, s.low_word_prob_ratio, s.suspicious
  FROM cues c JOIN seg_conf s ON s.recording_id = c.recording_id AND s.start_ms < c.end_ms AND c.start_ms < s.end_ms) s
ON s.recording_id = c.recording_id AND s.pos = c.pos GROUP BY 1, 2"""),
    "low_rows": (["cue_conf"], """
SELECT *, greatest(0.0e0, least(1.0e0, score - least(0.20e0, greatest(0.0e0, compression_ratio - 2.2e0) / 2.2e0) - least(0.15e0, low_word_prob_ratio * 0.20e0))) AS v,
  coalesce(score < 0.50 OR suspicious OR avg_logprob <= -1.25 OR (word_prob_mean > 0 AND word_prob_mean < 0.42) OR low_word_prob_ratio > 0.60
    OR (no_speech_prob > 0.65 AND score < 0.58), false) AS low FROM cue_conf"""),
    "low_spans": (["low_rows"], """
SELECT i.recording_id, i.span_start, i.span_end, coalesce(avg(CASE WHEN r.score IS NOT NULL THEN r.v END), 0.0e0) AS score, 0.5e0 AS floor FROM (
  SELECT recording_id, min(pos) AS span_start, CAST(max(pos) + 1 AS INT) AS span_end FROM (
    SELECT *, sum(CASE WHEN p IS NULL OR pos - p > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY pos) AS g FROM (
      SELECT recording_id, pos, lag(pos) OVER (PARTITION BY recording_id ORDER BY pos) AS p FROM low_rows WHERE low)) GROUP BY recording_id, g) i
JOIN low_rows r ON r.recording_id = i.recording_id AND r.pos >= i.span_start AND r.pos < i.span_end GROUP BY 1, 2, 3"""),
    # overlapping pairs meet in buckets of time, the others by the nearest centre on either side
    "aligned": (["ref_cues", "hyp_cues"], """
WITH hb AS (SELECT recording_id, pos, start_ms, end_ms, unnest(range(start_ms // 30000, end_ms // 30000 + 1)) AS b FROM hyp_cues),
rb AS (SELECT recording_id, pos, start_ms, end_ms, unnest(range(start_ms // 30000, end_ms // 30000 + 1)) AS b FROM ref_cues),
best AS (SELECT recording_id, pos, arg_min(rpos, (-ov, rpos)) AS rpos FROM (
  SELECT h.recording_id, h.pos, r.pos AS rpos, least(h.end_ms, r.end_ms) - greatest(h.start_ms, r.start_ms) AS ov FROM hb h JOIN rb r USING (recording_id, b)) WHERE ov > 0 GROUP BY 1, 2),
lone AS (SELECT recording_id, pos, start_ms + end_ms AS c FROM hyp_cues ANTI JOIN best USING (recording_id, pos)),
centre AS (SELECT recording_id, start_ms + end_ms AS c, min(pos) AS rpos FROM ref_cues GROUP BY 1, 2),
near AS (SELECT recording_id, pos, arg_min(rpos, (d, rpos)) AS rpos FROM (
  SELECT l.recording_id, l.pos, r.rpos, l.c - r.c AS d FROM lone l ASOF JOIN centre r ON l.recording_id = r.recording_id AND l.c >= r.c
  UNION ALL SELECT l.recording_id, l.pos, r.rpos, r.c - l.c FROM lone l ASOF JOIN centre r ON l.recording_id = r.recording_id AND l.c <= r.c) GROUP BY 1, 2)
SELECT recording_id, pos, start_ms, end_ms, ref_pos, ref_start_ms, ref_end_ms, ov AS overlap_ms,
  CASE WHEN ov > 0 THEN ov::DOUBLE / greatest(1, greatest(end_ms, ref_end_ms) - least(start_ms, ref_start_ms)) ELSE 0.0e0 END AS iou,
  ref_text, text AS hyp_text, greatest(0.05e0, ov::DOUBLE / greatest(1, end_ms - start_ms)) AS weight FROM (
  SELECT h.recording_id, h.pos, h.start_ms, h.end_ms, h.text, r.pos AS ref_pos, r.start_ms AS ref_start_ms, r.end_ms AS ref_end_ms, r.text AS ref_text,
    greatest(0, least(h.end_ms, r.end_ms) - greatest(h.start_ms, r.start_ms)) AS ov
  FROM (SELECT * FROM best UNION ALL SELECT * FROM near) b JOIN hyp_cues h USING (recording_id, pos) JOIN ref_cues r ON r.recording_id = b.recording_id AND r.pos = b.rpos)"""),
    "messy": (["cues"], """
SELECT recording_id, pos, start_ms, end_ms, CASE CAST((recording_id + pos) % 8 AS INT)
  WHEN 0 THEN concat('I''m''s here. ', text) WHEN 1 THEN concat(text, ' this''s right, I''m do it')
  WHEN 2 THEN concat('All I''m ', text, ' I''m had it') WHEN 3 THEN concat('go go  go ', text, ' wait a wait a second')
  WHEN 4 THEN concat('no way. No way! no way. ', text) WHEN 5 THEN concat('the''s () ', text, ' ( )')
  WHEN 6 THEN concat('sakura ', lower(text)) ELSE text END AS text FROM cues"""),
    "snippets": (["cues"], """
SELECT recording_id, pos, CAST(pos AS BIGINT) * 1500 AS start_ms, CAST(pos AS BIGINT) * 1500 + 1400 + (pos % 7) * 30 AS end_ms, text FROM (
  SELECT recording_id, CAST(row_number() OVER (PARTITION BY recording_id ORDER BY line, k) - 1 AS INT) AS pos,
    CASE WHEN k % 11 = 10 THEN '' WHEN k % 6 = 5 THEN w || ' of the' ELSE w END AS text FROM (
    SELECT recording_id, line, k, array_to_string(ws[3 * k + 1:3 * k + 3], ' ') AS w FROM (
      SELECT recording_id, line, ws, unnest(range(0, (len(ws) - 1) // 3 + 1)) AS k FROM (
        SELECT recording_id, pos AS line, string_split(text, ' ') AS ws FROM cues))))"""),
    "japanese": (["cues"], """
SELECT recording_id, pos, lang, CASE CAST((recording_id + pos) % 6 AS INT) WHEN 0 THEN 'こんにちは。' WHEN 1 THEN concat('私  ', text, ' です')
  WHEN 2 THEN 'え？' WHEN 3 THEN concat('待って', text) WHEN 4 THEN '待って待って' ELSE text END AS text FROM cues"""),
}
