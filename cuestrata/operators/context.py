"""Context around cues, tags, and the hook for an external text model."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuestrata import rules
from cuestrata.functions import text as T
from cuestrata.operators.ordered import BLOCK, ROWS_PER_BLOCK, one_pass
from cuestrata.operators.scenes import tag_difficulty

KEYS = ["recording_id"]


def context_windows(cues: DataFrame, radius: int, keys: list[str] = KEYS, rows: int = ROWS_PER_BLOCK) -> DataFrame:
    """Add ``prev_lines`` and ``next_lines``: up to ``radius`` texts on each side.

    ``pos`` must be dense.  Rows near a block's edge are also sent to the neighbouring
    block, so one shuffle by (recording, block) is enough and no block is unbounded.
    """
    if not 0 < radius <= rows:
        raise ValueError("radius must be between 1 and the block length")
    home, at = F.floor(F.col("pos") / rows), F.col("pos") % rows
    df = cues.withColumn("__home", home).withColumn(BLOCK, F.explode(F.array_compact(F.array(
        F.col("__home"),
        F.when((at < radius) & (F.col("__home") > 0), F.col("__home") - 1),
        F.when(at >= rows - radius, F.col("__home") + 1)))))
    order = Window.partitionBy(*keys, BLOCK).orderBy("pos")
    df = df.withColumns({
        "prev_lines": F.collect_list("text").over(order.rowsBetween(-radius, -1)),
        "next_lines": F.collect_list("text").over(order.rowsBetween(1, radius)),
    })
    return df.where(F.col(BLOCK) == F.col("__home")).drop(BLOCK, "__home")


def context_prompt(windows: DataFrame) -> DataFrame:
    """Add ``prompt``: the lines around a cue, each marked with its role."""
    def marked(lines, mark):
        return F.array_join(F.transform(lines, lambda t: F.concat(F.lit(f"[{mark}] "), t, F.lit("\n"))), "")

    return windows.withColumn("prompt", F.concat(
        marked(F.col("prev_lines"), "PREV"), F.lit("[CUR] "), F.col("text"), F.lit("\n"), marked(F.col("next_lines"), "NEXT")))


def hinted_text(windows: DataFrame) -> DataFrame:
    """Add ``hinted``: the text, preceded by the last previous line if there is one."""
    text = T.strip("text")
    text = F.when(text == "", " ").otherwise(text)
    hint = T.strip(F.try_element_at("prev_lines", F.lit(-1)))
    return windows.withColumn("hinted", F.when(F.coalesce(hint, F.lit("")) != "", F.concat_ws(" ", hint, text)).otherwise(text))


@one_pass
def context_tags(cues: DataFrame, profile: str = "balanced", keys: list[str] = KEYS) -> DataFrame:
    """Add ``context_tags``: the scene's level and the cue's own marks."""
    df = tag_difficulty(cues, profile, keys)
    level = F.col("difficulty")
    secs = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms")) / 1000
    fast = T.solid_chars("text") / secs >= 9.5
    tags = F.array_compact(F.array(
        F.when(level >= 0.72, "scene_hard").when(level >= 0.46, "scene_medium").otherwise("scene_easy"),
        F.when(T.asks("text"), "cue_question"), F.when(T.exclaims("text"), "cue_exclaim"), F.when(fast, "cue_fast")))
    return df.withColumn("context_tags", tags).drop("difficulty", "scene_id")


def map_text_batches(
    windows: DataFrame, fn: Callable[[list, list, list, list], list]
) -> DataFrame:
    """Rewrite ``text`` with an external batch function.

    ``fn(texts, prev, next, tags)`` returns one text per row; an empty or missing answer
    keeps the source.  Rows with a hard tag are sent in groups of their own, however many
    there are, so how rows are dealt out doesn't decide which groups exist.  Rows keep
    their number and order.
    """
    hard_tags = set(rules.HARD_TAGS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lists = {c: [[] if v is None else list(v) for v in pdf[c]] for c in ("prev_lines", "next_lines", "context_tags")}
            source = pdf["text"].tolist()
            hard = [i for i, t in enumerate(lists["context_tags"]) if hard_tags & {str(x).strip().lower() for x in t}]
            picked = set(hard)
            out = list(source)
            for group in ([i for i in range(len(source)) if i not in picked], sorted(picked)):
                if not group:
                    continue
                answers = fn(
                    [source[i] for i in group], [lists["prev_lines"][i] for i in group],
                    [lists["next_lines"][i] for i in group], [lists["context_tags"][i] for i in group])
                if len(answers) != len(group):
                    raise ValueError(f"expected {len(group)} texts, got {len(answers)}")
                for i, answer in zip(group, answers):
                    out[i] = answer or source[i]
            yield pdf.assign(text=out)

    return windows.mapInPandas(run, windows.schema)
