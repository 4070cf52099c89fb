"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query is built and fully executed into a sink that keeps nothing.  The canonical
cue table is derived once first and reported on its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

from cuestrata.plans import views
from cuestrata.plans.queries import QUERIES
from cuestrata.session import local_session

HEADLINE = [
    "scene_quality", "structural_health", "semantic_health", "source_scene_quality", "translation_quality",
    "name_inconsistency", "merge_intervals", "complement", "pick_boundaries", "content_map", "verify_against_speech",
    "cue_confidence", "low_confidence_spans", "align_by_time", "evaluate", "phrase_consistency", "canonical_names",
    "repair_contractions", "collapse_token_loops", "context_windows", "context_tags", "stitch_chunks", "compact_cues",
    "worst_scenes", "first_passing", "accept_better_scenes", "splice", "knowledge_snapshot", "best_run_similar",
    "chunk_monitor", "adaptive_policy", "read_srt", "live_scenes", "clean_translation", "compact_if_not_worse",
    "accept_better_spans", "report_json",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    t0 = time.perf_counter()
    views.cues(spark, sf_dir)
    prepare = round(time.perf_counter() - t0, 3)
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "prepare_cues": prepare, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
