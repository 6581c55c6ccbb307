"""Wall-clock of the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores.
Every query runs once to warm up and once timed, with a sink that takes all rows.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from cadenza.catalog import load  # noqa: E402
from cadenza.session import local_session  # noqa: E402

HEADLINE = (
    "metadata_score exact_dedup_first solo_score audio_gate_cascade fusion_rules duration_summary query_summary "
    "history_upsert title_near_dup run_block_starts training_windows greedy_timeline_merge bar_bucketing "
    "frame_in_segment window_contains_segment nearest_beat chords_in_range kinetic_features geometric_features "
    "beat_align_score keyframe_set parse_domains parse_movements conversation_record mean_pool vector_topk "
    "frechet_distance mean_pairwise_distance experiment_board"
).split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    registry = load()
    if names == ["all"]:
        names = list(registry.QUERIES)
    spark = local_session(cores)
    times: dict[str, float] = {}
    for name in names:
        for _ in range(runs):
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total_wall_clock", "value": total, "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
