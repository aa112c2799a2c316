"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to completion into a no-op sink, once to warm up and then timed; the fastest of the timed runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "advantage_from_rewards",
    "registry_plain_rewards",
    "reward_format",
    "reward_tag_count",
    "reward_repetition_penalty",
    "reward_countdown_equation",
    "reward_accuracy",
    "reward_length",
    "group_advantage",
    "mean_group_metrics",
    "reward_function_metrics",
    "reward_summary",
    "fraction_head",
    "train_test_split",
    "seeded_shuffle",
    "leak_check",
    "repeat_sampler",
    "shape_generation",
    "format_countdown",
    "batch_token_means",
    "reflection_phrases",
    "completions_table_unique_prompts",
    "distinct_prompts",
    "leak_free_rows",
    "leak_check_filtered",
    "distinct_prompts_across_runs",
    "join_prompt_completion",
    "stream_scores",
)


def main() -> None:
    from rewardloom.catalog import QUERIES
    from rewardloom.session import local_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = local_session(cores, shuffle_partitions=int(cores) if cores.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")

    def once(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in HEADLINE:
        once(name)
        times[name] = round(min(once(name) for _ in range(runs)), 3)
    rollouts = spark.read.parquet(f"{folder}/documents.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": Path(folder).name.removeprefix("sf"),
                "rollouts_per_sec_flagship": round(rollouts / times["advantage_from_rewards"], 1),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
