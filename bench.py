"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder (default /root/testdata/sf0.1), BENCH_CPUS the local cores.
Every result is written in full to Spark's no-op sink.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "asof_forward", "cutoff_align", "panel_join", "session_rollup", "volume_tone_join", "daily_metrics",
    "daily_filled", "dedupe_last", "feature_frame", "date_split", "robust_scale", "median_impute",
    "standardize", "post_union", "keyword_match", "keyword_match_table", "lexicon_sentiment",
    "scored_posts", "enriched_daily", "accuracy", "auc", "threshold_tune", "bootstrap_ci", "delong",
    "leaderboard", "backfill_plan", "source_audit", "logit_benchmark",
]


def main() -> None:
    from tidepanel.bindings.registry import QUERIES
    from tidepanel.session import build_session

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", master=f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false",
        spark__ui__showConsoleProgress="false", spark__driver__memory=os.environ.get("BENCH_MEMORY", "12g"),
    )
    spark.sparkContext.setLogLevel("OFF")
    names = sys.argv[1:] or HEADLINE
    # One small query first, so that the first timing is not the start of the engine.
    QUERIES["accuracy"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
