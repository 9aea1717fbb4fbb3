"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores, BENCH_RUNS the warm runs
per query (the median counts; one cold run goes before them).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a1_daily_sentiment",
    "a2_hourly_sentiment",
    "a3_class_histogram",
    "a4_store_counts",
    "a6_ticker_markers",
    "a7_mean_of_scores",
    "a10_log_loss",
    "d1_quarter_hour_sentiment",
    "d3_relative_sentiment",
    "d4_price_correlation",
    "f5_english_with_dollar",
    "f6_phrase_matches",
    "f10_cursor_forward",
    "j3_flag_overlay",
    "j7_cashtag_mentions",
    "k1_parquet_by_ticker",
    "k3_insert_if_absent",
    "l1_weak_spam_labels",
    "m2_balanced_sample",
    "m3_remainder_split",
    "p10_strip_urls",
    "p20_truncated_tokens",
    "s8_stocktwits_feed",
    "t3_top_per_ticker",
    "w1_first_per_id",
    "w1_first_per_text",
    "w1_cleaned_corpus",
    "r2_streaming_ingest",
    "r3_running_markers",
]


def main() -> None:
    from msgpulse import plans, session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = session.build("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = plans.queries(), {}
    for name in sys.argv[1:] or HEADLINE:
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 4)
        print(f"{name} cold {taken[0]:.2f} warm {seconds[name]:.2f}", file=sys.stderr)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_warm_query_time",
                "value": round(sum(seconds.values()), 4),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
