"""Time the headline queries. Prints one JSON line.

Each query is built and run to its last row twice. "queries" are the first runs, which include planning and code
generation; "warm" are the second ones.
BENCH_SF_DIR names the table folder, BENCH_CPUS the cores, BENCH_QUERIES a comma-separated choice ("all" for every one).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from marketpulse.plans.queries import REGISTRY  # noqa: E402
from marketpulse.session import local_session  # noqa: E402

HEADLINE = (
    "weighted_sentiment", "sentiment_report", "normalize_text", "extract_symbols", "score_text", "filter_stats",
    "x_parse", "reddit_thread_comments", "stocktwits_parse", "mention_join", "search_match", "resolve_cached",
    "sentiment_by_source", "posts_sentiment_join", "upsert_posts", "upsert_sentiment", "interest_over_time",
    "trends_record", "embed_hash", "cosine_topk", "ivf_topk", "rolling_sentiment", "stream_dedupe", "stream_ingest",
    "report_from_store", "posts_sentiment_bucketed", "ivf_exact", "dead_letters_replay",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(REGISTRY) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    partitions = int(cpus) if cpus.isdigit() else 8
    spark = local_session(cpus, shuffle_partitions=partitions)
    spark.range(1_000_000).selectExpr("sum(id)").collect()
    seconds, warm = {}, {}
    for name in names:
        for runs in (seconds, warm):
            start = time.perf_counter()
            REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "warm": warm, "warm_value": round(sum(warm.values()), 3),
        "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cpus": cpus, "shuffle_partitions": partitions,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
