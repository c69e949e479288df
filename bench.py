"""Seconds per headline query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default all cores) are
read from the environment; BENCH_QUERIES may name a comma-separated subset, or "all".
"""

from __future__ import annotations

import json
import os
import time

from voxrisk.catalog import QUERIES
from voxrisk.session import build_session

HEADLINE = (
    "clean_content", "parse_bilibili", "scan_dir", "bad_records", "row_risk_v2", "row_risk_v1", "filter_high_risk",
    "sentiment_distribution_v2", "top_high_risk", "join_lexicon", "join_sentiment_back", "keywords_count", "keywords_tfidf",
    "keywords_per_row", "weighted_word_freq", "topic_clusters", "user_suspicion", "time_regularity", "bot_score",
    "region_suspicion", "wave_spread_all", "volume_spike", "anomalies", "analysis_limit_large", "time_density",
    "content_hash_dedupe", "interpolate_linear", "outlier_report", "fill_mean_mode", "regress_poly", "stream_clean",
    "risk_assessment_v1", "full_report_v1", "full_report_v2",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = build_session(f"local[{cpus}]", "voxrisk-bench", spark__sql__shuffle__partitions=cpus)
    spark.sparkContext.setLogLevel("ERROR")

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    timed("basic_stats")  # the session's own start is not part of any query
    seconds = {name: timed(name) for name in names}
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
