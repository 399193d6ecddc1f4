"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the data (default the sf0.1 tables) and ``BENCH_CPUS`` the
local cores. Every query is run in full into a sink that discards its rows: once
to warm the JVM up and once for the figure.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import catalog  # noqa: E402
from stockloom.session import build_session  # noqa: E402

HEADLINE = [
    "technical_indicators", "daily_assembly", "daily_metrics", "investor_flow_summary", "weekly_concentration",
    "statement_pivot", "warning_indicators", "default_thresholds", "estimated_roe", "factor_table", "screener",
    "latest_news", "price_sentiment", "news_zscores", "analyst_context", "idempotent_append",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", shuffle_partitions=int(cpus),
                          **{"spark.ui.enabled": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):
            start = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
