"""Run the headline queries once each and print one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set data and cores. Building
the span tables and parsing the rendered logs are measured as queries of their own.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spanforge.plans import QUERIES  # noqa: E402
from spanforge.plans.logs import order_parsed  # noqa: E402
from spanforge.session import local_session  # noqa: E402
from spanforge.sources.tables import order_logs, order_tree, user_traces  # noqa: E402

HEADLINE = [
    "g22_hot_spots",
    "g24_self_time_spread",
    "g2_top_down",
    "g3_bottom_up",
    "g21_hot_path",
    "g16_self_time_by_category",
    "g18_self_time_by_namespace_scoped",
    "d7_ranked_statements",
    "d9_database_tree",
    "d11_db_burned_in",
    "q7_find_repeats_text",
    "q8_find_row_at_a_time",
    "x3_bucket_frames",
    "x5_density",
    "x6_skyline",
    "l6_limit_series",
    "f1_filter_deep",
    "f2_filter_visible",
    "f8_find_in_documents",
]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    shared = tempfile.mkdtemp(prefix="spanforge-bench-")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "spanforge-bench", shared)
    spark.range(1000).count()
    seconds: dict[str, float] = {}

    def timed(name, run) -> None:
        start = time.perf_counter()
        run()
        seconds[name] = round(time.perf_counter() - start, 3)

    timed("build_order_tree", lambda: order_tree(spark, sf_dir))
    timed("build_user_traces", lambda: user_traces(spark, sf_dir))
    timed("render_logs", lambda: drain(order_logs(spark, sf_dir)))
    timed("parse_logs", lambda: order_parsed(spark, sf_dir))
    for name in HEADLINE:
        timed(name, lambda name=name: drain(QUERIES[name](spark, sf_dir)))
    print(
        json.dumps(
            {
                "metric": "headline query seconds, total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
