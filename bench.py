"""Headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the input and the number of cores.  A query counts with the best of three runs
after a warm-up; its rows are written to nowhere, so all of them are computed.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from gleanery.plans import QUERIES  # noqa: E402
from gleanery.session import build_session  # noqa: E402

HEADLINE = ["extract_links", "content_filter", "contains_match", "new_episodes", "resume_after_last",
            "take_until_known", "stitch_content", "media_links", "update_last_pointer", "first_item_per_group",
            "harvest_overview", "book_job", "series_job"]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g")})
    spark.sparkContext.setLogLevel("ERROR")

    def seconds(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    times = {}
    for name in sys.argv[1:] or HEADLINE:
        seconds(name)
        times[name] = round(min(seconds(name) for _ in range(RUNS)), 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf"), "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
