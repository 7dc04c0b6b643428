"""Time the headline queries. Prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_KEYS (comma list, or "all").
"""

from __future__ import annotations

import json
import os
import time

from placewatch.catalog import QUERIES
from placewatch.session import local_session

HEADLINE = ("Q-01 Q-02 Q-03 Q-04 Q-05 Q-06 Q-07 Q-09 Q-10 Q-11 Q-12 Q-13 Q-14 Q-16 Q-17 Q-18 Q-20 Q-24 Q-26 Q-28 Q-29 Q-30 "
            "AGG-01 AGG-03 AGG-07 JON-05 SPA-02 SPA-05 SPA-05-grid SET-04 SNK-05 STR-01 STR-05 TXT-01 VEC-01 WIN-02 WIN-03 "
            "SNK-05-table STR-06 TXT-03 VEC-02 SRC-15 UDF-01 Q-26-scenarios").split()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_KEYS", "")
    keys = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")), "bench")
    # One warm-up, so that the first query does not pay for starting the engine.
    QUERIES["AGG-11"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for k in keys:
        at = time.perf_counter()
        QUERIES[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.perf_counter() - at, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
