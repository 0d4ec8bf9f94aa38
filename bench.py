"""Time every named query and print one JSON line.

BENCH_SF_DIR   folder with the tables (default /root/testdata/sf0.1)
BENCH_CPUS     local cores (default 8)
BENCH_REPEAT   runs per query after a warm-up; the best one counts (default 2)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from martlet.plans.marts import build_marts  # noqa: E402
from martlet.registry import queries  # noqa: E402
from martlet.session import build_session  # noqa: E402
from martlet.sources import star_from_parquet  # noqa: E402


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "8g",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
            "spark.sql.shuffle.partitions": cpus,
            # Shuffles here are a few MB: let them still use all cores.
            "spark.sql.adaptive.coalescePartitions.minPartitionSize": "200k",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    def marts(spark, root):
        results = build_marts(star_from_parquet(spark, root)).values()
        with ThreadPoolExecutor(len(results)) as pool:
            list(pool.map(run, results))

    jobs = {name: (lambda s, r, q=query: run(q(s, r))) for name, query in queries().items()}
    jobs["all_marts"] = marts
    seconds = {}
    for name in ("seller_rank", "customer_segments", "top3_products"):
        run(queries()[name](spark, root))
    for name, job in jobs.items():
        times = []
        for _ in range(repeat):
            start = time.perf_counter()
            job(spark, root)
            times.append(time.perf_counter() - start)
        seconds[name] = round(min(times), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total seconds over all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(root).name.removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
