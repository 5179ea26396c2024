"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the local cores (default
8), BENCH_RUNS the timed runs per query after one warm-up (default 3; the median counts).
"""

import json
import os
import statistics
import time

from tallyhouse.plans import adapters as a
from tallyhouse.operators import merge, pricing, ranking, rollups, series
from tallyhouse.session import build_session, work_path

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def discard(rows) -> None:
    """Compute every column of every row and keep nothing."""
    rows.write.format("noop").mode("overwrite").save()


def stored(spark, rows, name: str):
    path = work_path(spark, name)
    rows.repartition(int(CPUS)).write.parquet(path)
    return spark.read.parquet(path)


def main() -> None:
    spark = build_session("tallyhouse-bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    plain = stored(spark, a.unpriced_orders(spark, SF_DIR), "bench-events")
    prices = stored(spark, a.order_prices(spark, SF_DIR), "bench-prices")
    events = stored(spark, pricing.price_usage(plain, prices), "bench-priced")
    hours = stored(spark, rollups.hour_rollup(events), "bench-hours")
    days = stored(spark, rollups.daily_rebuild(hours, a.TZ), "bench-days")
    columns = [*merge.EVENT_KEYS, "usage_date", "model", *merge.MEASURES]
    empty = spark.createDataFrame([], events.select(*columns).schema)
    span = series.data_span(days)
    queries = {
        "price_events": lambda: pricing.price_usage(plain, prices),
        "hour_rollup": lambda: rollups.hour_rollup(events),
        "daily_rebuild": lambda: rollups.daily_rebuild(hours, a.TZ),
        "model_ranking": lambda: ranking.model_ranking(days),
        "trend": lambda: series.trend(days, *span, "weekly"),
        "top_models": lambda: ranking.top_models(days, days),
        "upsert_events": lambda: merge.upsert_events(empty, events, a.ARRIVAL),
        "session_rollup": lambda: rollups.session_rollup(events),
    }
    seconds = {}
    for name, build in queries.items():
        runs = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            discard(build())
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 4)
    print(json.dumps({
        "metric": "total_seconds", "value": round(sum(seconds.values()), 4), "unit": "sec",
        "queries": seconds, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1],
        "rows": {"events": events.count(), "hours": hours.count(), "days": days.count()},
        "cpus": int(CPUS), "spark": spark.version,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
