"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is built from the registry and fully executed into Spark's
``noop`` sink (every row computed, nothing collected): one untimed warm-up,
then the median of three timed runs (one, if the warm-up took over 20 s).  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["sales_summary", "category_sales", "list_products", "order_details",
            "revenue_daily", "place_orders"]
EXTRA = ["all_orders", "user_order_stats", "low_stock_items", "check_stock", "fold_cart",
         "fk_audit", "orders_with_items", "toggle_wishlist"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    from storelake.session import checkpoint_dir, get_session
    spark = get_session(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus),
                        extra={"spark.driver.memory": "8g",
                               "spark.sql.files.maxPartitionBytes": str(64 << 20)})
    checkpoint_dir(spark)
    from storelake.plans.registry import load_all
    reg = load_all()
    names = HEADLINE + [n for n in EXTRA if n in reg]

    def run(name: str) -> float:
        t0 = time.perf_counter()
        reg[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    timings: dict[str, float] = {}
    for name in names:
        first = run(name)  # warm-up: JIT, file listing, codegen caches
        again = runs if first < 20 else 1
        timings[name] = round(statistics.median(run(name) for _ in range(again)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total_sec",
        "value": round(sum(timings[n] for n in HEADLINE), 3),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
