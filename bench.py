"""Time the analysis on the driver's tables and print one JSON line.

The default ``suite`` mode runs the analysis the way it is meant to run on a
cluster.  The five source tables are imported once (the test-table mapping is
written as Parquet, ``materialize:sources``).  The shared derived tables (the
order x status grain, customer R/F/M base and segments, the order x category,
order x seller and product x customer grains, seller metrics) are each built once and materialized to the shared checkpoint folder --
the ``CREATE TABLE AS`` steps of the analysis, timed as ``materialize:<name>``.
Every registered query then runs over them.  ``standalone`` mode runs every
query from the base tables on its own.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_MODE (suite | standalone), BENCH_QUERIES (optional comma-separated subset),
BENCH_REPEAT (default 1; best of the repeats), BENCH_WARMUP (full, the default: every
query once on sf0.001 before timing | light: three queries), BENCH_CONCURRENT (default 1: also
time all queries submitted from a thread pool, reported as ``concurrent_wall_sec``;
the headline ``value`` stays the sequential sum).  Each query is executed in full
with the ``noop`` sink: the whole plan runs, no rows are collected.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from basketlens.operators import categories as ca  # noqa: E402
from basketlens.operators import customers as cu  # noqa: E402
from basketlens.operators import facts as fa  # noqa: E402
from basketlens.operators import sellers as se  # noqa: E402
from basketlens.plans import catalog  # noqa: E402
from basketlens.session import local_session  # noqa: E402
from basketlens.sources.tables import RetailTables  # noqa: E402

SHARED = (
    ("realized_fact", fa.realized_fact),
    ("customer_rfm_base", cu.customer_rfm_base),
    ("customer_segments", cu.customer_segments),
    ("order_category", ca.order_category),
    ("customer_category", ca.customer_category),
    ("product_customer", ca.product_customer),
    ("order_seller", se.order_seller),
    ("seller_metrics", se.seller_metrics),
)


def _timed(fn) -> float:
    t0 = time.perf_counter()
    fn()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    mode = os.environ.get("BENCH_MODE", "suite")
    repeat = max(1, int(os.environ.get("BENCH_REPEAT", "1")))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cores=cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)),
                          app="basketlens-bench")
    names = wanted or list(catalog.registry())

    # warm-up on another scale factor's files (JVM JIT, generated-code cache), not timed:
    # BENCH_WARMUP=full runs every query once there in the same mode, =light three of them
    warm_dir = "/root/testdata/sf0.001" if os.path.isdir("/root/testdata/sf0.001") else sf_dir
    if os.environ.get("BENCH_WARMUP", "full") == "full":
        warm = RetailTables.from_test_tables(spark, warm_dir)
        warm.persist_derived = mode == "suite"
        warm = warm.stored() if mode == "suite" else warm
        for n in names:
            catalog.run(n, spark, warm_dir, tables=warm).write.format("noop").mode("overwrite").save()
    else:
        for n in ("band_summary", "category_mix", "seller_metrics"):
            catalog.run(n, spark, warm_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    tables = None
    if mode == "suite":
        mapped = RetailTables.from_test_tables(spark, sf_dir)
        mapped.persist_derived = True
        t0 = time.perf_counter()
        tables = mapped.stored()
        times["materialize:sources"] = round(time.perf_counter() - t0, 4)
        for name, build in SHARED:
            times[f"materialize:{name}"] = round(_timed(lambda b=build: b(tables)), 4)

    for n in names:
        best = min(_timed(lambda: catalog.run(n, spark, sf_dir, tables=tables)
                          .write.format("noop").mode("overwrite").save())
                   for _ in range(repeat))
        times[n] = round(best, 4)

    # throughput: the same queries submitted from a pool of threads sharing the session
    # (independent queries overlap their single-task stages on the 8 cores)
    concurrent = None
    if os.environ.get("BENCH_CONCURRENT", "1") == "1":
        from concurrent.futures import ThreadPoolExecutor

        def one(n):
            catalog.run(n, spark, sf_dir, tables=tables).write.format("noop").mode("overwrite").save()

        t0 = time.perf_counter()
        with ThreadPoolExecutor(max_workers=cpus) as pool:
            list(pool.map(one, names))
        concurrent = round(time.perf_counter() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "mode": mode,
        "cpus": cpus,
        "n_queries": len([k for k in times if not k.startswith("materialize:")]),
        "concurrent_wall_sec": concurrent,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
