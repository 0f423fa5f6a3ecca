"""Run the whole analysis and write every result table.

    spark-submit --py-files basketlens.zip basketlens/cli.py --parquet <tables> --out <results>
    python -m basketlens.cli --test-tables /root/testdata/sf0.01 --out /tmp/results --local

The shared tables are materialized once (customer R/F/M base and segments,
the order x category / order x seller / product x customer grains, seller
metrics -- the ``CREATE TABLE AS`` steps), then every named query is written
as ``<out>/<name>`` in the chosen format.  Results are written by the
executors, partition by partition; nothing is collected to the driver.
"""

from __future__ import annotations

import argparse
import os
import sys
import time

from pyspark.sql import SparkSession
from pyspark.sql import types as T

if __package__ in (None, ""):      # run as a script: spark-submit basketlens/cli.py ...
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from basketlens.plans import catalog
from basketlens.plans.export import portable
from basketlens.sources.loaders import drop_materialized_tables, with_position
from basketlens.sources.tables import RetailTables


def tables_from_args(spark: SparkSession, args: argparse.Namespace) -> RetailTables:
    key_type = T.StringType() if args.text_keys else None
    if args.parquet:
        return RetailTables.from_parquet(spark, args.parquet, key_type)
    if args.csv:
        return RetailTables.from_csv(spark, args.csv, key_type=key_type, set_bad_rows_aside=args.set_bad_rows_aside)
    if args.catalog is not None:
        return RetailTables.from_catalog(spark, args.catalog or None, key_type=key_type)
    return RetailTables.from_test_tables(spark, args.test_tables)


def run_all(t: RetailTables, out: str, names=None, fmt: str = "parquet") -> dict[str, float]:
    """Write each query's result under ``out``; returns seconds per query.

    Results that stand in an order have it as a column ``position``, as files have none.
    Lines that a CSV load has set aside are written as ``quarantine``.
    """
    t.persist_derived = True
    if t.quarantine is not None:
        t.quarantine.write.mode("overwrite").format(fmt).option("header", True).save(f"{out.rstrip('/')}/quarantine")
    timings = {}
    for name in names or list(catalog.TABLE_QUERIES):
        t0 = time.perf_counter()
        df = portable(catalog.TABLE_QUERIES[name](t))
        if name in catalog.ORDERED:
            df = with_position(df)
        df.write.mode("overwrite").format(fmt).option("header", True).save(f"{out.rstrip('/')}/{name}")
        timings[name] = round(time.perf_counter() - t0, 3)
    return timings


def main(argv=None) -> None:
    p = argparse.ArgumentParser(prog="basketlens", description=__doc__.split("\n\n")[0])
    src = p.add_mutually_exclusive_group(required=True)
    src.add_argument("--parquet", help="folder with customers/orders/order_items/products/sellers .parquet")
    src.add_argument("--csv", help="folder with the five tables as CSV with a header row")
    src.add_argument("--catalog", nargs="?", const="", help="read the five tables from the session catalog "
                     "(optionally from this database)")
    src.add_argument("--test-tables", help="folder with the TPC-H-like test tables (mapped as in FIXTURES.md)")
    p.add_argument("--out", required=True, help="output folder (one sub-folder per query)")
    p.add_argument("--format", default="parquet", choices=["parquet", "csv", "json"])
    p.add_argument("--queries", help="comma-separated subset of query names")
    p.add_argument("--text-keys", action="store_true", help="ids are text (default: whole numbers)")
    p.add_argument("--set-bad-rows-aside", action="store_true",
                   help="with --csv: lines that don't fit are written to <out>/quarantine instead of stopping the load")
    p.add_argument("--collation", help="compare labels under this collation, e.g. UTF8_LCASE")
    p.add_argument("--publish", nargs="?", const="", metavar="DATABASE",
                   help="publish customer_rfm_base, customer_segments and seller_metrics by name")
    p.add_argument("--local", action="store_true", help="run on local[*] (tests, laptops)")
    args = p.parse_args(argv)

    builder = SparkSession.builder.appName("basketlens")
    if args.local:
        from basketlens.session import local_session
        spark = local_session()
    else:
        spark = builder.getOrCreate()
    names = [n for n in (args.queries or "").split(",") if n] or None
    t = tables_from_args(spark, args)
    if args.collation:
        t = t.collated(args.collation)
    timings = run_all(t, args.out, names, args.format)
    if args.publish is not None:
        for name, version in t.publish(args.publish or None).items():
            print(f"{name} -> {version}")
    for name, sec in timings.items():
        print(f"{name:32s} {sec:8.3f}s")
    drop_materialized_tables(spark)


if __name__ == "__main__":
    main()
