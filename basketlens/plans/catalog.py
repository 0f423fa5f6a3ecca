"""Named analysis queries.

Each entry of ``TABLE_QUERIES`` takes a :class:`RetailTables` and returns a
DataFrame; :func:`registry` wraps them as ``(spark, sf_dir) -> DataFrame`` over
the driver's test tables, with portable output types.  Queries that need a
fixture-specific input (a reduced parent for the orphan checks) are in
``FIXTURE_QUERIES``.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.config import THRESHOLDS
from basketlens.operators import categories as ca
from basketlens.operators import customers as cu
from basketlens.operators import extracts as ex
from basketlens.operators import quality as qa
from basketlens.operators import scores as sc
from basketlens.operators import sellers as se
from basketlens.plans.export import portable
from basketlens.sources import fixture, published
from basketlens.sources.loaders import row_counts, run_dir
from basketlens.sources.tables import RetailTables

TableQuery = Callable[[RetailTables], DataFrame]

# No product of the test tables reaches 100 distinct buyers at any scale factor, so over
# those tables the product-level queries use 5 (see TEST_QUERIES); nothing else does.
TEST_MIN_BUYERS = 5


def _seg(t: RetailTables) -> DataFrame:
    return cu.customer_segments(t)


def _ranks(t: RetailTables) -> DataFrame:
    return t.derived("rfm_value_ranks", lambda tt: sc.measure_ranks(_seg(tt)))


def _top_products(t: RetailTables, buyers: int = THRESHOLDS.min_product_buyers) -> DataFrame:
    return ca.top_products(t, buyers)


def _product_segment_revenue(t: RetailTables, buyers: int = THRESHOLDS.min_product_buyers) -> DataFrame:
    return ca.product_segment_revenue(t, _seg(t), ca.top_products(t, buyers))


def _product_segment_share(t: RetailTables, buyers: int = THRESHOLDS.min_product_buyers) -> DataFrame:
    return ca.product_segment_share(t, _seg(t), buyers)


def _product_share_mean(t: RetailTables, buyers: int = THRESHOLDS.min_product_buyers) -> DataFrame:
    return ca.product_share_mean(t, _seg(t), buyers)


TABLE_QUERIES: dict[str, TableQuery] = {
    # ---- data validation ----
    # V1
    "dup_orders": lambda t: qa.duplicate_keys(t.orders, "order_id"),
    # V2
    "dup_order_items": lambda t: qa.duplicate_keys(t.order_items, "order_item_id"),
    # V3
    "orphan_items_order": lambda t: qa.orphans(t.order_items, t.orders, "order_id"),
    # V4
    "orphan_items_product": lambda t: qa.orphans(t.order_items, t.products, "product_id"),
    # V5
    "orphan_orders_customer": lambda t: qa.orphans(t.orders, t.customers, "customer_id"),
    # X7
    "orphan_products_seller": lambda t: qa.orphans(t.products.select("product_id", "seller_id"),
                                                   t.sellers, "seller_id").select("seller_id"),
    # V6
    "status_mix": qa.status_mix,
    # V7
    "reconcile_all": lambda t: qa.mismatch_count(t, completed_only=False),
    # V8
    "reconcile_completed": lambda t: qa.mismatch_count(t, completed_only=True),
    # X13
    "reconcile_completed_share": qa.mismatch_share,
    # V9
    "orders_without_completed": qa.without_match,
    # S3
    "row_counts": lambda t: row_counts(t.as_dict()),
    # V1-V5 as one report
    "integrity_report": qa.integrity_report,
    # V1-V9 in one pass
    "validation_report": qa.validation_report,
    # the analysis' assertions as one report
    "expectations": lambda t: qa.expectations(t, _seg(t), se.confound_check(t, "fbs_standard")),
    # ---- customers ----
    # C1, C1a
    "rfm_base": cu.customer_rfm_base,
    # C4, C5, C5t
    "customer_segments": _seg,
    # C2
    "eligible_customers": lambda t: cu.eligible_customers(_seg(t)),
    # C3
    "frequency_histogram": lambda t: cu.frequency_histogram(_seg(t)),
    # C6
    "band_summary": lambda t: cu.band_summary(_seg(t)),
    # C7
    "segment_summary": lambda t: cu.segment_summary(_seg(t)),
    # C8
    "watchlist": lambda t: cu.watchlist(_seg(t)),
    # X3
    "watchlist_revenue_share": lambda t: cu.watchlist(_seg(t), with_revenue_share=True),
    # C9
    "headline_split": lambda t: cu.headline_split(_seg(t)),
    # C10
    "band_counts": lambda t: cu.band_counts(_seg(t)),
    # C11
    "band_avg_monetary": lambda t: cu.band_avg_monetary(_seg(t)),
    # C12
    "segment_count": lambda t: cu.segment_count(_seg(t)),
    # ---- categories and products ----
    # K1
    "category_mix": ca.category_mix,
    # X12
    "category_pair_share": ca.category_pair_share,
    # K2
    "segment_category_revenue": lambda t: ca.segment_category_revenue(t, _seg(t)),
    # K2a
    "segment_totals": lambda t: ca.segment_totals(ca.segment_category_revenue(t, _seg(t))),
    # K2b
    "overall_category_share": lambda t: ca.overall_category_share(ca.segment_category_revenue(t, _seg(t))),
    # K2c
    "category_over_index": lambda t: ca.category_over_index(t, _seg(t)),
    # K8
    "category_over_index_wide": lambda t: ca.over_index_wide(t, _seg(t)),
    # X10
    "over_index_flag": lambda t: ca.over_index_flag(t, _seg(t)),
    # K3
    "top_products": _top_products,
    # K3a
    "product_segment_revenue": _product_segment_revenue,
    # K3b
    "product_segment_share": _product_segment_share,
    # X9
    "product_share_mean": _product_share_mean,
    # K4
    "repeat_rate": ca.repeat_rate,
    # K5
    "buyer_profile": lambda t: ca.buyer_profile(t, _seg(t)).drop("pct_high_frequency"),
    # X5
    "buyer_high_frequency": lambda t: ca.buyer_profile(t, _seg(t)).select(
        "category", "customers", "pct_high_frequency"),
    # K6
    "purchase_gaps": ca.purchase_gaps,
    # K6a
    "gap_mid": lambda t: ca.percent_rank_mid(ca.gap_histogram(t), "category", "days_since_prev"),
    # X8
    "gap_median": lambda t: ca.median_from_histogram(ca.gap_histogram(t), "category", "days_since_prev"),
    # K7
    "category_aov": ca.category_aov,
    # ---- sellers ----
    # L1
    "seller_floor": se.seller_floor,
    # L2
    "catalog_size": se.catalog_size,
    # L3
    "catalog_confound": lambda t: se.confound_check(t, "fbs_standard"),
    # X4
    "catalog_confound_type": lambda t: se.confound_check(t, "seller_type"),
    # L4
    "seller_metrics": se.seller_metrics,
    # L5
    "seller_type_means": lambda t: se.seller_type_means(se.seller_metrics(t)),
    # L6
    "logistics_means": lambda t: se.logistics_means(se.seller_metrics(t)),
    # X11
    "seller_ratios": lambda t: se.seller_ratios(se.seller_metrics(t)),
    # L7
    "status_mix_seller_type": lambda t: se.status_mix_by(t, "seller_type"),
    # L8
    "status_mix_logistics": lambda t: se.status_mix_by(t, "fbs_standard"),
    # L9
    "segment_mix_seller_type": lambda t: se.segment_mix_by(t, _seg(t), "seller_type"),
    # X2
    "seller_medians": lambda t: se.seller_medians(se.seller_metrics(t)),
    # ---- described in prose: score and its tie diagnostic ----
    # X1
    "rfm_score": lambda t: sc.rfm_score(_seg(t)),
    # X1 diagnostic
    "rfm_score_tie_split": lambda t: sc.tie_split_report(_seg(t), ranks=_ranks(t)),
    # ---- chart extracts ----
    # D1
    "chart_bars": lambda t: ex.bars(cu.band_summary(_seg(t)), ca.category_mix(t)),
    # D2
    "chart_aov_repeat": lambda t: ex.aov_repeat(ca.repeat_rate(t), ca.category_aov(t)),
    # D3
    "chart_over_index_offset": lambda t: ex.over_index_offset(ca.category_over_index(t, _seg(t))),
    # D4
    "chart_seller_views": lambda t: ex.seller_views(se.logistics_means(se.seller_metrics(t))),
    # D5, D6
    "chart_band_labels": lambda t: ex.band_labels(cu.band_summary(_seg(t))),
}


#: The product-level queries over the test tables.
TEST_QUERIES: dict[str, TableQuery] = {
    name: (lambda t, _query=query: _query(t, TEST_MIN_BUYERS))
    for name, query in {"top_products": _top_products, "product_segment_revenue": _product_segment_revenue,
                        "product_segment_share": _product_segment_share, "product_share_mean": _product_share_mean}.items()}

#: Queries whose rows stand in an order; written results carry it as ``position``.
ORDERED = frozenset({
    "frequency_histogram", "band_summary", "segment_summary", "band_counts", "band_avg_monetary", "category_mix",
    "category_over_index", "category_over_index_wide", "top_products", "product_segment_share", "repeat_rate",
    "catalog_confound", "catalog_confound_type", "seller_type_means", "logistics_means", "status_mix_seller_type",
    "status_mix_logistics", "segment_mix_seller_type"})


def _reduced_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose product is missing from a reduced parent (parts with p_size <= 25)."""
    t = RetailTables.from_test_tables(spark, sf_dir)
    return qa.orphans(t.order_items, fixture.reduced_products(spark, sf_dir), "product_id")


def _table_sums(t: RetailTables) -> DataFrame:
    """``table_name, n_rows, total``: row counts with the sum of a money or key column."""
    total = {"orders": F.sum("subtotal_amount"), "order_items": F.sum("line_total"),
             "customers": F.sum("customer_id"), "products": F.sum("seller_id"), "sellers": F.sum("seller_id")}
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n_rows"), total[name].cast("decimal(38,2)").alias("total"))
        .select(F.lit(name).alias("table_name"), "n_rows", "total") for name, df in t.as_dict().items()])


def _csv_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables written as CSV to the shared folder and read back through the CSV reader."""
    folder = f"{run_dir(spark)}/csv-{uuid.uuid4().hex[:12]}"
    for name, df in RetailTables.from_test_tables(spark, sf_dir).as_dict().items():
        df.write.option("header", True).csv(f"{folder}/{name}.csv")
    return _table_sums(RetailTables.from_csv(spark, folder))


def _catalog_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables registered as views and read back by name."""
    prefix = f"retail_{uuid.uuid4().hex[:12]}_"
    t = RetailTables.from_test_tables(spark, sf_dir)
    t.register_views(prefix)
    return _table_sums(RetailTables.from_catalog(spark, names={n: prefix + n for n in t.as_dict()}))


def _stored_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables imported into the shared folder."""
    return _table_sums(RetailTables.from_test_tables(spark, sf_dir).stored())


def _emitted_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``band_summary`` written as a result table in its order and read back."""
    from basketlens.cli import run_all

    out = f"{run_dir(spark)}/results-{uuid.uuid4().hex[:12]}"
    run_all(RetailTables.from_test_tables(spark, sf_dir), out, ["band_summary"])
    return spark.read.parquet(f"{out}/band_summary")


def _csv_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CSV exports with lettered ids and lines that don't fit: rows loaded and set aside."""
    folder = f"{run_dir(spark)}/messy-{uuid.uuid4().hex[:12]}"
    fixture.write_messy_csv(fixture.load(spark, sf_dir), folder)
    return qa.quarantine_report(RetailTables.from_csv(spark, folder, key_type=T.StringType(), set_bad_rows_aside=True))


def _published_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer segments published by name, replaced by those of repeat buyers while another
    session reads them: what the first and a later reader of that session see."""
    name = f"segments_{uuid.uuid4().hex[:12]}"
    seg = _seg(RetailTables.from_test_tables(spark, sf_dir))
    other = spark.newSession()
    readers = []
    for reader, rows in (("before", seg), ("after", seg.where("frequency > 1"))):
        published.publish(rows, name, bucket_by=("customer_id",), buckets=2)
        readers.append((reader, published.read(other, name)))
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("customers"), F.sum("frequency").alias("orders"),
               F.sum("monetary").cast("decimal(38,2)").alias("monetary"))
        .select(F.lit(reader).alias("reader"), "customers", "orders", "monetary") for reader, df in readers])


def _collated(query: TableQuery, label: str) -> Callable[[SparkSession, str], DataFrame]:
    """A query over labels in mixed case under a collation that ignores it."""
    def run_collated(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = RetailTables.from_dict(fixture.mixed_case(fixture.load(spark, sf_dir))).collated("UTF8_LCASE")
        return query(t).withColumn(label, F.initcap(label))
    return run_collated


def _sixth_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wide over-index where a sixth category is sold."""
    t = RetailTables.from_dict(fixture.sixth_category(fixture.load(spark, sf_dir)))
    return ca.over_index_wide(t, _seg(t))


def _flag_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose campaign flag and campaign id contradict each other, per kind."""
    found = qa.implication_violations(fixture.campaign_orders(spark, sf_dir), "campaign_flag", "campaign_id")
    return found.groupBy("violation").agg(F.count(F.lit(1)).alias("n_orders"))


#: Queries that also run over the fixture with NULL customers, repeated orders and few products.
UNTIDY = {
    "category_mix": ca.category_mix,
    "top_products": _top_products,
    "product_segment_revenue": _product_segment_revenue,
    "product_segment_share": _product_segment_share,
    "product_share_mean": _product_share_mean,
    "validation_report": qa.validation_report,
    "repeat_rate": ca.repeat_rate,
    "purchase_gaps": ca.purchase_gaps,
    "gap_mid": lambda t: ca.percent_rank_mid(ca.gap_histogram(t), "category", "days_since_prev"),
    "category_aov": ca.category_aov,
}


def _untidy(query: TableQuery) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: query(RetailTables.from_dict(fixture.untidy(fixture.load(spark, sf_dir))))


FIXTURE_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "orphan_items_product_reduced": _reduced_orphans,
    # S1
    "csv_tables": _csv_tables,
    # S2
    "catalog_tables": _catalog_tables,
    # S4
    "stored_tables": _stored_tables,
    # S5
    "emitted_tables": _emitted_tables,
    # S1, lines that do not fit
    "csv_quarantine": _csv_quarantine,
    # S4, by name
    "published_tables": _published_tables,
    # K8 with a category that no list names
    "open_category_over_index_wide": _sixth_category,
    # equality filters under the collation of the analysis' database
    "collated_status_mix": _collated(qa.status_mix, "item_status"),
    "collated_category_mix": _collated(ca.category_mix, "category"),
    "collated_repeat_rate": _collated(ca.repeat_rate, "category"),
    # X6
    "flag_violations": _flag_violations,
    **{f"untidy_{name}": _untidy(query) for name, query in UNTIDY.items()},
}


def run(name: str, spark: SparkSession, sf_dir: str, tables: RetailTables | None = None) -> DataFrame:
    """Run one named query over the test tables in ``sf_dir`` (portable output types)."""
    if name in FIXTURE_QUERIES:
        return portable(FIXTURE_QUERIES[name](spark, sf_dir))
    t = tables or RetailTables.from_test_tables(spark, sf_dir)
    return portable((TABLE_QUERIES | TEST_QUERIES)[name](t))


def registry() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    names = list(TABLE_QUERIES) + list(FIXTURE_QUERIES)
    return {n: (lambda spark, sf_dir, _n=n: run(_n, spark, sf_dir)) for n in names}
