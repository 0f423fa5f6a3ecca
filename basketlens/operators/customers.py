"""Customer value: R/F/M base, frequency bands, rule-based segments and their summaries.

Frequency counts distinct orders with at least one completed item; monetary is
realized revenue; recency is the number of days from the customer's last such
order to the last order date over *all* orders.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.config import LABELS, THRESHOLDS, Labels, Thresholds
from basketlens.functions import customer_segment, freq_band, money_total, pct, round_half_up, tenure_group, to_double
from basketlens.operators.facts import as_of_date, realized_orders
from basketlens.sources.tables import RetailTables


def rfm_base(t: RetailTables, as_of=None, th: Thresholds = THRESHOLDS) -> DataFrame:
    """``customer_id, registration_date, frequency, monetary, recency, tenure_group``.

    Plan: completed items are summed per order (partial aggregation before the
    shuffle), joined to orders on ``order_id``, grouped per (customer, order) on the
    join's own partitioning, then per customer.  One row per eligible customer.
    """
    as_of = as_of_date(t) if as_of is None else as_of
    per_order = (realized_orders(t)
                 .groupBy("customer_id", "order_id")
                 .agg(money_total("revenue").alias("revenue"), F.max("order_date").alias("order_date")))
    per_customer = (per_order.groupBy("customer_id")
                    .agg(F.count(F.lit(1)).alias("frequency"),
                         money_total("revenue").alias("monetary"),
                         F.max("order_date").alias("last_order")))
    return (t.customers.select("customer_id", "registration_date")
            .join(per_customer, "customer_id")
            .withColumn("_as_of", as_of)                    # the scalar subquery, referenced once
            .select("customer_id", "registration_date", "frequency", "monetary",
                    F.datediff("_as_of", "last_order").alias("recency"),
                    tenure_group("registration_date", "_as_of", th.tenure_months).alias("tenure_group")))


def add_segments(base: DataFrame, th: Thresholds = THRESHOLDS, labels: Labels = LABELS) -> DataFrame:
    """``customer_segments`` = base + ``freq_band`` + ``customer_segment``."""
    return base.withColumns({
        "freq_band": freq_band("frequency", labels),
        "customer_segment": customer_segment("frequency", "recency", "tenure_group", th, labels),
    })


def customer_rfm_base(t: RetailTables) -> DataFrame:
    """The R/F/M base table, memoized on ``t`` (materialized when ``t.persist_derived``)."""
    return t.derived("customer_rfm_base", rfm_base, bucket_by=("customer_id",))


def customer_segments(t: RetailTables, persist: bool = False) -> DataFrame:
    """The segmented customer table, memoized on ``t`` (optionally materialized)."""
    return t.derived("customer_segments", lambda tt: add_segments(customer_rfm_base(tt)), persist=persist,
                     bucket_by=("customer_id",))


def eligible_customers(seg: DataFrame) -> DataFrame:
    return seg.agg(F.count(F.lit(1)).alias("eligible_customers"))


def frequency_histogram(seg: DataFrame) -> DataFrame:
    return (seg.groupBy("frequency").agg(F.count(F.lit(1)).alias("n_customers"))
            .orderBy("frequency"))


def value_summary(seg: DataFrame, by: str, *, revenue_name: str, avg_name: str,
                  order: str = "revenue") -> DataFrame:
    """Customers, share of customers, revenue, share of revenue and mean revenue per group.

    ``order='min_frequency'`` sorts groups by their smallest frequency (bands);
    ``order='revenue'`` by rounded revenue, descending, then the group key.
    """
    grouped = seg.groupBy(by).agg(F.count(F.lit(1)).alias("customers"),
                                  money_total("monetary").alias("_rev"),
                                  F.min("frequency").alias("_minf"))
    everyone = Window.partitionBy()
    out = grouped.select(
        by, "_minf",
        "customers",
        pct(F.col("customers"), F.sum("customers").over(everyone), 1).alias("pct_customers"),
        to_double(F.round("_rev", 0)).alias(revenue_name),
        pct(F.col("_rev"), F.sum("_rev").over(everyone), 1).alias("pct_revenue"),
        round_half_up(to_double("_rev") / F.col("customers"), 0).alias(avg_name),
    )
    if order == "min_frequency":
        out = out.orderBy("_minf", by)
    else:
        out = out.orderBy(F.col(revenue_name).desc(), by)
    return out.drop("_minf")


def band_summary(seg: DataFrame) -> DataFrame:
    return value_summary(seg, "freq_band", revenue_name="total_revenue",
                         avg_name="avg_revenue_per_customer", order="min_frequency")


def segment_summary(seg: DataFrame) -> DataFrame:
    return value_summary(seg, "customer_segment", revenue_name="revenue",
                         avg_name="revenue_per_customer", order="revenue")


def watchlist(seg: DataFrame, th: Thresholds = THRESHOLDS, with_revenue_share: bool = False) -> DataFrame:
    """Customers with frequency >= 6 and recency > 180 (no tenure filter, as coded).

    ``(watchlist_customers, watchlist_revenue, pct_of_eligible_customers[, pct_of_revenue])``.
    """
    member = (F.col("frequency") >= th.high_frequency) & (F.col("recency") > th.watchlist_days)
    agg = seg.agg(F.count_if(member).alias("watchlist_customers"),
                  money_total(F.when(member, F.col("monetary"))).alias("_rev"),
                  F.count(F.lit(1)).alias("_all"),
                  money_total("monetary").alias("_all_rev"))
    cols = [F.col("watchlist_customers"),
            to_double(F.round("_rev", 0)).alias("watchlist_revenue"),
            pct(F.col("watchlist_customers"), F.col("_all"), 2).alias("pct_of_eligible_customers")]
    if with_revenue_share:
        cols.append(pct(F.col("_rev"), F.col("_all_rev"), 2).alias("pct_of_revenue"))
    return agg.select(*cols)


def headline_split(seg: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Share of customers and of revenue with frequency >= 6: ``(pct_customers, pct_revenue)``."""
    high = F.col("frequency") >= th.high_frequency
    agg = seg.agg(F.count_if(high).alias("_n"), F.count(F.lit(1)).alias("_all"),
                  money_total(F.when(high, F.col("monetary")).otherwise(F.lit(0))).alias("_rev"),
                  money_total("monetary").alias("_all_rev"))
    return agg.select(pct(F.col("_n"), F.col("_all"), 1).alias("pct_customers"),
                      pct(F.col("_rev"), F.col("_all_rev"), 1).alias("pct_revenue"))


def band_table(seg: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """The five bands in fixed order, ``(band_order, freq_band)``, as a small literal frame."""
    rows = [F.struct(F.lit(i + 1).alias("band_order"), F.lit(b).alias("freq_band"))
            for i, b in enumerate(labels.bands)]
    return seg.sparkSession.range(1).select(F.inline(F.array(*rows)))


def band_counts(seg: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """Customers per band in fixed band order; an empty band shows 0."""
    counts = seg.groupBy("freq_band").agg(F.count(F.lit(1)).alias("customers"))
    # counts has one row per band label (a fixed five-value domain): a bounded broadcast
    return (band_table(seg, labels).join(F.broadcast(counts), "freq_band", "left")
            .select("band_order", "freq_band",
                    F.coalesce(F.col("customers"), F.lit(0).cast("bigint")).alias("customers"))
            .orderBy("band_order"))


def band_avg_monetary(seg: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """Mean monetary per band in fixed band order (NULL for an empty band)."""
    avgs = seg.groupBy("freq_band").agg(
        round_half_up(to_double(money_total("monetary")) / F.count(F.lit(1)), 2).alias("avg_monetary"))
    return (band_table(seg, labels).join(F.broadcast(avgs), "freq_band", "left")
            .select("band_order", "freq_band", "avg_monetary")
            .orderBy("band_order"))


def segment_count(seg: DataFrame, segment: str = LABELS.seg_b2) -> DataFrame:
    return seg.agg(F.count_if(F.col("customer_segment") == segment).alias("n"))
