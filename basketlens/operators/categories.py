"""Category and product analysis: mix, over-index, top products, repeat behaviour,
buyer profiles, purchase gaps, order value.

Most questions are answered from two compact grains: (order, category) --
completed items summed per order and category, with map-side combine, before
the join to orders -- and its (category, customer) roll-up.  Customer
attributes (segments, R/F/M) are joined at customer grain, never to item rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basketlens.config import LABELS, THRESHOLDS, Labels, Thresholds
from basketlens.functions import money_total, pct, round_half_up, to_double
from basketlens.operators.facts import realized_fact, realized_order_dim
from basketlens.operators.ratios import over_index
from basketlens.sources.tables import RetailTables

GAP_CHUNK = 4096   # zero gaps of one customer-day are emitted in arrays of at most this size


# ---------------------------------------------------------------- grains
def order_category(t: RetailTables) -> DataFrame:
    """``order_id, category, customer_id, order_date, revenue, n_items`` (completed items)."""
    return t.derived("order_category", lambda tt: realized_order_dim(tt, "category"))


def customer_category(t: RetailTables) -> DataFrame:
    """``category, customer_id, orders_in_category, own_orders, revenue``; the orders are distinct ids.

    ``own_orders`` counts an order once, for the smallest of its customers, should rows of
    one order id name several: it adds up to the category's distinct orders.  The first
    grouping keeps the (order, category) grain's partitioning on the order.
    """
    def build(tt):
        first = F.row_number().over(Window.partitionBy("order_id", "category").orderBy("customer_id")) == 1
        return (order_category(tt).groupBy("order_id", "category", "customer_id")
                .agg(money_total("revenue").alias("revenue"))
                .withColumn("_own", first.cast("bigint"))
                .groupBy("category", "customer_id")
                .agg(F.count("order_id").alias("orders_in_category"),
                     F.sum(F.when(F.col("order_id").isNotNull(), F.col("_own")).otherwise(0)).alias("own_orders"),
                     money_total("revenue").alias("revenue")))
    return t.derived("customer_category", build, bucket_by=("customer_id",))


# ---------------------------------------------------------------- mix
def category_mix(t: RetailTables) -> DataFrame:
    """``category, revenue (r0), pct_revenue (r1), unique_orders, unique_customers``: one
    roll-up of the (category, customer) grain."""
    agg = customer_category(t).groupBy("category").agg(
        money_total("revenue").alias("_rev"), F.sum("own_orders").alias("unique_orders"),
        F.count("customer_id").alias("unique_customers"))       # NULL is no customer
    total = F.sum("_rev").over(Window.partitionBy())
    return (agg.select("category",
                       to_double(F.round("_rev", 0)).alias("revenue"),
                       pct(F.col("_rev"), total, 1).alias("pct_revenue"),
                       "unique_orders", "unique_customers")
            .orderBy(F.col("revenue").desc(), "category"))


def category_pair_share(t: RetailTables, pair: Sequence[str] = THRESHOLDS.pair_categories) -> DataFrame:
    """Combined share of revenue of a set of categories: ``(pct_revenue)``."""
    cc = customer_category(t)
    inside = F.col("category").isin(list(pair))
    return cc.agg(pct(money_total(F.when(inside, F.col("revenue")).otherwise(F.lit(0))),
                      money_total("revenue"), 1).alias("pct_revenue"))


# ---------------------------------------------------------------- over-index
def segment_category_revenue(t: RetailTables, seg: DataFrame) -> DataFrame:
    """``customer_segment, category, revenue`` (DECIMAL): one join at customer grain."""
    return (customer_category(t).join(seg.select("customer_id", "customer_segment"), "customer_id")
            .groupBy("customer_segment", "category")
            .agg(money_total("revenue").alias("revenue")))


def segment_totals(cells: DataFrame) -> DataFrame:
    return cells.groupBy("customer_segment").agg(money_total("revenue").alias("segment_revenue"))


def overall_category_share(cells: DataFrame) -> DataFrame:
    """``category, category_revenue, overall_share`` over all segmented customers."""
    agg = cells.groupBy("category").agg(money_total("revenue").alias("category_revenue"))
    return agg.withColumn("overall_share", to_double("category_revenue")
                          / F.nullif(to_double(F.sum("category_revenue").over(Window.partitionBy())),
                                     F.lit(0.0)))


def category_over_index(t: RetailTables, seg: DataFrame,
                        segments: Sequence[str] | None = THRESHOLDS.focus_segments) -> DataFrame:
    cells = segment_category_revenue(t, seg)
    return (over_index(cells, "customer_segment", "category", "revenue", segments)
            .drop("_over_index").orderBy("customer_segment", "category"))


def over_index_flag(t: RetailTables, seg: DataFrame, th: Thresholds = THRESHOLDS) -> DataFrame:
    """Over-index with a heuristic flag when it is more than 15% away from 1."""
    cells = segment_category_revenue(t, seg)
    oi = over_index(cells, "customer_segment", "category", "revenue", th.focus_segments)
    return oi.select("customer_segment", "category", "over_index",
                     (F.abs(F.col("_over_index") - 1.0) > th.over_index_band).alias("outside_band"))


#: Columns that the wide over-index may have; more categories than that are an error.
MOST_CATEGORIES = 200


def over_index_wide(t: RetailTables, seg: DataFrame, categories: Sequence[str] | None = None,
                    most: int = MOST_CATEGORIES) -> DataFrame:
    """Segment rows x category columns of the over-index (all segments).

    The columns are all categories that were sold, in order of their names, or those that
    ``categories`` names.  Finding them runs the roll-up to one row for each segment and
    category; more than ``most`` raise an error, as a frame can't have columns without end.
    A NULL category has no column.
    """
    cells = segment_category_revenue(t, seg)
    if categories is None:
        found = [r.category for r in cells.where(F.col("category").isNotNull())
                 .select("category").distinct().limit(most + 1).collect()]
        if len(found) > most:
            raise ValueError(f"more than {most} categories; name those that are wanted")
        categories = sorted(found)
    long = over_index(cells, "customer_segment", "category", "revenue", None)
    return (long.groupBy("customer_segment")
            .pivot("category", list(categories))
            .agg(F.first("over_index"))
            .orderBy("customer_segment"))


# ---------------------------------------------------------------- products
def product_customer(t: RetailTables) -> DataFrame:
    """``product_id, customer_id, revenue`` for completed items."""
    def build(tt):
        return (realized_fact(tt).groupBy("product_id", "customer_id")
                .agg(money_total("revenue").alias("revenue")))
    return t.derived("product_customer", build)


def top_products(t: RetailTables, min_customers: int = THRESHOLDS.min_product_buyers,
                 k: int = THRESHOLDS.top_products) -> DataFrame:
    """Products with at least ``min_customers`` distinct buyers, top ``k`` by revenue.

    ``product_id, product_name, category, revenue, customers``; ties broken by id.
    The result is bounded by ``k`` rows (``TakeOrderedAndProject``).
    """
    per_product = (product_customer(t).groupBy("product_id")
                   .agg(money_total("revenue").alias("revenue"), F.count("customer_id").alias("customers"))
                   .where(F.col("customers") >= min_customers))
    return (per_product.join(t.products.select("product_id", "product_name", "category"), "product_id")
            .select("product_id", "product_name", "category", "revenue", "customers")
            .orderBy(F.col("revenue").desc(), "product_id")
            .limit(k))


def product_segment_revenue(t: RetailTables, seg: DataFrame, top: DataFrame) -> DataFrame:
    """``product_id, customer_segment, seg_revenue`` for the products of ``top``.

    Spark broadcasts ``top`` when its measured size allows it; nothing is assumed of it.
    """
    return (product_customer(t).join(top.select("product_id"), "product_id")
            .join(seg.select("customer_id", "customer_segment"), "customer_id")
            .groupBy("product_id", "customer_segment")
            .agg(money_total("revenue").alias("seg_revenue")))


def product_segment_share(t: RetailTables, seg: DataFrame, min_customers: int,
                          k: int = THRESHOLDS.top_products, labels: Labels = LABELS,
                          unrounded: bool = False) -> DataFrame:
    """B1 and B2 share of each top product's revenue (missing -> 0).

    The k-row top list is computed once and carries all its columns; the buyers of those products are matched to their segment with a left join (a
    buyer outside the segmented base adds nothing), and one conditional
    aggregation per product gives both shares.
    """
    top = top_products(t, min_customers, k)
    keys = ["product_id", "product_name", "category", "revenue", "customers"]
    buyers = product_customer(t).withColumnRenamed("revenue", "_spent").join(top, "product_id")
    tagged = buyers.join(seg.select("customer_id", "customer_segment"), "customer_id", "left")
    joined = tagged.groupBy(*keys).agg(
        money_total(F.when(F.col("customer_segment") == labels.seg_b1, F.col("_spent"))).alias("_b1"),
        money_total(F.when(F.col("customer_segment") == labels.seg_b2, F.col("_spent"))).alias("_b2"))
    b1 = pct(F.coalesce(F.col("_b1"), F.lit(0)), F.col("revenue"), None)
    b2 = pct(F.coalesce(F.col("_b2"), F.lit(0)), F.col("revenue"), None)
    if unrounded:
        return joined.select("product_id", b1.alias("b1_share"), b2.alias("b2_share"))
    return (joined.select("product_id", "product_name", "category",
                          to_double(F.round("revenue", 0)).alias("total_revenue"),
                          F.col("customers").alias("total_customers"),
                          round_half_up(b1, 1).alias("b1_revshare_pct"),
                          round_half_up(b2, 1).alias("b2_revshare_pct"),
                          "revenue")
            .orderBy(F.col("revenue").desc(), "product_id").drop("revenue"))


def product_share_mean(t: RetailTables, seg: DataFrame, min_customers: int,
                       k: int = THRESHOLDS.top_products) -> DataFrame:
    """Mean B1 / B2 share over the top products: ``(mean_b1_revshare_pct, mean_b2_revshare_pct)``."""
    s = product_segment_share(t, seg, min_customers, k, unrounded=True)
    return s.agg(round_half_up(F.sum("b1_share") / F.count(F.lit(1)), 1).alias("mean_b1_revshare_pct"),
                 round_half_up(F.sum("b2_share") / F.count(F.lit(1)), 1).alias("mean_b2_revshare_pct"))


# ---------------------------------------------------------------- repeat behaviour
def repeat_rate(t: RetailTables) -> DataFrame:
    """``category, customers, avg_orders_per_customer (r2), pct_repeat_within_category (r1)``."""
    cc = customer_category(t)
    agg = cc.groupBy("category").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("orders_in_category").alias("_orders"),
        F.count_if(F.col("orders_in_category") > 1).alias("_repeat"))
    return (agg.select("category", "customers",
                       round_half_up(to_double("_orders") / F.col("customers"), 2)
                       .alias("avg_orders_per_customer"),
                       pct(F.col("_repeat"), F.col("customers"), 1).alias("pct_repeat_within_category"))
            .orderBy(F.col("avg_orders_per_customer").desc(), "category"))


def category_aov(t: RetailTables) -> DataFrame:
    """Average order value in category: mean of the per-(order, category) sums (r2)."""
    return customer_category(t).groupBy("category").agg(
        round_half_up(to_double(money_total("revenue")) / F.sum("own_orders"), 2).alias("aov"))


def buyer_profile(t: RetailTables, seg: DataFrame,
                  categories: Sequence[str] = THRESHOLDS.focus_categories,
                  th: Thresholds = THRESHOLDS) -> DataFrame:
    """Overall frequency and monetary of each category's buyers, one row per buyer first.

    ``category, customers, avg_overall_frequency (r2), avg_overall_monetary (r0),
    pct_high_frequency (r1)``.
    """
    buyers = (customer_category(t).where(F.col("category").isin(list(categories)))
              .select("category", "customer_id"))
    joined = buyers.join(seg.select("customer_id", "frequency", "monetary"), "customer_id")
    agg = joined.groupBy("category").agg(
        F.count(F.lit(1)).alias("customers"),
        F.sum("frequency").alias("_f"), money_total("monetary").alias("_m"),
        F.count_if(F.col("frequency") >= th.high_frequency).alias("_hi"))
    return agg.select("category", "customers",
                      round_half_up(to_double("_f") / F.col("customers"), 2).alias("avg_overall_frequency"),
                      round_half_up(to_double("_m") / F.col("customers"), 0).alias("avg_overall_monetary"),
                      pct(F.col("_hi"), F.col("customers"), 1).alias("pct_high_frequency"))


# ---------------------------------------------------------------- purchase gaps
def purchase_days(t: RetailTables, categories: Sequence[str] = THRESHOLDS.focus_categories) -> DataFrame:
    """``category, customer_id, order_date, n_orders, prev_date``: one row per purchase day.

    Orders are first reduced to customer-days, so the LAG window sorts at most one
    row per calendar day per (category, customer) -- bounded by the date span, even
    for a customer holding a third of all orders.
    """
    days = (order_category(t).where(F.col("category").isin(list(categories)))
            .groupBy("category", "customer_id", "order_date")
            .agg(F.count(F.lit(1)).alias("n_orders")))
    w = Window.partitionBy("category", "customer_id").orderBy("order_date")
    return days.withColumn("prev_date", F.lag("order_date").over(w))


def gap_counts(t: RetailTables, categories: Sequence[str] = THRESHOLDS.focus_categories,
               per_customer: bool = True) -> DataFrame:
    """Weighted gaps: ``category[, customer_id], days_since_prev, n`` (NULL = first order).

    A day with ``n`` orders contributes its gap to the previous day once and
    ``n - 1`` gaps of 0 (orders on the same day), exactly the multiset LAG gives.
    """
    d = purchase_days(t, categories)
    keys = ["category", "customer_id"] if per_customer else ["category"]
    first = d.select(*keys, F.datediff("order_date", "prev_date").cast("bigint").alias("days_since_prev"),
                     F.lit(1).cast("bigint").alias("n"))
    same_day = (d.where(F.col("n_orders") > 1)
                .select(*keys, F.lit(0).cast("bigint").alias("days_since_prev"),
                        (F.col("n_orders") - 1).cast("bigint").alias("n")))
    return (first.unionByName(same_day).groupBy(*keys, "days_since_prev")
            .agg(F.sum("n").alias("n")))


def purchase_gaps(t: RetailTables, categories: Sequence[str] = THRESHOLDS.focus_categories) -> DataFrame:
    """Row-level gaps ``category, customer_id, days_since_prev``: one row per distinct
    order in the category (the first order of each customer has NULL).

    Expanded from the weighted form in bounded arrays of ``GAP_CHUNK`` elements.
    """
    g = gap_counts(t, categories)
    chunks = F.sequence(F.lit(0), ((F.col("n") - 1) / GAP_CHUNK).cast("bigint"))
    g = g.withColumn("_chunk", F.explode(chunks))
    size = F.least(F.lit(GAP_CHUNK).cast("bigint"), F.col("n") - F.col("_chunk") * GAP_CHUNK)
    return (g.withColumn("_one", F.explode(F.array_repeat(F.lit(1), size.cast("int"))))
            .select("category", "customer_id", "days_since_prev"))


def gap_histogram(t: RetailTables, categories: Sequence[str] = THRESHOLDS.focus_categories) -> DataFrame:
    """``category, days_since_prev, n``: gap counts per category (bounded by the date span)."""
    return (gap_counts(t, categories, per_customer=False)
            .where(F.col("days_since_prev").isNotNull()))


def percent_rank_mid(hist: DataFrame, group: str, value: str, count: str = "n",
                     name: str = "median_gap_days") -> DataFrame:
    """Smallest ``value`` whose ``PERCENT_RANK`` within ``group`` is >= 0.5, from a histogram.

    PERCENT_RANK of a tie group is ``below / (total - 1)``, where ``below`` counts
    rows with a smaller value.  A group with one row, or whose largest tie group
    starts before the midpoint, has no such value and is absent -- as in SQL.
    This is not the median under ties (see :func:`median_from_histogram`).
    """
    w = Window.partitionBy(group).orderBy(value)
    h = (hist.withColumn("_below", F.sum(count).over(w) - F.col(count))
         .withColumn("_total", F.sum(count).over(Window.partitionBy(group))))
    keep = (F.col("_total") > 1) & (F.col("_below") * 2 >= F.col("_total") - 1)
    return h.where(keep).groupBy(group).agg(F.min(value).alias(name))


def median_from_histogram(hist: DataFrame, group: str, value: str, count: str = "n",
                          name: str = "median_gap_days") -> DataFrame:
    """Exact interpolated median per group from a (value, count) histogram (DOUBLE)."""
    w = Window.partitionBy(group).orderBy(value)
    h = (hist.withColumn("_upto", F.sum(count).over(w))
         .withColumn("_total", F.sum(count).over(Window.partitionBy(group))))
    lo = F.floor((F.col("_total") - 1) / 2)
    hi = F.ceil((F.col("_total") - 1) / 2)
    h = h.withColumn("_from", F.col("_upto") - F.col(count))   # 0-based first position of the value
    at_lo = F.min(F.when((F.col("_from") <= lo) & (lo < F.col("_upto")), F.col(value)))
    at_hi = F.min(F.when((F.col("_from") <= hi) & (hi < F.col("_upto")), F.col(value)))
    return h.groupBy(group).agg(((to_double(at_lo) + to_double(at_hi)) / 2.0).alias(name))
