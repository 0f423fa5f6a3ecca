"""Seller analysis: sample floor, catalog size and its confound, normalized metrics,
status mix and customer-segment mix.

Sellers are reached through products, so items are first reduced to
(order, seller) rows; every seller metric is computed from that grain.
Cross-seller comparisons use revenue per product, never raw revenue.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.config import LABELS, Labels
from basketlens.functions import money_total, round_half_up, safe_div, to_double
from basketlens.operators.facts import realized_order_dim
from basketlens.operators.ratios import share_within
from basketlens.sources.tables import RetailTables


def order_seller(t: RetailTables) -> DataFrame:
    """Completed items per (order, seller): ``order_id, seller_id, customer_id, order_date, revenue, n_items``."""
    return t.derived("order_seller", lambda tt: realized_order_dim(tt, "seller_id"))


def seller_floor(t: RetailTables) -> DataFrame:
    """Smallest item count and distinct-customer count over sellers, all item statuses.

    ``(min_items_per_seller, min_customers_per_seller)``.  Items are counted per (order,
    product), on the orders' own partitioning, and per (product, customer) before the
    products are joined: a hot product is a row for each of its customers.
    """
    per_order = t.order_items.groupBy("order_id", "product_id").agg(F.count(F.lit(1)).alias("n_items"))
    per_buyer = (per_order.join(t.orders.select("order_id", "customer_id"), "order_id")
                 .groupBy("product_id", "customer_id").agg(F.sum("n_items").alias("n_items")))
    per_customer = (per_buyer.join(t.products.select("product_id", "seller_id"), "product_id")
                    .groupBy("seller_id", "customer_id").agg(F.sum("n_items").alias("n_items")))
    per_seller = per_customer.groupBy("seller_id").agg(
        F.sum("n_items").alias("item_count"),
        F.count(F.when(F.col("customer_id").isNotNull(), F.lit(1))).alias("customer_count"))
    return per_seller.agg(F.min("item_count").alias("min_items_per_seller"),
                          F.min("customer_count").alias("min_customers_per_seller"))


def catalog_size(t: RetailTables) -> DataFrame:
    """``seller_id, n_products`` (sellers without products are absent)."""
    return t.products.groupBy("seller_id").agg(F.count(F.lit(1)).alias("n_products"))


def confound_check(t: RetailTables, by: str = "fbs_standard") -> DataFrame:
    """Catalog size per seller attribute: ``by, sellers, min_products, max_products, avg_products``.

    ``min == max`` means the catalog size is fixed by the attribute, so raw seller
    revenue cannot be compared across its values.
    """
    sized = t.sellers.select("seller_id", by).join(catalog_size(t), "seller_id")
    return (sized.groupBy(by)
            .agg(F.count_distinct("seller_id").alias("sellers"),
                 F.min("n_products").alias("min_products"),
                 F.max("n_products").alias("max_products"),
                 (to_double(F.sum("n_products")) / F.count(F.lit(1))).alias("avg_products"))
            .orderBy(by))


def seller_metrics(t: RetailTables) -> DataFrame:
    """``seller_id, seller_type, fbs_standard, n_products, revenue, customers,
    revenue_per_product, revenue_per_customer``.

    ``revenue_per_customer`` divides by the distinct customers of *this* seller; a
    customer buying from several sellers counts for each of them.
    """
    def build(tt):
        per_customer = (order_seller(tt).groupBy("seller_id", "customer_id")
                        .agg(money_total("revenue").alias("revenue")))
        per_seller = per_customer.groupBy("seller_id").agg(
            money_total("revenue").alias("revenue"),
            F.count(F.when(F.col("customer_id").isNotNull(), F.lit(1))).alias("customers"))
        return (tt.sellers.select("seller_id", "seller_type", "fbs_standard")
                .join(catalog_size(tt), "seller_id")
                .join(per_seller, "seller_id")
                .select("seller_id", "seller_type", "fbs_standard", "n_products", "revenue", "customers",
                        safe_div("revenue", "n_products").alias("revenue_per_product"),
                        safe_div("revenue", "customers").alias("revenue_per_customer")))
    return t.derived("seller_metrics", build)


def _mean(col: str):
    return to_double(F.sum(col)) / F.count(F.col(col))


def seller_type_means(metrics: DataFrame) -> DataFrame:
    """Unweighted means over sellers per seller type (r0)."""
    return (metrics.groupBy("seller_type")
            .agg(round_half_up(_mean("revenue_per_product"), 0).alias("mean_revenue_per_product"),
                 round_half_up(_mean("revenue_per_customer"), 0).alias("mean_revenue_per_customer"))
            .orderBy("seller_type"))


def logistics_means(metrics: DataFrame) -> DataFrame:
    """Raw vs catalog-normalized mean revenue per logistics type (r0)."""
    return (metrics.groupBy("fbs_standard")
            .agg(round_half_up(_mean("revenue"), 0).alias("mean_raw_revenue"),
                 round_half_up(_mean("revenue_per_product"), 0).alias("mean_revenue_per_product"))
            .orderBy("fbs_standard"))


def status_mix_by(t: RetailTables, attribute: str) -> DataFrame:
    """Item status mix within a seller attribute, all statuses: ``attribute, item_status, pct``.

    Items are counted per (product, status), map-side, before the product and seller
    attributes are attached: a hot product is a row for each status.
    """
    per_product = t.order_items.groupBy("product_id", "item_status").agg(F.count(F.lit(1)).alias("n"))
    tagged = per_product.join(t.products.select("product_id", "seller_id"), "product_id").join(t.sellers.select("seller_id", attribute), "seller_id")
    return (share_within(tagged, attribute, "item_status", value="n")
            .orderBy(attribute, "item_status"))


def segment_mix_by(t: RetailTables, seg: DataFrame, attribute: str = "seller_type") -> DataFrame:
    """Share of a seller attribute's distinct customers per customer segment.

    The denominator is the sum of the cells (each customer has one segment, so it
    equals the attribute's distinct customers).
    """
    buyers = (order_seller(t).select("seller_id", "customer_id")
              .join(t.sellers.select("seller_id", attribute), "seller_id")
              .select(attribute, "customer_id").distinct())
    tagged = buyers.join(seg.select("customer_id", "customer_segment"), "customer_id")
    return (share_within(tagged, attribute, "customer_segment",
                         pct_name=f"pct_of_{attribute.replace('_', '')}_customers")
            .orderBy(attribute, "customer_segment"))


def seller_ratios(metrics: DataFrame, labels: Labels = LABELS) -> DataFrame:
    """Group-to-group ratios of the seller means (r3): Company / Individual per product
    and per customer, Standard / FBS raw revenue and per product."""
    def mean_where(col, attr, value):
        hit = F.col(attr) == value
        return to_double(F.sum(F.when(hit, F.col(col)))) / F.count(F.when(hit, F.col(col)))

    def ratio(col, attr, a, b):
        return round_half_up(mean_where(col, attr, a) / mean_where(col, attr, b), 3)

    return metrics.agg(
        ratio("revenue_per_product", "seller_type", labels.company, labels.individual)
        .alias("company_over_individual_per_product"),
        ratio("revenue_per_customer", "seller_type", labels.company, labels.individual)
        .alias("company_over_individual_per_customer"),
        ratio("revenue", "fbs_standard", labels.standard, labels.fbs).alias("standard_over_fbs_raw"),
        ratio("revenue_per_product", "fbs_standard", labels.standard, labels.fbs)
        .alias("standard_over_fbs_per_product"),
    )


def seller_medians(metrics: DataFrame, dimensions=("seller_type", "fbs_standard")) -> DataFrame:
    """Exact medians next to the means, per seller attribute (r0).

    ``dimension, group_value``, then ``median_<m>`` and ``mean_<m>`` for each measure
    ``revenue``, ``revenue_per_product``, ``revenue_per_customer``.  Attributes and measures
    are stacked into one long frame; the middle values are selected (:func:`medians`), so no
    group's values are gathered into one task or sorted.
    """
    from basketlens.operators.ranks import medians

    measures = ("revenue", "revenue_per_product", "revenue_per_customer")
    stacked = None
    for attr in dimensions:
        part = metrics.select(F.lit(attr).alias("dimension"), F.col(attr).alias("group_value"),
                              *[F.col(m).cast("double").alias(m) for m in measures])
        stacked = part if stacked is None else stacked.unionByName(part)
    long = stacked.unpivot(["dimension", "group_value"], list(measures), "measure", "value")
    keys = ["dimension", "group_value", "measure"]
    meds = medians(long, "value", keys)
    means = long.groupBy(*keys).agg((F.sum("value") / F.count("value")).alias("mean"))
    both = meds.join(means.select(*[F.col(k).alias(f"_{k}") for k in keys], "mean"),
                     reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]))
    wide = (both.groupBy("dimension", "group_value")
            .pivot("measure", list(measures))
            .agg(F.first(round_half_up("median", 0)).alias("median"), F.first(round_half_up("mean", 0)).alias("mean")))
    return wide.select("dimension", "group_value",
                       *[F.col(f"{m}_{s}").alias(f"{s}_{m}") for s in ("median", "mean") for m in measures])
