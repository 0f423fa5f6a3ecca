"""The realized-revenue facts every analysis starts from.

Realized revenue is the sum of ``line_total`` over items whose status is
Completed; order amounts are gross and never used as revenue.

Items are summed per (order, product) *before* the joins, so what is shuffled
carries partial aggregates instead of item rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.config import LABELS
from basketlens.functions import money_sum, money_total
from basketlens.sources.tables import RetailTables


def completed_items(t: RetailTables, status: str = LABELS.completed) -> DataFrame:
    """Items with ``item_status = status`` (pushed down to the scan when stored)."""
    return t.order_items.where(F.col("item_status") == status)


def order_dims(t: RetailTables) -> DataFrame:
    return t.orders.select("order_id", "customer_id", "order_date")


def realized_orders(t: RetailTables) -> DataFrame:
    """One row per joined order with realized revenue:
    ``order_id, customer_id, order_date, revenue`` (DECIMAL).

    Orders without a completed item are absent (inner join).
    """
    per_order = completed_items(t).groupBy("order_id").agg(money_sum("line_total").alias("revenue"))
    return per_order.join(order_dims(t), "order_id")


def realized_fact(t: RetailTables) -> DataFrame:
    """Completed items per (order, product), with their order and product:
    ``order_id, product_id, customer_id, order_date, category, seller_id, revenue, n_items``.

    The grain that the category, seller and product questions roll up from.  Stored, it
    is bucketed on ``order_id`` like the imported orders and items, so neither building
    it nor grouping it per order shuffles the orders.  A repeated ``orders`` row repeats
    its items, as in SQL; the roll-ups count distinct orders.
    """
    def build(tt):
        per = (completed_items(tt).groupBy("order_id", "product_id")
               .agg(money_sum("line_total").alias("revenue"), F.count(F.lit(1)).alias("n_items")))
        return (per.join(order_dims(tt), "order_id")
                .join(tt.products.select("product_id", "category", "seller_id"), "product_id"))
    return t.derived("realized_fact", build, bucket_by=("order_id",))


def realized_order_dim(t: RetailTables, dim: str) -> DataFrame:
    """Realized revenue per (order, product attribute):
    ``order_id, <dim>, customer_id, order_date, revenue, n_items``.

    ``dim`` is a column of the fact (``category``, ``seller_id``).  Equal rows of a
    repeated order are one row, so every distinct-order or distinct-customer question
    per ``dim`` is a plain count.
    """
    return (realized_fact(t).groupBy("order_id", dim, "customer_id", "order_date")
            .agg(money_total("revenue").alias("revenue"), F.sum("n_items").alias("n_items")))


def as_of_date(t: RetailTables):
    """Scalar subquery: the last order date over *all* orders (cancelled included)."""
    return t.orders.select(F.max("order_date")).scalar()
