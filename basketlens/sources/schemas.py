"""Explicit schemas of the five source tables (no inference at read time)."""

from pyspark.sql import types as T

MONEY = T.DecimalType(18, 2)

CUSTOMERS = T.StructType([
    T.StructField("customer_id", T.LongType(), False),
    T.StructField("registration_date", T.DateType(), True),
])

ORDERS = T.StructType([
    T.StructField("order_id", T.LongType(), False),
    T.StructField("customer_id", T.LongType(), True),
    T.StructField("order_date", T.DateType(), True),
    T.StructField("subtotal_amount", MONEY, True),
    T.StructField("total_amount", MONEY, True),
])

ORDER_ITEMS = T.StructType([
    T.StructField("order_item_id", T.LongType(), False),
    T.StructField("order_id", T.LongType(), True),
    T.StructField("product_id", T.LongType(), True),
    T.StructField("item_status", T.StringType(), True),
    T.StructField("line_total", MONEY, True),
])

PRODUCTS = T.StructType([
    T.StructField("product_id", T.LongType(), False),
    T.StructField("product_name", T.StringType(), True),
    T.StructField("category", T.StringType(), True),
    T.StructField("seller_id", T.LongType(), True),
])

SELLERS = T.StructType([
    T.StructField("seller_id", T.LongType(), False),
    T.StructField("seller_type", T.StringType(), True),
    T.StructField("fbs_standard", T.StringType(), True),
])

#: Columns that no operator reads; an export may lack them.
OPTIONAL_COLUMNS = frozenset({"total_amount"})

TABLE_SCHEMAS = {
    "customers": CUSTOMERS,
    "orders": ORDERS,
    "order_items": ORDER_ITEMS,
    "products": PRODUCTS,
    "sellers": SELLERS,
}
