"""Adapter from the driver's TPC-H-like test tables to the five retail tables.

The mapping follows FIXTURES.md section 2 exactly; ``oracle`` inlines the same
mapping as SQL CTEs, so both engines see identical inputs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from basketlens.functions.columns import money_sum
from basketlens.sources.schemas import MONEY

# --- fixed values: fixture mapping constants (FIXTURES.md section 2) ---
AS_OF_ANCHOR = "2001-08-01"       # registration dates count back from this day
REGISTRATION_SPREAD_DAYS = 1500   # c_custkey % 1500 days before the anchor
PARTS_PER_SELLER_PAIR = 44        # 16 parts for the even (FBS) seller + 28 for the odd one
FBS_PARTS = 16
SUBTOTAL_OFF_EVERY = 10           # o_orderkey % 10 = 0: subtotal is o_totalprice
P_TYPE_CATEGORY = (("STANDARD", "Electronics"), ("LARGE", "Fashion"),
                   ("PROMO", "Groceries"), ("SMALL", "Beauty"))
OTHER_CATEGORY = "Home"
CAMPAIGN_EVERY = 3                # orders with a campaign flag
CAMPAIGN_ID_LOST_EVERY = 7        # of those, orders without a campaign id
CAMPAIGN_ID_STRAY_EVERY = 11      # orders with a campaign id, flag or not
NULL_CUSTOMER_EVERY = 9           # untidy tables: orders without a customer
REPEATED_ORDER_EVERY = 8          # untidy tables: order rows that occur twice
DENSE_PRODUCTS = 24               # untidy tables: items go to so many products
REDUCED_PART_MAX_SIZE = 25        # parent with p_size <= 25 leaves orphan items
GARDEN_EVERY = 7                  # open categories: products of a sixth category
BAD_ITEM_EVERY = 40               # messy CSV: items whose amount is no number
BAD_ORDER_EVERY = 60              # messy CSV: orders with an impossible date
BAD_CUSTOMER_EVERY = 25           # messy CSV: customers without an id


# Schemas of the driver tables that the mapping reads (only the columns it uses).  Giving
# them explicitly skips Parquet schema inference, which costs one Spark job per table.
SOURCE_SCHEMAS = {
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_extendedprice double, l_returnflag string, l_linestatus string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderdate timestamp_ntz",
    "customer": "c_custkey bigint",
    "part": "p_partkey bigint, p_name string, p_type string, p_size int",
    "supplier": "s_suppkey bigint",
}


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SOURCE_SCHEMAS[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def order_items(lineitem: DataFrame) -> DataFrame:
    status = (F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F"), "Completed")
              .when(F.col("l_returnflag") == "R", "Refunded")
              .otherwise("Cancelled"))
    return lineitem.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("bigint").alias("order_item_id"),
        F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("product_id"),
        status.alias("item_status"),
        F.col("l_extendedprice").cast(MONEY).alias("line_total"),
    )


def orders(orders_src: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Orders with a subtotal equal to the sum of all items except every tenth order.

    The subtotal needs a lineitem aggregate; Catalyst drops that left join whenever a
    query does not read ``subtotal_amount`` (the aggregate is unique on the key).
    """
    item_sum = (lineitem.groupBy("l_orderkey")
                .agg(money_sum(F.col("l_extendedprice").cast(MONEY)).alias("s")))
    joined = orders_src.join(item_sum, orders_src["o_orderkey"] == item_sum["l_orderkey"], "left")
    subtotal = (F.when(F.col("o_orderkey") % SUBTOTAL_OFF_EVERY == 0, F.col("o_totalprice").cast(MONEY))
                .otherwise(F.coalesce(F.col("s"), F.lit(0)).cast(MONEY)))
    return joined.select(
        F.col("o_orderkey").alias("order_id"),
        F.col("o_custkey").alias("customer_id"),
        F.col("o_orderdate").cast("date").alias("order_date"),
        subtotal.alias("subtotal_amount"),
        F.col("o_totalprice").cast(MONEY).alias("total_amount"),
    )


def customers(customer: DataFrame) -> DataFrame:
    back = (F.col("c_custkey") % REGISTRATION_SPREAD_DAYS).cast("int")
    return customer.select(
        F.col("c_custkey").alias("customer_id"),
        F.date_sub(F.lit(AS_OF_ANCHOR).cast("date"), back).alias("registration_date"),
    )


def products(part: DataFrame) -> DataFrame:
    (first_type, first_cat), *rest = P_TYPE_CATEGORY
    category = F.when(F.col("p_type") == first_type, first_cat)
    for p_type, cat in rest:
        category = category.when(F.col("p_type") == p_type, cat)
    category = category.otherwise(OTHER_CATEGORY)
    block = F.floor(F.col("p_partkey") / PARTS_PER_SELLER_PAIR).cast("bigint")
    seller = 2 * block + F.when(F.col("p_partkey") % PARTS_PER_SELLER_PAIR < FBS_PARTS, 0).otherwise(1)
    return part.select(
        F.col("p_partkey").alias("product_id"),
        F.col("p_name").alias("product_name"),
        category.alias("category"),
        seller.cast("bigint").alias("seller_id"),
    )


def sellers(supplier: DataFrame) -> DataFrame:
    return supplier.select(
        F.col("s_suppkey").alias("seller_id"),
        F.when(F.col("s_suppkey") % 4 < 2, "Company").otherwise("Individual").alias("seller_type"),
        F.when(F.col("s_suppkey") % 2 == 0, "FBS").otherwise("Standard").alias("fbs_standard"),
    )


def campaign_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``order_id, campaign_flag, campaign_id``; the flag and the id contradict at times."""
    key = F.col("o_orderkey")
    return _read(spark, sf_dir, "orders").select(
        key.alias("order_id"), (key % CAMPAIGN_EVERY == 0).alias("campaign_flag"),
        F.when((key % CAMPAIGN_EVERY == 0) & (key % CAMPAIGN_ID_LOST_EVERY != 0) | (key % CAMPAIGN_ID_STRAY_EVERY == 0),
               F.col("o_custkey")).alias("campaign_id"))


def untidy(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with NULL customers, repeated order rows and a dense product table."""
    orders_ = tables["orders"].withColumn(
        "customer_id", F.when(F.col("order_id") % NULL_CUSTOMER_EVERY != 0, F.col("customer_id")))
    again = orders_.where(F.col("order_id") % REPEATED_ORDER_EVERY == 0)
    items = tables["order_items"].withColumn("product_id", F.col("product_id") % DENSE_PRODUCTS + 1)
    return tables | {"orders": orders_.unionByName(again), "order_items": items}


def sixth_category(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with a category that no fixed list knows."""
    category = F.when(F.col("product_id") % GARDEN_EVERY == 0, "Garden").otherwise(F.col("category"))
    return tables | {"products": tables["products"].withColumn("category", category)}


def mixed_case(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables with statuses and categories in lower, upper and mixed case."""
    def cased(label: str, key: str) -> Column:
        return F.when(F.col(key) % 3 == 0, F.upper(label)).when(F.col(key) % 3 == 1, F.lower(label)).otherwise(F.col(label))

    return tables | {"order_items": tables["order_items"].withColumn("item_status", cased("item_status", "order_item_id")),
                     "products": tables["products"].withColumn("category", cased("category", "product_id"))}


def write_messy_csv(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables as CSV exports with lettered ids and lines that don't fit their schema."""
    def lettered(df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.concat(F.upper(F.substring(F.lit(c), 1, 1)), F.lit("-"), F.col(c).cast("string"))
                               for c in df.columns if c.endswith("_id")})

    def broken(df: DataFrame, key: str, every: int, column: str, value: str | None) -> DataFrame:
        return lettered(df.withColumn("_bad", F.col(key) % every == 0)) \
            .withColumn(column, F.when(~F.col("_bad"), F.col(column).cast("string")).otherwise(F.lit(value))).drop("_bad")

    out = {name: lettered(df) for name, df in tables.items()}
    out["order_items"] = broken(tables["order_items"], "order_item_id", BAD_ITEM_EVERY, "line_total", "n/a")
    out["orders"] = broken(tables["orders"], "order_id", BAD_ORDER_EVERY, "order_date", "someday")
    out["customers"] = broken(tables["customers"], "customer_id", BAD_CUSTOMER_EVERY, "customer_id", None)
    for name, df in out.items():
        df.write.option("header", True).csv(f"{folder}/{name}.csv")


def load(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The five retail tables derived from the driver's Parquet files."""
    lineitem = _read(spark, sf_dir, "lineitem")
    return {
        "customers": customers(_read(spark, sf_dir, "customer")),
        "orders": orders(_read(spark, sf_dir, "orders"), lineitem),
        "order_items": order_items(lineitem),
        "products": products(_read(spark, sf_dir, "part")),
        "sellers": sellers(_read(spark, sf_dir, "supplier")),
    }


def reduced_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products restricted to parts with ``p_size <= 25``: a parent that leaves orphans."""
    part = _read(spark, sf_dir, "part")
    return products(part.where(F.col("p_size") <= REDUCED_PART_MAX_SIZE))
