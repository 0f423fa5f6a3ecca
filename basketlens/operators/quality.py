"""Data-quality operators: duplicate keys, orphans, reconciliation, expectations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.config import LABELS, THRESHOLDS
from basketlens.functions import money_sum, pct
from basketlens.operators.facts import completed_items
from basketlens.operators.ratios import share_of_total
from basketlens.sources.tables import RetailTables


def _cols(x) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def duplicate_keys(df: DataFrame, keys) -> DataFrame:
    """Key values that occur more than once: ``(keys..., n)``; expect no rows.

    A hot duplicated key costs nothing extra: the count is combined map-side.
    """
    keys = _cols(keys)
    return (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") > 1))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str | None = None,
            output: str | None = None) -> DataFrame:
    """Child rows whose ``key`` has no match in ``parent``: one row per child row.

    Written as a left anti join (Catalyst does not turn ``LEFT JOIN ... IS NULL``
    into one).  A NULL child key never matches and is reported, as in SQL.
    """
    parent_key = parent_key or key
    keys = parent.select(F.col(parent_key).alias("_pk"))
    return (child.join(keys, child[key] == keys["_pk"], "left_anti")
            .select(F.col(key).alias(output or key)))


def status_mix(t: RetailTables) -> DataFrame:
    """``(item_status, n_items, pct_of_items)`` over all items."""
    return share_of_total(t.order_items, "item_status", count_name="n_items",
                          pct_name="pct_of_items")


def _item_sums(items: DataFrame, name: str) -> DataFrame:
    return items.groupBy("order_id").agg(money_sum("line_total").alias(name))


def reconcile(orders: DataFrame, items: DataFrame, *, amount: str = "subtotal_amount",
              tolerance: str = THRESHOLDS.reconcile_tolerance, how: str = "inner") -> DataFrame:
    """Orders whose ``amount`` differs from the sum of their items by more than ``tolerance``.

    ``how='inner'`` skips orders without items; ``how='left'`` treats their sum as 0.
    Returns the offending orders: ``order_id, amount, item_sum, diff``.
    """
    sums = _item_sums(items, "item_sum")
    joined = orders.select("order_id", amount).join(sums, "order_id", how)
    item_sum = F.coalesce(F.col("item_sum"), F.lit(0)) if how == "left" else F.col("item_sum")
    diff = F.col(amount) - item_sum
    return (joined.select("order_id", amount, item_sum.alias("item_sum"), diff.alias("diff"))
            .where(F.abs(F.col("diff")) > F.lit(tolerance).cast("decimal(18,2)")))


def mismatch_count(t: RetailTables, *, completed_only: bool,
                   tolerance: str = THRESHOLDS.reconcile_tolerance) -> DataFrame:
    """``(mismatched_orders)``: all items with an inner join, or completed items with a left join."""
    how = "left" if completed_only else "inner"
    items = completed_items(t) if completed_only else t.order_items
    return reconcile(t.orders, items, tolerance=tolerance, how=how).agg(F.count(F.lit(1)).alias("mismatched_orders"))


def mismatch_share(t: RetailTables, tolerance: str = THRESHOLDS.reconcile_tolerance) -> DataFrame:
    """Completed-only mismatches as a share of all orders:
    ``(mismatched_orders, total_orders, pct_of_all_orders)``."""
    bad = mismatch_count(t, completed_only=True, tolerance=tolerance)
    total = t.orders.select(F.count(F.lit(1))).scalar()
    return (bad.withColumn("total_orders", total)
            .select("mismatched_orders", "total_orders",
                    pct(F.col("mismatched_orders"), F.col("total_orders"), 1).alias("pct_of_all_orders")))


def without_match(t: RetailTables, status: str = LABELS.completed) -> DataFrame:
    """Orders with no item of ``status``: ``(orders_with_no_completed_items, pct_of_all_orders)``."""
    have = completed_items(t, status).select("order_id").distinct()   # combined map-side
    missing = t.orders.select("order_id").join(have, "order_id", "left_anti")
    total = t.orders.select(F.count(F.lit(1))).scalar()
    return (missing.agg(F.count(F.lit(1)).alias("orders_with_no_completed_items"))
            .select("orders_with_no_completed_items",
                    pct(F.col("orders_with_no_completed_items"), total, 1)
                    .alias("pct_of_all_orders")))


def implication_violations(df: DataFrame, flag: str, ref: str) -> DataFrame:
    """Rows where ``flag`` is set but ``ref`` is missing, or ``ref`` is set without ``flag``.

    Used for flag/id consistency (e.g. a campaign flag against a campaign id):
    returns the offending rows plus a ``violation`` column naming the case.
    """
    flag_on = F.coalesce(F.col(flag).cast("boolean"), F.lit(False))
    has_ref = F.col(ref).isNotNull()
    case: Column = (F.when(flag_on & ~has_ref, F.lit("flag_without_ref"))
                    .when(~flag_on & has_ref, F.lit("ref_without_flag")))
    return df.withColumn("violation", case).where(F.col("violation").isNotNull())


#: The key domains of the five tables: kind -> (parent table, child tables), joined on ``<kind>_id``.
DOMAINS = {
    "order_item": ("order_items", ()),
    "order": ("orders", ("order_items",)),
    "product": ("products", ("order_items",)),
    "customer": ("customers", ("orders",)),
    "seller": ("sellers", ("products",)),
}


def key_census(t: RetailTables, *, money: bool = False, status: str = LABELS.completed) -> DataFrame:
    """Every key of every table with the rows that hold it, in one pass over each table:
    ``kind, key, label, parents, children``, and with ``money`` also ``total, done, done_items,
    amounts, low, high`` of the orders and a ``status`` kind whose labels are item statuses.

    A row becomes an entry for each key it holds (an order item: its own, its order's, its
    product's); entries of all tables are counted together, first in their task, then in one
    shuffle on the key.  A key that is a third of all rows costs one entry for each task.
    """
    tables = t.as_dict()
    types = {tables[parent].schema[f"{kind}_id"].dataType.simpleString() for kind, (parent, _) in DOMAINS.items()}
    key_type = types.pop() if len(types) == 1 else "string"
    nothing = {"parents": F.lit(0), "children": F.lit(0)}
    if money:
        none = F.lit(None).cast("decimal(18,2)")
        nothing |= {"total": none, "done": none, "done_items": F.lit(0), "amount": none}

    def entry(kind: str, key: Column | None, label: Column | None = None, **measures: Column) -> Column:
        known = F.lit(None) if key is None else key
        return F.struct(F.lit(kind).alias("kind"), known.cast(key_type).alias("key"),
                        (F.lit(None) if label is None else label).cast("string").alias("label"),
                        *[measures.get(c, blank).alias(c) for c, blank in nothing.items()])

    parts = []
    for name, df in tables.items():
        entries = []
        for kind, (parent, children) in DOMAINS.items():
            key, extra = F.col(f"{kind}_id"), {}
            if money and kind == "order" and name == "order_items":
                hit = F.col("item_status") == status
                extra = {"total": F.col("line_total"), "done": F.when(hit, F.col("line_total")),
                         "done_items": F.when(hit, 1).otherwise(0)}
            if money and kind == "order" and name == "orders":
                extra = {"amount": F.col("subtotal_amount")}
            if name == parent:
                entries.append(entry(kind, key, parents=F.lit(1), **extra))
            if name in children:
                entries.append(entry(kind, key, children=F.lit(1), **extra))
        if money and name == "order_items":
            entries.append(entry("status", None, F.col("item_status"), children=F.lit(1)))
        parts.append(df.select(F.inline(F.array(*entries))))
    counts = [F.sum(c).cast("bigint").alias(c) for c in ("parents", "children")]
    if money:
        counts += [money_sum("total").alias("total"), money_sum("done").alias("done"), F.sum("done_items").alias("done_items"),
                   F.count("amount").alias("amounts"), F.min("amount").alias("low"), F.max("amount").alias("high")]
    return reduce(DataFrame.unionByName, parts).groupBy("kind", "key", "label").agg(*counts)


def _repeated(kind: str) -> Column:
    return F.count_if((F.col("kind") == kind) & (F.col("parents") > 1))


def _lost(kind: str) -> Column:
    """Child rows whose key no parent has; a NULL key never matches."""
    lost = (F.col("kind") == kind) & (F.col("key").isNull() | (F.col("parents") == 0))
    return F.coalesce(F.sum(F.when(lost, F.col("children"))), F.lit(0)).cast("bigint")


INTEGRITY = {
    "duplicate order_id": lambda: _repeated("order"),
    "duplicate order_item_id": lambda: _repeated("order_item"),
    "item without order": lambda: _lost("order"),
    "item without product": lambda: _lost("product"),
    "order without customer": lambda: _lost("customer"),
    "product without seller": lambda: _lost("seller"),
}


def integrity_report(t: RetailTables) -> DataFrame:
    """The zero-row checks of the validation step as one expectation frame:
    ``(check, n_rows, passed)`` -- duplicate keys and orphans, all expected empty.

    One scan of each table and one shuffle (:func:`key_census`).
    """
    found = key_census(t).agg(*[count().alias(name) for name, count in INTEGRITY.items()])
    rows = [F.struct(F.lit(name).alias("check"), F.col(f"`{name}`").alias("n_rows")) for name in INTEGRITY]
    return found.select(F.inline(F.array(*rows))).select("check", "n_rows", (F.col("n_rows") == 0).alias("passed"))


def validation_report(t: RetailTables, tolerance: str = THRESHOLDS.reconcile_tolerance,
                      status: str = LABELS.completed) -> DataFrame:
    """The whole validation step as one frame ``(check, n_rows, passed)`` from one
    :func:`key_census`: the checks of :func:`integrity_report`, orders off the sum of their
    items and of their ``status`` items, orders without such an item, and the number of items
    of each status (``passed`` is NULL: nothing is expected of them).

    Orders that repeat with different amounts can't be judged by their extreme amounts;
    their rows alone are read again and compared one by one.
    """
    census = key_census(t, money=True, status=status)
    limit = F.lit(tolerance).cast("decimal(18,2)")
    keyed = F.col("key").isNotNull()
    done = F.when(keyed & F.col("done").isNotNull(), F.col("done")).otherwise(F.lit(0))
    is_order = F.col("kind") == "order"
    one_amount = is_order & (F.col("low") == F.col("high"))

    def off(against: Column, among: Column) -> Column:
        wrong = one_amount & among & (F.abs(F.col("low") - against) > limit)
        return F.coalesce(F.sum(F.when(wrong, F.col("amounts"))), F.lit(0))

    mixed = census.where(is_order & (F.col("low") < F.col("high"))).select("key", "total", done.alias("done"), "children")
    amount = F.col("subtotal_amount")
    again = mixed.join(t.orders.select("order_id", "subtotal_amount"), F.col("key").eqNullSafe(F.col("order_id"))).agg(
        F.count_if(F.col("key").isNotNull() & (F.col("children") > 0) & (F.abs(amount - F.col("total")) > limit)).alias("all"),
        F.count_if(F.abs(amount - F.col("done")) > limit).alias("done"))
    extra = again.select(F.struct("all", "done")).scalar()
    checks = {name: count() for name, count in INTEGRITY.items()}
    checks["order off its items"] = off(F.col("total"), keyed & (F.col("children") > 0))
    checks["order off its completed items"] = off(done, F.lit(True))
    without = is_order & (F.col("key").isNull() | (F.col("done_items") == 0))
    checks["order without completed item"] = F.coalesce(F.sum(F.when(without, F.col("parents"))), F.lit(0))
    found = census.groupBy("label", (F.col("kind") == "status").alias("is_status")) \
        .agg(*[c.alias(name) for name, c in checks.items()], F.sum("children").alias("items")).withColumn("extra", extra)
    more = {"order off its items": F.col("extra.all"), "order off its completed items": F.col("extra.done")}
    rows = [F.struct(F.lit(name).alias("check"), (F.col(f"`{name}`") + more.get(name, F.lit(0))).cast("bigint").alias("n_rows"),
                     F.lit(True).alias("expected")) for name in checks]
    of_status = F.struct(F.concat(F.lit("items "), F.coalesce("label", F.lit("without status"))).alias("check"),
                         F.col("items").alias("n_rows"), F.lit(False).alias("expected"))
    each = found.select(F.inline(F.when(F.col("is_status"), F.array(of_status)).otherwise(F.array(*rows))))
    return each.select("check", "n_rows", F.when(F.col("expected"), F.col("n_rows") == 0).alias("passed"))


def expect_empty(df: DataFrame, name: str) -> DataFrame:
    """One-row expectation frame: ``(check, n_rows, passed)``."""
    return df.agg(F.count(F.lit(1)).alias("n_rows")).select(
        F.lit(name).alias("check"), "n_rows", (F.col("n_rows") == 0).alias("passed"))


def quarantine_report(t: RetailTables) -> DataFrame:
    """Rows loaded and set aside per table, ``(table_name, n_rows, n_set_aside, passed)``."""
    loaded = reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        for name, df in t.as_dict().items()])
    if t.quarantine is None:
        aside = loaded.select(F.col("table_name").alias("aside"), F.lit(0).cast("bigint").alias("n")).limit(0)
    else:
        aside = t.quarantine.groupBy(F.col("table_name").alias("aside")).agg(F.count(F.lit(1)).alias("n"))
    n = F.coalesce("n", F.lit(0).cast("bigint"))
    return loaded.join(aside, F.col("table_name") == F.col("aside"), "left") \
        .select("table_name", "n_rows", n.alias("n_set_aside"), (n == 0).alias("passed"))


def expect_value(df: DataFrame, value: str, expected, name: str, tolerance: float = 0.0) -> DataFrame:
    """Expectation frame ``(check, value, expected, passed)`` for a one-row frame's column.

    ``expected`` is a number or a column of ``df``; the two may differ by ``tolerance``.
    """
    want = (F.col(expected) if isinstance(expected, str) else F.lit(expected)).cast("double")
    got = F.col(value).cast("double")
    return df.select(F.lit(name).alias("check"), got.alias("value"), want.alias("expected"),
                     F.coalesce(F.abs(got - want) <= tolerance, F.lit(False)).alias("passed"))


def expect_constant(df: DataFrame, low: str, high: str, label: str, name: str) -> DataFrame:
    """Expectation frame: ``low`` equals ``high`` on every row (``label`` names the row)."""
    return df.select(F.concat(F.lit(f"{name}: "), F.col(label).cast("string")).alias("check"),
                     F.col(high).cast("double").alias("value"), F.col(low).cast("double").alias("expected"),
                     F.coalesce(F.col(low) == F.col(high), F.lit(False)).alias("passed"))


def expectations(t: RetailTables, seg: DataFrame, sized: DataFrame) -> DataFrame:
    """The analysis' assertions as one frame ``(check, value, expected, passed)``.

    Every customer has one band and one segment, shares add up to 100, the customers'
    money is the orders' realized revenue, and the catalog size is constant per group.
    """
    from basketlens.operators.customers import band_summary, segment_summary
    from basketlens.operators.facts import realized_orders

    eligible = seg.select(F.count(F.lit(1))).scalar()
    revenue = realized_orders(t).select(F.sum("revenue")).scalar()
    bands = band_summary(seg).agg(F.sum("customers").alias("n"), F.round(F.sum("pct_revenue"), 1).alias("share"))
    segments = segment_summary(seg).agg(F.sum("customers").alias("n"), F.round(F.sum("pct_customers"), 1).alias("share"))
    money = seg.agg(F.sum("monetary").alias("n"))
    return reduce(DataFrame.unionByName, [
        expect_value(bands.withColumn("all", eligible), "n", "all", "customers of all bands"),
        expect_value(segments.withColumn("all", eligible), "n", "all", "customers of all segments"),
        expect_value(bands, "share", 100.0, "revenue share of all bands", 0.5),
        expect_value(segments, "share", 100.0, "customer share of all segments", 0.5),
        expect_value(money.withColumn("all", revenue), "n", "all", "money of all customers", 0.005),
        expect_constant(sized, "min_products", "max_products", "fbs_standard", "catalog size"),
    ])
