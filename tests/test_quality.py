"""Data-quality operators on hand-made rows."""


from basketlens.operators import quality as qa
from basketlens.operators import sellers as se
from basketlens.operators import categories as ca
from basketlens.functions import safe_div, pct
from tests.helpers import tables


def _t(spark):
    return tables(
        spark,
        customers=[(1, "2020-01-01")],
        orders=[(10, 1, "2024-01-01", 30), (11, 1, "2024-01-02", 7), (11, 1, "2024-01-02", 7),
                (12, 2, "2024-01-03", 0)],
        items=[(100, 10, 1, "Completed", 10), (101, 10, 2, "Completed", 20),
               (102, 13, 1, "Completed", 1), (103, 11, 9, "Cancelled", 7)],
        products=[(1, "a", "Home", 1), (2, "b", "Beauty", 1), (3, "c", "Home", 5)],
        sellers=[(1, "Company", "FBS"), (2, "Individual", "Standard")])


def test_duplicate_keys(spark):
    rows = qa.duplicate_keys(_t(spark).orders, "order_id").collect()
    assert [(r.order_id, r.n) for r in rows] == [(11, 2)]


def test_orphans_one_row_per_child(spark):
    t = _t(spark)
    assert [r.order_id for r in qa.orphans(t.order_items, t.orders, "order_id").collect()] == [13]
    assert [r.product_id for r in qa.orphans(t.order_items, t.products, "product_id").collect()] == [9]
    assert [r.customer_id for r in qa.orphans(t.orders, t.customers, "customer_id").collect()] == [2]


def test_orphans_plan_is_anti_join(spark):
    t = _t(spark)
    plan = qa.orphans(t.order_items, t.orders, "order_id")._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan


def test_reconcile_inner_vs_left(spark):
    t = tables(
        spark, customers=[(1, "2020-01-01")],
        orders=[(10, 1, "2024-01-01", 30), (11, 1, "2024-01-01", 5), (12, 1, "2024-01-01", 0.04)],
        items=[(100, 10, 1, "Completed", 10), (101, 10, 1, "Cancelled", 20)],
        products=[(1, "a", "Home", 1)], sellers=[(1, "Company", "FBS")])
    assert qa.mismatch_count(t, completed_only=False).collect()[0][0] == 0   # 11, 12 have no items
    # completed only, left join: 10 (30 vs 10), 11 (5 vs 0); 12 is within tolerance
    assert qa.mismatch_count(t, completed_only=True).collect()[0][0] == 2


def test_without_match(spark):
    r = qa.without_match(_t(spark)).collect()[0]
    assert r.orders_with_no_completed_items == 3 and r.pct_of_all_orders == 75.0


def test_seller_without_products_is_absent(spark):
    t = _t(spark)
    assert {r.fbs_standard for r in se.confound_check(t).collect()} == {"FBS"}
    assert [r.seller_id for r in se.seller_metrics(t).collect()] == [1]


def test_zero_denominator_gives_null(spark):
    df = spark.createDataFrame([(1.0, 0.0)], "a double, b double")
    r = df.select(safe_div("a", "b").alias("x"), pct("a", "b").alias("y")).collect()[0]
    assert r.x is None and r.y is None


def test_order_spanning_two_categories_counts_in_each(spark):
    t = _t(spark)
    mix = {r.category: r for r in ca.category_mix(t).collect()}
    assert mix["Home"].unique_orders == 1 and mix["Beauty"].unique_orders == 1


def test_implication_violations(spark):
    df = spark.createDataFrame([(1, True, 5), (2, True, None), (3, False, 7), (4, False, None), (5, None, None)],
                               "id int, is_campaign boolean, campaign_id int")
    got = {(r.id, r.violation) for r in qa.implication_violations(df, "is_campaign", "campaign_id").collect()}
    assert got == {(2, "flag_without_ref"), (3, "ref_without_flag")}


def test_status_mix_sums_to_100(spark, small_tables):
    rows = qa.status_mix(small_tables).collect()
    assert abs(sum(r.pct_of_items for r in rows) - 100.0) < 0.2


def _report(df):
    return {r.check: (r.n_rows, r.passed) for r in df.collect()}


def test_validation_in_one_pass(spark):
    got = _report(qa.validation_report(_t(spark)))
    assert got == {
        "duplicate order_id": (1, False), "duplicate order_item_id": (0, True), "item without order": (1, False),
        "item without product": (1, False), "order without customer": (1, False), "product without seller": (1, False),
        "order off its items": (0, True), "order off its completed items": (2, False), "order without completed item": (3, False),
        "items Completed": (3, None), "items Cancelled": (1, None)}
    integrity = _report(qa.integrity_report(_t(spark)))
    assert integrity == {k: v for k, v in got.items() if k in integrity} and len(integrity) == 6


def test_validation_equals_the_single_checks_on_odd_rows(spark):
    """NULL keys and amounts, orders that repeat with different amounts, empty tables."""
    import random
    r = random.Random(4)
    pick = lambda *v: r.choice(v)
    orders = [(pick(1, 2, 3, 4, 5, 6, 7, 8, None), pick(1, 2, None), "2024-01-01", pick(10, 10, 20, 0, 0.04)) for _ in range(40)]
    items = [(pick(100 + k, 100), pick(1, 2, 3, 4, 5, 9, None), pick(1, 2, None), pick("Completed", "Cancelled", None), pick(10, 5))
             for k in range(40)]
    t = tables(spark, customers=[(1, "2020-01-01")], orders=[], items=[],
               products=[(1, "a", "Home", 1), (2, "b", "Home", None)], sellers=[(1, "Company", "FBS")])
    from tests.helpers import d, m
    key = "order_id long, customer_id long, order_date date, subtotal_amount decimal(18,2), total_amount decimal(18,2)"
    t.orders = spark.createDataFrame([(o, c, d(x), m(a) if r.random() < 0.9 else None, None) for o, c, x, a in orders], key)
    t.order_items = spark.createDataFrame(
        [(i, o, p, s, m(v)) for i, o, p, s, v in items],
        "order_item_id long, order_id long, product_id long, item_status string, line_total decimal(18,2)")
    got = {k: n for k, (n, _) in _report(qa.validation_report(t)).items()}
    assert got["order off its items"] == qa.mismatch_count(t, completed_only=False).first()[0] > 0
    assert got["order off its completed items"] == qa.mismatch_count(t, completed_only=True).first()[0] > 0
    assert got["order without completed item"] == qa.without_match(t).first()[0] > 0
    assert got["duplicate order_id"] == qa.duplicate_keys(t.orders, "order_id").count()
    assert got["duplicate order_item_id"] == qa.duplicate_keys(t.order_items, "order_item_id").count()
    for name, child, parent, column in (("item without order", t.order_items, t.orders, "order_id"),
                                        ("item without product", t.order_items, t.products, "product_id"),
                                        ("order without customer", t.orders, t.customers, "customer_id"),
                                        ("product without seller", t.products, t.sellers, "seller_id")):
        assert got[name] == qa.orphans(child, parent, column).count()
    assert {k: n for k, n in got.items() if k.startswith("items ")} == {
        f"items {x.item_status or 'without status'}": x.n_items for x in qa.status_mix(t).collect()}
    empty = tables(spark)
    assert all(n == 0 for n, _ in _report(qa.validation_report(empty)).values())
    assert len(_report(qa.integrity_report(empty))) == 6


def test_validation_scans_each_table_once(spark):
    from basketlens.sources.tables import RetailTables
    t = RetailTables.from_test_tables(spark, "/root/testdata/sf0.001").stored()
    plan = qa.integrity_report(t)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 5 and plan.count("Exchange hashpartitioning") == 1
