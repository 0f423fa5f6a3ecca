"""Metamorphic checks and plan checks on the driver's tables."""

import pytest
from pyspark.sql import functions as F

from basketlens.operators import categories as ca
from basketlens.operators import customers as cu
from basketlens.operators import facts
from basketlens.plans import catalog


def test_revenue_totals_agree(spark, small_tables):
    t = small_tables
    seg = cu.customer_segments(t)
    total = facts.completed_items(t).agg(F.sum("line_total")).collect()[0][0]
    by_customer = seg.agg(F.sum("monetary")).collect()[0][0]
    by_category = ca.customer_category(t).agg(F.sum("revenue")).collect()[0][0]
    by_cell = ca.segment_category_revenue(t, seg).agg(F.sum("revenue")).collect()[0][0]
    assert total == by_customer == by_category == by_cell


def test_segment_counts_sum_to_eligible(spark, small_tables):
    seg = cu.customer_segments(small_tables)
    n = seg.count()
    assert sum(r.customers for r in cu.segment_summary(seg).collect()) == n
    assert sum(r.customers for r in cu.band_counts(seg).collect()) == n
    assert abs(sum(r.pct_customers for r in cu.band_summary(seg).collect()) - 100) < 0.3


def test_over_index_weighted_by_baseline_is_one(spark, small_tables):
    seg = cu.customer_segments(small_tables)
    cells = ca.segment_category_revenue(small_tables, seg)
    oc = ca.overall_category_share(cells)
    from basketlens.operators.ratios import over_index
    oi = over_index(cells, "customer_segment", "category", "revenue").join(oc, "category")
    sums = oi.groupBy("customer_segment").agg(F.sum(F.col("_over_index") * F.col("overall_share")).alias("s"))
    # segments that bought every category weight to exactly one
    for r in sums.collect():
        assert r.s <= 1.0 + 1e-9


PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "FlatMapGroupsInPandas", "MapInPandas")


@pytest.mark.parametrize("name", sorted(catalog.registry()))
def test_plans_have_no_python_udf_and_no_cartesian(spark, name):
    df = catalog.registry()[name](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert not any(node in plan for node in PY_NODES)
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", ["orphan_items_order", "orphan_items_product", "orphan_orders_customer",
                                  "orders_without_completed"])
def test_anti_joins(spark, name):
    df = catalog.registry()[name](spark, "/root/testdata/sf0.001")
    assert "LeftAnti" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["band_summary", "category_mix", "gap_mid", "seller_metrics",
                                  "rfm_score_tie_split", "product_segment_share"])
def test_repartitioned_inputs_give_same_result(spark, small_tables, name):
    from basketlens.plans.export import portable
    from basketlens.sources.tables import RetailTables
    shuffled = RetailTables.from_dict({k: v.repartition(7, F.rand(11)) for k, v in small_tables.as_dict().items()})
    fresh = RetailTables.from_dict(small_tables.as_dict())
    a = portable(catalog.TABLE_QUERIES[name](fresh))
    b = portable(catalog.TABLE_QUERIES[name](shuffled))
    assert sorted(map(tuple, a.collect()), key=repr) == sorted(map(tuple, b.collect()), key=repr)


def test_materialized_suite_matches_lazy(spark):
    from basketlens.plans.export import portable
    from basketlens.sources.tables import RetailTables
    lazy = RetailTables.from_test_tables(spark, "/root/testdata/sf0.001")
    eager = RetailTables.from_test_tables(spark, "/root/testdata/sf0.001")
    eager.persist_derived = True
    for name in ("segment_summary", "category_over_index", "seller_type_means", "purchase_gaps",
                 "status_mix_seller_type", "seller_floor", "rfm_score", "status_mix", "reconcile_completed",
                 "reconcile_all", "orders_without_completed", "rfm_base"):
        a = portable(catalog.TABLE_QUERIES[name](lazy)).collect()
        b = portable(catalog.TABLE_QUERIES[name](eager)).collect()
        assert sorted(map(tuple, a), key=repr) == sorted(map(tuple, b), key=repr), name


def test_bucketed_customer_tables_join_without_shuffle(spark):
    from basketlens.sources.tables import RetailTables
    prev = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        t = RetailTables.from_test_tables(spark, "/root/testdata/sf0.001")
        t.persist_derived = True
        seg = cu.customer_segments(t)
        df = ca.segment_category_revenue(t, seg)
        plan = df._jdf.queryExecution().executedPlan().toString()
        join_part = plan[plan.index("SortMergeJoin"):]
        assert "Exchange" not in join_part          # both sides read bucketed files
        assert join_part.count("Bucketed: true") == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", prev)
