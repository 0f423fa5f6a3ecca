"""Values measured under the test-table mapping (FIXTURES.md section 3), as golden checks."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from basketlens.config import LABELS as L
from basketlens.operators import categories as ca
from basketlens.operators import customers as cu
from basketlens.operators import facts
from basketlens.operators import quality as qa
from basketlens.operators import sellers as se
from basketlens.sources.loaders import row_counts
from basketlens.sources.tables import RetailTables

# --- fixed values: measured results per scale factor (FIXTURES.md section 3) ---
GOLDEN = {
    "0.001": dict(rows=(150, 1500, 6000, 200, 10), line_total="317364757.31", dup_items=1161,
                  mismatch_all=147, mismatch_done=1451, no_done=758, eligible=147, floor=(242, 114),
                  status=(17.8, 49.4, 32.8), bands=(6, 32, 51, 52, 6), segments=(92, 3, 19, 11, 21, 0, 1),
                  watchlist=32, watchlist_b0=19, buyers_5=122, standard=(8, 28),
                  gap_mid=(677, 460), gap_median=(677.0, 460.0)),
    "0.01": dict(rows=(1500, 15000, 60000, 2000, 100), line_total="3183256271.63", dup_items=11785,
                 mismatch_all=1472, mismatch_done=14545, no_done=7704, eligible=1487, floor=(124, 123),
                 status=(16.5, 50.1, 33.4), bands=(70, 358, 502, 472, 85),
                 segments=(92, 126, 397, 198, 608, 2, 64), watchlist=324, watchlist_b0=17, buyers_5=1094,
                 standard=(4, 28), gap_mid=(524, 452), gap_median=(523.5, 451.0)),
}


@pytest.fixture(scope="module", params=sorted(GOLDEN))
def case(request, spark):
    t = RetailTables.from_test_tables(spark, f"/root/testdata/sf{request.param}")
    t.persist_derived = True
    return t, GOLDEN[request.param]


def test_sizes_and_validation(case):
    t, g = case
    counts = {r.table_name: r.n_rows for r in row_counts(t.as_dict()).collect()}
    assert tuple(counts[n] for n in ("customers", "orders", "order_items", "products", "sellers")) == g["rows"]
    assert t.order_items.agg(F.sum("line_total")).first()[0] == Decimal(g["line_total"])
    assert qa.duplicate_keys(t.order_items, "order_item_id").count() == g["dup_items"]
    assert qa.mismatch_count(t, completed_only=False).first()[0] == g["mismatch_all"]
    assert qa.mismatch_count(t, completed_only=True).first()[0] == g["mismatch_done"]
    assert qa.without_match(t).first()[0] == g["no_done"]
    mix = {r.item_status: r.pct_of_items for r in qa.status_mix(t).collect()}
    assert (mix[L.completed], mix[L.cancelled], mix[L.refunded]) == g["status"]


def test_customers(case):
    t, g = case
    seg = cu.customer_segments(t)
    assert cu.eligible_customers(seg).first()[0] == g["eligible"]
    bands = {r.freq_band: r.customers for r in cu.band_counts(seg).collect()}
    assert tuple(bands[b] for b in L.bands) == g["bands"]
    segs = {r.customer_segment: r.customers for r in cu.segment_summary(seg).collect()}
    assert tuple(segs.get(s, 0) for s in L.segments) == g["segments"]
    assert cu.watchlist(seg).first().watchlist_customers == g["watchlist"]
    in_b0 = seg.where((F.col("frequency") >= 6) & (F.col("recency") > 180)
                      & (F.col("customer_segment") == L.seg_b0)).count()
    assert in_b0 == g["watchlist_b0"]


def test_products_sellers_gaps(case):
    t, g = case
    buyers = ca.product_customer(t).groupBy("product_id").count()
    assert buyers.where("count >= 5").count() == g["buyers_5"]
    assert buyers.where("count >= 100").count() == 0
    floor = se.seller_floor(t).first()
    assert (floor.min_items_per_seller, floor.min_customers_per_seller) == g["floor"]
    conf = {r.fbs_standard: (r.min_products, r.max_products) for r in se.confound_check(t).collect()}
    assert conf["FBS"] == (16, 16) and conf["Standard"] == g["standard"]
    hist = ca.gap_histogram(t)
    mid = {r.category: r.median_gap_days for r in ca.percent_rank_mid(hist, "category", "days_since_prev").collect()}
    med = {r.category: r.median_gap_days
           for r in ca.median_from_histogram(hist, "category", "days_since_prev").collect()}
    assert (mid["Electronics"], mid["Home"]) == g["gap_mid"]
    assert (med["Electronics"], med["Home"]) == g["gap_median"]


def test_category_revenue_sf001(spark):
    t = RetailTables.from_test_tables(spark, "/root/testdata/sf0.01")
    got = {r.category: r.revenue for r in ca.category_mix(t).collect()}
    assert got == {"Home": 175217314.0, "Fashion": 89837914.0, "Electronics": 89126075.0,
                   "Groceries": 87069219.0, "Beauty": 82287471.0}
    assert facts.completed_items(t).count() == ca.order_category(t).agg(F.sum("n_items")).first()[0]
