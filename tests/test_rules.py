"""Unit tests for the customer rules on hand-made rows (one per trap)."""

import datetime as dt

from pyspark.sql import functions as F

from basketlens.config import LABELS
from basketlens.functions import customer_segment, freq_band, tenure_group
from basketlens.operators import customers as cu
from tests.helpers import d, tables


def _seg_of(spark, rows):
    df = spark.createDataFrame(rows, "f long, r long, tenure string")
    return [x[0] for x in df.select(customer_segment("f", "r", "tenure")).collect()]


def test_band_edges(spark):
    fs = [1, 2, 3, 4, 5, 6, 8, 9, 19]
    df = spark.createDataFrame([(f,) for f in fs], "f long")
    got = [x[0] for x in df.select(freq_band("f")).collect()]
    L = LABELS
    assert got == [L.band_1, L.band_2_3, L.band_2_3, L.band_4_5, L.band_4_5,
                   L.band_6_8, L.band_6_8, L.band_9_plus, L.band_9_plus]


def test_segment_edges(spark):
    E = LABELS.tenure_established
    rows = [(1, 90, E), (1, 91, E), (2, 180, E), (2, 181, E), (5, 180, E), (5, 181, E),
            (6, 90, E), (6, 91, E)]
    L = LABELS
    assert _seg_of(spark, rows) == [L.seg_b5, L.seg_b6, L.seg_b3, L.seg_b4, L.seg_b3, L.seg_b4,
                                    L.seg_b1, L.seg_b2]


def test_null_recency_falls_to_b4(spark):
    E = LABELS.tenure_established
    assert _seg_of(spark, [(1, None, E), (6, None, E), (3, None, E)]) == [LABELS.seg_b4] * 3


def test_tenure_wins_over_everything(spark):
    assert _seg_of(spark, [(6, 200, LABELS.tenure_recent)]) == [LABELS.seg_b0]


def test_tenure_null_registration_and_month_end_clamp(spark):
    df = spark.createDataFrame([(None,), (d("2024-02-29"),), (d("2024-02-28"),)], "reg date")
    got = [x[0] for x in df.select(tenure_group("reg", F.lit(dt.date(2024, 5, 31)))).collect()]
    assert got == [LABELS.tenure_established, LABELS.tenure_recent, LABELS.tenure_established]


def test_asof_set_by_cancelled_order_and_recent_customer_in_watchlist(spark):
    t = tables(
        spark,
        customers=[(1, "2020-01-01"), (2, "2024-05-01")],
        orders=[(10, 1, "2024-01-01", 5), (11, 1, "2024-06-30", 5)]
        + [(20 + i, 2, "2023-11-01", 5) for i in range(6)],
        items=[(100, 10, 1, "Completed", 5), (101, 11, 1, "Cancelled", 5)]
        + [(200 + i, 20 + i, 1, "Completed", 5) for i in range(6)],
        products=[(1, "p", "Home", 1)], sellers=[(1, "Company", "FBS")])
    seg = {r.customer_id: r for r in cu.customer_segments(t).collect()}
    assert seg[1].frequency == 1 and seg[1].recency == 181      # as-of = 2024-06-30 (cancelled)
    assert seg[2].frequency == 6 and seg[2].recency == 242
    assert seg[2].tenure_group == LABELS.tenure_recent and seg[2].customer_segment == LABELS.seg_b0
    w = cu.watchlist(cu.customer_segments(t)).collect()[0]
    assert w.watchlist_customers == 1                            # the B0 customer is in it


def test_frequency_counts_orders_not_items(spark):
    t = tables(
        spark, customers=[(1, "2020-01-01")],
        orders=[(10, 1, "2024-01-01", 30)],
        items=[(100, 10, 1, "Completed", 10), (101, 10, 2, "Completed", 20), (102, 10, 2, "Refunded", 1)],
        products=[(1, "a", "Home", 1), (2, "b", "Beauty", 1)], sellers=[(1, "Company", "FBS")])
    r = cu.rfm_base(t).collect()[0]
    assert r.frequency == 1 and float(r.monetary) == 30.0 and r.recency == 0


def _segment_rule(f, r, tenure):
    """The segment rules as a plain Python function (first match wins, SQL NULL logic)."""
    L = LABELS
    if tenure == L.tenure_recent:
        return L.seg_b0
    le = lambda a, b: a is not None and b is not None and a <= b
    gt = lambda a, b: a is not None and b is not None and a > b
    if f == 1 and le(r, 90):
        return L.seg_b5
    if f == 1 and gt(r, 90):
        return L.seg_b6
    if f is not None and f >= 6 and le(r, 90):
        return L.seg_b1
    if f is not None and f >= 6 and gt(r, 90):
        return L.seg_b2
    if f is not None and 2 <= f <= 5 and le(r, 180):
        return L.seg_b3
    return L.seg_b4


def test_segment_rules_match_python_model(spark):
    import random
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 2, 3, 4, 5, 6, 7, 9, 19]),
             rng.choice([None, 0, 89, 90, 91, 179, 180, 181, 400]),
             rng.choice([LABELS.tenure_recent, LABELS.tenure_established]))
            for _ in range(400)]
    got = _seg_of(spark, rows)
    assert got == [_segment_rule(*row) for row in rows]


def test_sql_views_over_derived_tables(spark, small_tables):
    small_tables.register_views(prefix="sv_", derived=True)
    n = spark.sql("SELECT COUNT(*) FROM sv_customer_segments WHERE frequency >= 6 AND recency > 180").first()[0]
    assert n == cu.watchlist(cu.customer_segments(small_tables)).first().watchlist_customers == 32
