"""Sources and sinks: CSV read with a fixed schema, row counts, materialization."""

import os
import tempfile

import pytest

from basketlens.sources.loaders import materialize, row_counts
from basketlens.sources.tables import RetailTables


def test_csv_round_trip_and_row_counts(spark, small_tables):
    out = tempfile.mkdtemp(prefix="basketlens-csv-")
    for name, df in small_tables.as_dict().items():
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(out, f"{name}.csv"))
    back = RetailTables.from_csv(spark, out)
    assert back.orders.schema["order_date"].dataType.typeName() == "date"
    a = {r.table_name: r.n_rows for r in row_counts(back.as_dict()).collect()}
    b = {r.table_name: r.n_rows for r in row_counts(small_tables.as_dict()).collect()}
    assert a == b == {"customers": 150, "orders": 1500, "order_items": 6000, "products": 200, "sellers": 10}
    assert back.orders.exceptAll(small_tables.orders.select(back.orders.columns)).count() == 0


def test_materialize_cuts_lineage(spark, small_tables):
    df = small_tables.orders.groupBy("customer_id").count()
    m = materialize(df, "unit")
    assert m.count() == df.count()
    plan = m._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan                   # read back from files, not recomputed


def test_csv_dates_with_time_part_are_cut_to_date(spark):
    out = tempfile.mkdtemp(prefix="basketlens-csv2-")
    with open(os.path.join(out, "customers.csv"), "w") as f:
        f.write("customer_id,registration_date\n1,2024-01-31 18:02:11\n2,2024-02-01\n3,\n")
    for name, header in (("orders", "order_id,customer_id,order_date,subtotal_amount,total_amount"),
                         ("order_items", "order_item_id,order_id,product_id,item_status,line_total"),
                         ("products", "product_id,product_name,category,seller_id"),
                         ("sellers", "seller_id,seller_type,fbs_standard")):
        with open(os.path.join(out, f"{name}.csv"), "w") as f:
            f.write(header + "\n")
    t = RetailTables.from_csv(spark, out)
    got = sorted((r.customer_id, str(r.registration_date)) for r in t.customers.collect())
    assert got == [(1, "2024-01-31"), (2, "2024-02-01"), (3, "None")]


def test_catalog_tables(spark, small_tables):
    for name, df in small_tables.as_dict().items():
        df.createOrReplaceTempView(f"cat_{name}")
    t = RetailTables.from_catalog(spark, names={n: f"cat_{n}" for n in small_tables.as_dict()})
    assert t.order_items.count() == 6000


def test_status_filter_and_pruning_reach_the_parquet_scan(spark, small_tables):
    from basketlens.operators import facts
    out = tempfile.mkdtemp(prefix="basketlens-pq-")
    for name, df in small_tables.as_dict().items():
        df.write.mode("overwrite").parquet(os.path.join(out, f"{name}.parquet"))
    t = RetailTables.from_parquet(spark, out)
    plan = facts.realized_orders(t)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(item_status), EqualTo(item_status,Completed)" in plan
    items_scan = [ln for ln in plan.splitlines() if "order_items.parquet" in ln][0]
    assert "ReadSchema: struct<order_id:bigint,item_status:string,line_total:decimal(18,2)>" in items_scan


def test_cli_writes_every_result(spark):
    from basketlens import cli
    from basketlens.plans import catalog
    out = tempfile.mkdtemp(prefix="basketlens-out-")
    t = RetailTables.from_test_tables(spark, "/root/testdata/sf0.001")
    names = ["band_summary", "category_over_index", "seller_metrics", "purchase_gaps"]
    timings = cli.run_all(t, out, names)
    assert set(timings) == set(names)
    for n in names:
        back = spark.read.parquet(os.path.join(out, n))
        if n in catalog.ORDERED:                 # written results carry their order
            back = back.orderBy("position")
            assert [r.position for r in back.collect()] == list(range(1, back.count() + 1))
            back = back.drop("position")
            assert list(map(tuple, back.collect())) == list(map(tuple, catalog.run(n, spark, "/root/testdata/sf0.001").collect()))
        assert sorted(map(tuple, back.collect()), key=repr) == \
            sorted(map(tuple, catalog.run(n, spark, "/root/testdata/sf0.001").collect()), key=repr)


def test_drop_materialized_tables_removes_this_runs_only(spark, small_tables, monkeypatch):
    from basketlens.sources import loaders
    kept = materialize(small_tables.sellers, "kept", bucket_by=("seller_id",), buckets=2)
    monkeypatch.setattr(loaders, "RUN", "droptest")
    gone = materialize(small_tables.customers, "gone", bucket_by=("customer_id",), buckets=2)
    folder = os.path.dirname(gone.inputFiles()[0].removeprefix("file:").replace("//", "/"))
    dropped = loaders.drop_materialized_tables(spark)
    assert dropped and all(n.startswith("basketlens_droptest_") for n in dropped)
    assert not os.path.exists(folder)
    assert kept.count() == 10


def test_missing_column_is_named(spark, small_tables):
    small_tables.orders.drop("customer_id").createOrReplaceTempView("lacking_orders")
    names = {n: f"cat2_{n}" for n in small_tables.as_dict()} | {"orders": "lacking_orders"}
    for name, df in small_tables.as_dict().items():
        df.createOrReplaceTempView(f"cat2_{name}")
    with pytest.raises(ValueError, match="orders lacks customer_id"):
        RetailTables.from_catalog(spark, names=names)


def test_keys_of_any_type(spark):
    from pyspark.sql import types as T

    from basketlens.sources.loaders import read_csv_tables
    out = tempfile.mkdtemp(prefix="basketlens-csv3-")
    for name, text in (("customers", "customer_id,registration_date\nC-1,2024-01-31\n"),
                       ("orders", "order_id,customer_id,order_date,subtotal_amount,total_amount\nO-7,C-1,2024-02-01,5,5\n"),
                       ("order_items", "order_item_id,order_id,product_id,item_status,line_total\nI-1,O-7,P,Completed,5\n"),
                       ("products", "product_id,product_name,category,seller_id\nP,p,Home,S\n"),
                       ("sellers", "seller_id,seller_type,fbs_standard\nS,Company,FBS\n")):
        with open(os.path.join(out, f"{name}.csv"), "w") as f:
            f.write(text)
    t = RetailTables.from_dict(read_csv_tables(spark, out, key_type=T.StringType()))
    from basketlens.operators import categories as ca
    assert [tuple(r) for r in ca.customer_category(t).collect()][0][:3] == ("Home", "C-1", 1)


def test_money_sums_are_exact(spark):
    from decimal import Decimal

    from pyspark.sql import functions as F

    from basketlens.functions import money_sum, money_total
    big = spark.createDataFrame([(Decimal("9000000000000000.01"),)] * 11, "v decimal(18,2)")
    odd = spark.createDataFrame([(0.29,), (1.15,), (0.57,)], "v double")
    ansi = spark.conf.get("spark.sql.ansi.enabled")
    try:
        for mode in ("true", "false"):
            spark.conf.set("spark.sql.ansi.enabled", mode)
            assert big.agg(money_sum("v")).first()[0] == Decimal("99000000000000000.11")
            again = big.groupBy("v").agg(money_sum("v").alias("s")).agg(money_total(F.col("s") * 3))
            assert again.first()[0] == Decimal("297000000000000000.33")
            assert odd.agg(money_sum("v")).first()[0] == Decimal("2.01")
    finally:
        spark.conf.set("spark.sql.ansi.enabled", ansi)


def test_derived_tables_are_told_apart(spark, small_tables):
    t = RetailTables.from_dict(small_tables.as_dict())
    lazy = t.derived("twice", lambda tt: tt.sellers)
    stored = t.derived("twice", lambda tt: tt.sellers, persist=True)
    assert lazy is not stored and t.derived("twice", None) is lazy


def test_stored_sources_match_the_mapping(spark, small_tables):
    stored = small_tables.stored()
    for name, df in small_tables.as_dict().items():
        back = getattr(stored, name)
        assert [(f.name, f.dataType) for f in back.schema] == [(f.name, f.dataType) for f in df.schema]
        assert back.exceptAll(df).count() == 0 and df.exceptAll(back).count() == 0


# ---------------------------------------------------------------- lines that do not fit
CSV = {
    "customers": ["customer_id,registration_date", "C-1,2024-01-31 10:00:00", ",2024-01-01", "C-2,2024-02-30", "C-3,"],
    "orders": ["order_id,customer_id,order_date,subtotal_amount,total_amount", "O-1,C-1,2024-02-01,5,5",
               "O-2,C-1,2024-02-01,five,5", "O-3,C-1,2024-02-01", "O-4,C-1,2024-02-01,5,5,6"],
    "order_items": ["order_item_id,order_id,product_id,item_status,line_total", "I-1,O-1,P,Completed,5"],
    "products": ["product_id,product_name,category,seller_id", 'P,"a, b",Home,S'],
    "sellers": ["seller_id,seller_type,fbs_standard", "S,Company,FBS"],
}


@pytest.fixture()
def messy_folder():
    out = tempfile.mkdtemp(prefix="basketlens-csv4-")
    for name, lines in CSV.items():
        with open(os.path.join(out, f"{name}.csv"), "w") as f:
            f.write("\n".join(lines) + "\n")
    return out


def test_bad_lines_are_set_aside(spark, messy_folder):
    from pyspark.sql import types as T

    from basketlens.operators import quality as qa
    t = RetailTables.from_csv(spark, messy_folder, key_type=T.StringType(), set_bad_rows_aside=True)
    assert sorted((r.customer_id, str(r.registration_date)) for r in t.customers.collect()) == [("C-1", "2024-01-31"), ("C-3", "None")]
    assert [r.order_id for r in t.orders.select("order_id").collect()] == ["O-1"]        # judged whole
    assert t.products.first().product_name == "a, b"
    aside = sorted(map(tuple, t.quarantine.collect()))
    assert [(n, r.split(",")[0].strip('"')) for n, r in aside] == [
        ("customers", ""), ("customers", "C-2"), ("orders", "O-2"), ("orders", "O-3"), ("orders", "O-4")]
    got = {r.table_name: (r.n_rows, r.n_set_aside, r.passed) for r in qa.quarantine_report(t).collect()}
    assert got == {"customers": (2, 2, False), "orders": (1, 3, False), "order_items": (1, 0, True),
                   "products": (1, 0, True), "sellers": (1, 0, True)}


def test_bad_lines_stop_the_load_otherwise(spark, messy_folder):
    from pyspark.sql import types as T
    t = RetailTables.from_csv(spark, messy_folder, key_type=T.StringType())
    with pytest.raises(Exception, match="Malformed records"):
        t.orders.collect()


# ---------------------------------------------------------------- published by name
def test_published_versions(spark):
    from basketlens.sources import published
    name = f"pub_{os.getpid()}"
    frame = lambda *v: spark.createDataFrame([(x,) for x in v], "x long")
    first = published.publish(frame(1, 2), name, bucket_by=("x",), buckets=2)
    other = spark.newSession()
    before = published.read(other, name)
    published.publish(frame(3), name)
    assert sorted(r.x for r in before.collect()) == [1, 2]            # goes on with its version
    assert [r.x for r in published.read(other, name).collect()] == [3]
    third = published.publish(frame(4, 5, 6), name)
    assert published.retire(spark, name, keep=2) == [first]
    assert len(published.versions(spark, name)) == 2 and published.versions(spark, name)[-1] == third
    published.roll_back(spark, name, published.versions(spark, name)[0])
    assert [r.x for r in published.read(other, name).collect()] == [3]
    with pytest.raises(ValueError):
        published.roll_back(spark, name, first)
    published.unpublish(spark, name)
    assert published.versions(spark, name) == [] and not spark.catalog.tableExists(name)


def test_analysis_tables_are_published(spark, small_tables):
    from basketlens.operators import customers as cu
    from basketlens.sources import published
    t = RetailTables.from_dict(small_tables.as_dict())
    names = t.publish(prefix=f"p{os.getpid()}_")
    assert set(names) == {"customer_rfm_base", "customer_segments", "seller_metrics"}
    back = spark.newSession().table(f"p{os.getpid()}_customer_segments")
    assert back.exceptAll(cu.customer_segments(t)).count() == 0
    joined = spark.table(f"p{os.getpid()}_customer_rfm_base").join(
        spark.table(f"p{os.getpid()}_customer_segments").select("customer_id", "customer_segment"), "customer_id").hint("merge")
    assert joined.count() == back.count()
    for name in names:
        published.unpublish(spark, f"p{os.getpid()}_{name}")


# ---------------------------------------------------------------- bucket planning
def test_bucket_counts():
    from basketlens.sources.loaders import BUCKET_BYTES, bucket_count
    assert bucket_count(None, 8, 200) == 200
    assert bucket_count(0, 8, 200) == bucket_count(900_000, 8, 200) == 1
    assert bucket_count(5 << 20, 8, 200) == 8 and bucket_count(300 << 20, 8, 200) == 8
    assert bucket_count(100 * BUCKET_BYTES, 8, 200) == 128


def test_buckets_follow_from_bytes_and_joins_need_no_shuffle(spark):
    from basketlens.operators import categories as ca
    from basketlens.operators import customers as cu
    from basketlens.sources.loaders import measured_bytes
    t = RetailTables.from_test_tables(spark, "/root/testdata/sf0.01")
    assert measured_bytes(t.customers) == os.path.getsize("/root/testdata/sf0.01/customer.parquet")
    assert measured_bytes(spark.range(3)) is None
    stored = t.stored()
    stored.persist_derived = True
    assert stored._buckets == {"order_id": 1, "customer_id": 1} and len(stored.order_items.inputFiles()) == 1
    seg, cc = cu.customer_segments(stored), ca.customer_category(stored)
    assert len(seg.inputFiles()) == 1
    keep = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = cc.join(seg.select("customer_id", "customer_segment"), "customer_id")._jdf.queryExecution().executedPlan().toString()
        items = stored.order_items.join(stored.orders, "order_id")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", keep)
    assert "Exchange" not in plan and "Exchange" not in items


def test_positions_over_many_partitions(spark):
    from pyspark.sql import functions as F

    from basketlens.sources.loaders import with_position
    df = spark.range(5000).select(F.xxhash64("id").alias("v")).repartition(13).orderBy("v")
    got = [(r.position, r.v) for r in with_position(df).orderBy("position").collect()]
    assert [p for p, _ in got] == list(range(1, 5001)) and [v for _, v in got] == sorted(v for _, v in got)


def test_collated_labels(spark, small_tables):
    from basketlens.operators import customers as cu
    from basketlens.operators import sellers as se
    from basketlens.sources import fixture
    t = RetailTables.from_dict(fixture.mixed_case(small_tables.as_dict())).collated("UTF8_LCASE")
    want, got = cu.rfm_base(small_tables).collect(), cu.rfm_base(t).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 10
    plain = RetailTables.from_dict(fixture.mixed_case(small_tables.as_dict()))
    assert cu.rfm_base(plain).agg({"frequency": "sum"}).first()[0] < sum(r.frequency for r in want)
    assert se.seller_ratios(se.seller_metrics(t)).first() == se.seller_ratios(se.seller_metrics(small_tables)).first()


def test_test_threshold_stays_in_the_registry(spark, small_tables):
    from basketlens.plans import catalog
    assert catalog.TABLE_QUERIES["top_products"](small_tables).count() == 0       # no product has 100 buyers
    assert catalog.run("top_products", spark, "/root/testdata/sf0.001").count() > 0


def test_category_columns_are_bounded(spark, small_tables):
    from basketlens.operators import categories as ca
    from basketlens.operators import customers as cu
    seg = cu.customer_segments(small_tables)
    with pytest.raises(ValueError, match="more than 3 categories"):
        ca.over_index_wide(small_tables, seg, most=3)
    assert ca.over_index_wide(small_tables, seg, ["Home", "Garden"]).columns == ["customer_segment", "Home", "Garden"]
