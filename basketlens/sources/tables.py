"""The five retail tables as one object, with the shared derived tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.sources import fixture, published
from basketlens.sources.loaders import (as_money, bucket_count, materialize, measured_bytes, read_catalog_tables,
                                       read_csv_checked, read_csv_tables, read_parquet_tables)
from basketlens.sources.schemas import TABLE_SCHEMAS


#: Bucket key -> the source whose bytes decide the number of buckets, and how much wider
#: than it the widest table with that key is.
BUCKET_SOURCES = {"order_id": ("order_items", 1), "customer_id": ("customers", 4)}
#: Columns that hold labels, by table.
LABEL_COLUMNS = {"order_items": ("item_status",), "products": ("category",), "sellers": ("seller_type", "fbs_standard")}


@dataclass
class RetailTables:
    customers: DataFrame
    orders: DataFrame
    order_items: DataFrame
    products: DataFrame
    sellers: DataFrame
    persist_derived: bool = False
    #: Lines of a CSV load that did not fit, ``(table_name, record)``, where they were set aside.
    quarantine: DataFrame | None = None
    _buckets: dict = field(default_factory=dict, repr=False)
    _derived: dict = field(default_factory=dict, repr=False)

    # ---- constructors -------------------------------------------------
    @classmethod
    def from_dict(cls, tables: dict[str, DataFrame]) -> "RetailTables":
        """From five frames; money columns become DECIMAL(18,2) (exact cents)."""
        t = {name: as_money(tables[name], name) for name in TABLE_SCHEMAS}
        return cls(t["customers"], t["orders"], t["order_items"], t["products"], t["sellers"])

    @classmethod
    def from_csv(cls, spark: SparkSession, directory: str, files=None, key_type: T.DataType | None = None,
                 set_bad_rows_aside: bool = False) -> "RetailTables":
        """From CSV exports; ids are read as ``key_type``.  A line that does not fit stops the
        load, or goes to ``quarantine`` with ``set_bad_rows_aside``."""
        if not set_bad_rows_aside:
            return cls.from_dict(read_csv_tables(spark, directory, files, key_type))
        tables, bad = read_csv_checked(spark, directory, files, key_type)
        out = cls.from_dict(tables)
        out.quarantine = bad
        return out

    @classmethod
    def from_parquet(cls, spark: SparkSession, directory: str, key_type: T.DataType | None = None) -> "RetailTables":
        return cls.from_dict(read_parquet_tables(spark, directory, key_type))

    @classmethod
    def from_catalog(cls, spark: SparkSession, database: str | None = None, names=None,
                     key_type: T.DataType | None = None) -> "RetailTables":
        return cls.from_dict(read_catalog_tables(spark, database, names, key_type))

    @classmethod
    def from_test_tables(cls, spark: SparkSession, sf_dir: str) -> "RetailTables":
        return cls.from_dict(fixture.load(spark, sf_dir))

    # ---- helpers ------------------------------------------------------
    def as_dict(self) -> dict[str, DataFrame]:
        return {"customers": self.customers, "orders": self.orders,
                "order_items": self.order_items, "products": self.products,
                "sellers": self.sellers}

    def register_views(self, prefix: str = "", derived: bool = False) -> None:
        """Register the tables as temp views so the SQL API can be used as well.

        With ``derived`` the analysis tables ``customer_rfm_base``,
        ``customer_segments`` and ``seller_metrics`` are registered too (built, and
        materialized if ``persist_derived`` is set), so SQL can build on them.
        """
        for name, df in self.as_dict().items():
            df.createOrReplaceTempView(f"{prefix}{name}")
        if derived:
            from basketlens.operators import customers, sellers
            customers.customer_rfm_base(self).createOrReplaceTempView(f"{prefix}customer_rfm_base")
            customers.customer_segments(self).createOrReplaceTempView(f"{prefix}customer_segments")
            sellers.seller_metrics(self).createOrReplaceTempView(f"{prefix}seller_metrics")

    def stored(self) -> "RetailTables":
        """The five tables written once to the shared folder and read back as Parquet.

        The import step of the analysis: later scans read plain columnar files, so
        the status filter and column pruning reach the scan, and a source that is
        itself a view (such as the test-table mapping) is evaluated once.  Orders and
        items are bucketed on ``order_id``: joins between them need no shuffle.  The number
        of buckets follows from the sources' bytes (:meth:`buckets_for`).
        """
        keys = {"orders": ("order_id",), "order_items": ("order_id",)}
        out = RetailTables.from_dict({
            name: materialize(df, f"source_{name}", bucket_by=keys.get(name, ()),
                              buckets=self.buckets_for(keys[name]) if name in keys else None)
            for name, df in self.as_dict().items()})
        out.persist_derived, out.quarantine = self.persist_derived, self.quarantine
        # tables derived later are bucketed like these
        out._buckets = {key: self.buckets_for((key,)) for key in BUCKET_SOURCES}
        return out

    def buckets_for(self, key: tuple[str, ...]) -> int | None:
        """Buckets of every table that is bucketed on ``key``: the same number for all of them,
        or their joins would need a shuffle.  It comes from the measured bytes of the largest
        source with that key, widened where derived tables have more columns than it."""
        if len(key) != 1 or key[0] not in BUCKET_SOURCES:
            return None
        if key[0] not in self._buckets:
            name, widened = BUCKET_SOURCES[key[0]]
            df = self.as_dict()[name]
            spark = df.sparkSession
            size = measured_bytes(df)
            self._buckets[key[0]] = bucket_count(
                None if size is None else size * widened, spark.sparkContext.defaultParallelism,
                int(spark.conf.get("spark.sql.shuffle.partitions")))
        return self._buckets[key[0]]

    def collated(self, collation: str) -> "RetailTables":
        """The same tables with their labels (statuses, categories, seller attributes) under a
        collation such as ``UTF8_LCASE`` or ``UTF8_LCASE_RTRIM``.

        Every filter and grouping on a label then follows it: ``completed`` is ``Completed``,
        and both are one status.  Such a filter is not pushed down to Parquet.
        """
        tables = self.as_dict()
        for name, columns in LABEL_COLUMNS.items():
            tables[name] = tables[name].withColumns({c: F.collate(c, collation) for c in columns})
        out = RetailTables(**tables, persist_derived=self.persist_derived, quarantine=self.quarantine)
        out._buckets = dict(self._buckets)
        return out

    def publish(self, database: str | None = None, prefix: str = "") -> dict[str, str]:
        """Publish the analysis tables by name (:mod:`published`): ``customer_rfm_base``,
        ``customer_segments``, ``seller_metrics``.  Returns each name's new version."""
        from basketlens.operators import customers, sellers
        own = {"customer_rfm_base": (customers.customer_rfm_base(self), ("customer_id",)),
               "customer_segments": (customers.customer_segments(self), ("customer_id",)),
               "seller_metrics": (sellers.seller_metrics(self), ())}
        return {name: published.publish(df, prefix + name, database=database, bucket_by=key, buckets=self.buckets_for(key))
                for name, (df, key) in own.items()}

    def derived(self, name: str, build, *, persist: bool = False,
                bucket_by: tuple[str, ...] = (), buckets: int | None = None) -> DataFrame:
        """Memoize a derived table on this object, under its name and whether it is stored.

        ``name`` must tell different arguments of ``build`` apart.

        With ``persist=True`` (or ``persist_derived`` set on the object) the table
        is written to the shared folder once (see :func:`materialize`) and later
        uses read the files -- the ``CREATE TABLE AS`` step of the analysis.
        ``bucket_by`` names the key the table is bucketed on when written, so that
        later joins on that key between tables bucketed alike need no shuffle;
        ``buckets`` is their number (:meth:`buckets_for` the key if unset).
        """
        store = persist or self.persist_derived
        if (name, store) not in self._derived:
            df = build(self)
            if store:
                df = materialize(df, name, bucket_by=bucket_by, buckets=buckets or self.buckets_for(bucket_by))
            self._derived[name, store] = df
        return self._derived[name, store]
