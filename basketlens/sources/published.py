"""Tables published by name, with versions: readers in any session, replaced while they read.

A published name is a view in the catalog over the newest version's table.  A new version
is written whole under a name of its own; only then is the view switched, in one catalog
change, so a reader finds the old version or the new one and never a half.  Whoever has
begun to read the old version goes on with its files, which stay until :func:`retire`.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from basketlens.sources.loaders import shared_dir


def _version_prefix(name: str) -> str:
    return f"{name}__v"


def _ident(name: str, database: str | None) -> str:
    return f"`{database}`.`{name}`" if database else f"`{name}`"


def publish(df: DataFrame, name: str, *, database: str | None = None, bucket_by: Sequence[str] = (),
            buckets: int | None = None) -> str:
    """Write ``df`` as the newest version of ``name`` and switch the name to it.

    Returns the version's table name.  ``bucket_by`` and ``buckets`` are kept by the
    version's table, so joins between published tables that are bucketed alike need no
    shuffle.  Versions sort by the time of publication.
    """
    spark = df.sparkSession
    # nanoseconds in 20 digits: names sort in order of time
    version = f"{_version_prefix(name)}{time.time_ns():020d}_{uuid.uuid4().hex[:6]}"
    target = f"{shared_dir(spark)}/basketlens-published/{name}/{version}"
    writer = df.write.format("parquet").option("path", target)
    if bucket_by:
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        writer = df.repartition(n, *bucket_by).write.format("parquet").option("path", target) \
            .bucketBy(n, *bucket_by).sortBy(*bucket_by)
    writer.saveAsTable(f"{database}.{version}" if database else version)
    spark.sql(f"CREATE OR REPLACE VIEW {_ident(name, database)} AS SELECT * FROM {_ident(version, database)}")
    return version


def versions(spark: SparkSession, name: str, database: str | None = None) -> list[str]:
    """The version tables of a published name, oldest first."""
    found = [t.name for t in spark.catalog.listTables(database) if t.name.startswith(_version_prefix(name))]
    return sorted(found)


def read(spark: SparkSession, name: str, database: str | None = None) -> DataFrame:
    """The newest version of a published table; a frame keeps the version it began with."""
    return spark.table(f"{database}.{name}" if database else name)


def roll_back(spark: SparkSession, name: str, version: str, database: str | None = None) -> None:
    """Switch the name to an earlier version that is still there."""
    if version not in versions(spark, name, database):
        raise ValueError(f"{name} has no version {version}")
    spark.sql(f"CREATE OR REPLACE VIEW {_ident(name, database)} AS SELECT * FROM {_ident(version, database)}")


def retire(spark: SparkSession, name: str, *, keep: int = 2, database: str | None = None) -> list[str]:
    """Drop all versions but the newest ``keep`` with their files; returns their names.

    ``keep`` is at least 1.  Call it when no reader can still hold an older version.
    """
    gone = versions(spark, name, database)[:-max(1, keep)]
    for version in gone:
        spark.sql(f"DROP TABLE IF EXISTS {_ident(version, database)}")
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/basketlens-published/{name}/{version}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return gone


def unpublish(spark: SparkSession, name: str, database: str | None = None) -> None:
    """Remove a published name, its versions and their files."""
    spark.sql(f"DROP VIEW IF EXISTS {_ident(name, database)}")
    for version in versions(spark, name, database):
        spark.sql(f"DROP TABLE IF EXISTS {_ident(version, database)}")
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/basketlens-published/{name}")
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
