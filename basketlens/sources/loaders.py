"""Readers for the source tables, row counts, and materialization of derived tables."""

from __future__ import annotations

import math
import uuid
from collections.abc import Sequence

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from basketlens.sources.schemas import MONEY, OPTIONAL_COLUMNS, TABLE_SCHEMAS


def schema_of(name: str, key_type: T.DataType | None = None) -> T.StructType:
    """A table's schema, with ``key_type`` for its id columns if given."""
    return T.StructType([T.StructField(f.name, key_type, f.nullable)
                         if key_type is not None and f.name.endswith("_id") else f
                         for f in TABLE_SCHEMAS[name].fields])


def _typed(df: DataFrame, name: str, key_type: T.DataType | None = None) -> DataFrame:
    """``df`` cast to the table's schema; a missing column raises, naming table and column."""
    schema = schema_of(name, key_type)
    missing = [f.name for f in schema.fields if f.name not in df.columns and f.name not in OPTIONAL_COLUMNS]
    if missing:
        raise ValueError(f"table {name} lacks {', '.join(missing)}; it has {', '.join(df.columns)}")
    return df.select([F.col(f.name).cast(f.dataType).alias(f.name)
                      for f in schema.fields if f.name in df.columns])


def as_money(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the money columns of table ``name`` as DECIMAL(18,2)."""
    return df.withColumns({f.name: F.col(f.name).cast(MONEY) for f in TABLE_SCHEMAS[name].fields
                           if f.dataType == MONEY and f.name in df.columns and df.schema[f.name].dataType != MONEY})


#: The column that holds a CSV line which did not fit its schema.
BAD_RECORD = "_bad_record"


def _csv(spark: SparkSession, path: str, schema: T.StructType, mode: str) -> DataFrame:
    reader = spark.read.schema(schema).option("header", True).option("mode", mode)
    if mode == "PERMISSIVE":
        reader = reader.option("columnNameOfCorruptRecord", BAD_RECORD)
    return reader.csv(path)


def _csv_path(directory: str, files: dict[str, str] | None, name: str) -> str:
    return f"{directory.rstrip('/')}/{(files or {}).get(name, f'{name}.csv')}"


def _dates_as_text(schema: T.StructType) -> T.StructType:
    """Dates are read as text and cast, so a time part ("2024-01-31 18:02:11") is dropped the
    same way DATEDIFF ignores it."""
    return T.StructType([T.StructField(f.name, T.StringType(), f.nullable) if isinstance(f.dataType, T.DateType) else f
                         for f in schema.fields])


def read_csv_tables(spark: SparkSession, directory: str,
                    files: dict[str, str] | None = None,
                    key_type: T.DataType | None = None) -> dict[str, DataFrame]:
    """Read the five CSV exports with a header row and a fixed schema.

    Keys are opaque: they are read as ``key_type`` (the schemas' BIGINT by default,
    ``StringType()`` for exports with other ids).

    ``files`` maps table name to file name; by default ``<table>.csv``.  Dates are
    parsed by the schema (``yyyy-MM-dd`` with an optional time part is accepted).  A line
    that does not fit stops the load; see :func:`read_csv_checked` for the other way.
    """
    out = {}
    for name in TABLE_SCHEMAS:
        schema = schema_of(name, key_type)
        raw = _csv(spark, _csv_path(directory, files, name), _dates_as_text(schema), "FAILFAST")
        out[name] = raw.select([F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    return out


def read_csv_checked(spark: SparkSession, directory: str, files: dict[str, str] | None = None,
                     key_type: T.DataType | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The five CSV exports without the lines that do not fit, and those lines:
    ``(tables, quarantine)``, the latter ``(table_name, record)``.

    A line is set aside when it has too few or too many fields, a value that its column's
    type can't hold, an impossible date, or no value in a column that must have one.
    Lines are judged whole, whichever columns a query reads.  Both results are lazy and
    split the lines between them: none is in both, none is lost.
    """
    good, bad = {}, []
    for name in TABLE_SCHEMAS:
        schema = schema_of(name, key_type)
        # read as text: the reader converts, and so checks, only the columns that a query reads
        text = T.StructType([*[T.StructField(f.name, T.StringType(), True) for f in schema.fields],
                             T.StructField(BAD_RECORD, T.StringType(), True)])
        raw = _csv(spark, _csv_path(directory, files, name), text, "PERMISSIVE")
        wrong = F.col(BAD_RECORD).isNotNull()            # too few or too many fields
        for f in schema.fields:
            wrong = wrong | (F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull())
            if not f.nullable:
                wrong = wrong | F.col(f.name).isNull()
        good[name] = raw.where(~wrong).select([F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields])
        line = F.coalesce(F.col(BAD_RECORD), F.to_csv(F.struct(*[f.name for f in schema.fields])))
        bad.append(raw.where(wrong).select(F.lit(name).alias("table_name"), line.alias("record")))
    return good, reduce(DataFrame.unionByName, bad)


def read_catalog_tables(spark: SparkSession, database: str | None = None,
                        names: dict[str, str] | None = None,
                        key_type: T.DataType | None = None) -> dict[str, DataFrame]:
    """Read the five tables by name from the session catalog (Hive metastore, Unity,
    Glue... whatever the cluster is configured with), cast to the fixed schema."""
    names = names or {name: name for name in TABLE_SCHEMAS}
    out = {}
    for name in TABLE_SCHEMAS:
        ident = f"{database}.{names[name]}" if database else names[name]
        out[name] = _typed(spark.table(ident), name, key_type)
    return out


def read_parquet_tables(spark: SparkSession, directory: str,
                        key_type: T.DataType | None = None) -> dict[str, DataFrame]:
    """Read the five tables stored as Parquet (``<dir>/<table>.parquet``)."""
    out = {}
    for name in TABLE_SCHEMAS:
        out[name] = _typed(spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet"), name, key_type)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """One row per table: ``(table_name, n_rows)``.

    Each count is a partial/final aggregate; the union of one-row results is tiny.
    """
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows"))
               .select(F.lit(name).alias("table_name"), "n_rows")
             for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def shared_dir(spark: SparkSession) -> str:
    """The cluster-shared folder for materialized tables.

    Taken from ``spark.checkpoint.dir`` (or the context's checkpoint dir).  On a
    cluster it is never chosen here: a session without one is a configuration
    error.  Only a ``local[...]`` session (one machine: tests, local runs) gets a
    scratch folder when the setting is missing.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    try:                                   # classic sessions; Spark Connect has no SparkContext
        sc = spark.sparkContext
    except Exception:                      # noqa: BLE001
        sc = None
    root = sc.getCheckpointDir() if sc is not None else None
    if not root:
        if sc is None or not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is not set; materialize() needs a shared folder")
        from basketlens.session import ensure_checkpoint_dir
        root = ensure_checkpoint_dir(spark)
    return root.rstrip("/")


#: One tag for all tables this process writes, so that a run removes its own only.
RUN = uuid.uuid4().hex[:12]


def materialize(df: DataFrame, name: str, *, path: str | None = None,
                bucket_by: Sequence[str] = (), buckets: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back.

    This is the ``DROP TABLE; CREATE TABLE AS`` of the analysis: it cuts the lineage
    (a lost executor re-reads files instead of recomputing the joins) and lets later
    queries reuse the result.  Each call writes a fresh directory in the run's folder,
    so concurrent or repeated runs never overwrite each other's input;
    :func:`drop_materialized_tables` removes them.

    With ``bucket_by`` the table is bucketed (hash-partitioned into ``buckets`` files
    per key range, default ``spark.sql.shuffle.partitions``) and registered as an
    external table over that folder: two tables bucketed the same way on a join key
    are joined without shuffling either side.
    """
    spark = df.sparkSession
    tag = uuid.uuid4().hex[:12]
    target = path or f"{run_dir(spark)}/{name}-{tag}"
    if not bucket_by:
        df.write.mode("overwrite").parquet(target)
        return spark.read.schema(df.schema).parquet(target)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"basketlens_{RUN}_{name}_{tag}"
    # one shuffle on the bucket key first: each task then writes exactly one bucket
    # file, instead of every task writing a file for every bucket
    (df.repartition(n, *bucket_by)
     .write.mode("overwrite").format("parquet").option("path", target)
     .bucketBy(n, *bucket_by).sortBy(*bucket_by).saveAsTable(table))
    return spark.table(table)


#: Bytes of a bucket: wanted at scale, and least while there are more cores than buckets.
BUCKET_BYTES, LEAST_BUCKET_BYTES = 128 << 20, 1 << 20
#: Files whose sizes are asked one by one; of more, their folders'.
FILES_ASKED = 1000


def measured_bytes(df: DataFrame) -> int | None:
    """Bytes of the files that ``df`` reads; None if it reads none (or they can't be found).

    Folders with other files too count whole where there are more than ``FILES_ASKED`` files."""
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return None
    many = len(files) > FILES_ASKED
    total, conf = 0, spark._jsc.hadoopConfiguration()
    for name in {f.rsplit("/", 1)[0] for f in files} if many else set(files):
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(conf)
        total += fs.getContentSummary(path).getLength() if many else fs.getFileStatus(path).getLen()
    return total


def bucket_count(n_bytes: int | None, cores: int, default: int) -> int:
    """Buckets for so many bytes: ``BUCKET_BYTES`` each; small data are spread over the cores
    as long as buckets have ``LEAST_BUCKET_BYTES``.  A power of two, so that counts divide
    each other; ``default`` if the size is not known."""
    if n_bytes is None:
        return default
    wanted = max(n_bytes / BUCKET_BYTES, min(cores, n_bytes / LEAST_BUCKET_BYTES), 1)
    return 1 << math.ceil(math.log2(wanted))


def with_position(df: DataFrame, name: str = "position") -> DataFrame:
    """``df``, which ends in ``orderBy``, with each row's place in that order, from 1.

    A sorted frame's partitions follow each other, so a row's place is the size of the
    partitions before its own and its place inside.  Rows are written once in between: their
    order is settled by the time the sizes are counted.  The sizes, one row for each
    partition, are the only thing that meets in one task.
    """
    row = "_row_id"
    kept = materialize(df.withColumn(row, F.monotonically_increasing_id()), "ordered")
    part, inside = F.shiftright(F.col(row), 33), F.col(row).bitwiseAND(F.lit((1 << 33) - 1))
    sizes = kept.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_part")) - F.col("_size")
    starts = sizes.select(F.col("_part"), before.alias("_before"))
    return kept.join(F.broadcast(starts), part == F.col("_part")) \
        .select((F.col("_before") + inside + 1).cast("bigint").alias(name), *df.columns)


def run_dir(spark: SparkSession) -> str:
    """This run's own folder in the shared folder."""
    return f"{shared_dir(spark)}/basketlens/{RUN}"


def drop_materialized_tables(spark: SparkSession, database: str | None = None) -> list[str]:
    """Remove what this run materialized: its catalog entries and its folder.

    Tables and files of other runs stay.  Returns the dropped names.
    """
    dropped = []
    for tbl in spark.catalog.listTables(database):
        if tbl.name.startswith(f"basketlens_{RUN}_") and not tbl.isTemporary:
            ident = f"{database}.{tbl.name}" if database else tbl.name
            spark.sql(f"DROP TABLE IF EXISTS {ident}")
            dropped.append(tbl.name)
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_dir(spark))
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return dropped
