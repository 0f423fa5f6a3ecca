"""Sources and sinks: schemas, loaders, the test-table adapter and materialization."""

from basketlens.sources.loaders import materialize, read_csv_tables, read_parquet_tables, row_counts
from basketlens.sources.tables import RetailTables

__all__ = ["RetailTables", "materialize", "read_csv_tables", "read_parquet_tables", "row_counts"]
