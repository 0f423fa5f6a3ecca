"""basketlens: retail value analytics as Spark DataFrame operators.

Every operator takes and returns ``pyspark.sql.DataFrame`` objects, takes
column names as arguments and never collects data to the driver.  The
named queries live in :mod:`basketlens.plans.catalog`; the DuckDB SQL used
as a differential oracle lives in :mod:`basketlens.plans.oracle`.
"""

from basketlens.config import Labels, Thresholds
from basketlens.sources.tables import RetailTables

__all__ = ["Labels", "Thresholds", "RetailTables"]
