"""Output typing for results handed to other tools.

Library operators keep the natural types (DECIMAL money, DATE dates).  Exported
results use types every consumer reads the same way: DECIMAL -> DOUBLE (after
exact aggregation and rounding), DATE -> ISO string, INT -> BIGINT.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def portable(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, T.StringType) and f.dataType != T.StringType():
            c = F.collate(c, "UTF8_BINARY")          # a collation is a rule of the analysis, not of its results
        cols.append(c.alias(f.name))
    return df.select(*cols)
