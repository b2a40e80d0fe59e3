"""Comparison casts applied at the very end of a registered query: integers
become BIGINT and decimals DOUBLE, after all arithmetic ran exactly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def finalize(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType) or isinstance(f.dataType, T.FloatType):
            c = c.cast("double")
        elif isinstance(f.dataType, _INTS):
            c = c.cast("bigint")
        cols.append(c.alias(f.name))
    return df.select(*cols)
