"""Row validation as column expressions: the first failing rule's name.

JavaScript truthiness decides the API's "required" checks: ``!x`` rejects
NULL, 0 and '' alike, while ``x === undefined`` lets 0 through. A NULL in a
raw table stands for an absent field.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def falsy(c: Column) -> Column:
    """``!x`` for a number."""
    return c.isNull() | (c == 0)


def falsy_text(c: Column) -> Column:
    """``!x`` for a string."""
    return c.isNull() | (c == "")


def first_failure(rules: Sequence[tuple[str, Column]]) -> Column:
    """Name of the first rule whose condition is true (NULL counts as not
    failing), or NULL when every rule passes."""
    out = F.lit(None).cast("string")
    for reason, bad in reversed(rules):
        out = F.when(F.coalesce(bad, F.lit(False)), F.lit(reason)).otherwise(out)
    return out


#: Tasks that rows without a key are spread over in a key check.
NULL_KEY_SLICES = 64


def with_key_check(df: DataFrame, dim: DataFrame, col: str, flag: str) -> DataFrame:
    """Add boolean ``flag``: the non-NULL ``col`` has no row in ``dim`` (a
    foreign-key violation). ``dim``'s ids are unique, so a plain left join keeps the
    rows: a large dimension shuffles (and Spark may split a hot key), a small one is
    broadcast by Spark's size check. Rows without a key, such as all anonymous sales,
    match nothing; a second key, from a row's first two columns, spreads them."""
    keys = dim.select(F.col("id").alias("_key"), F.lit(0).alias("_key_slice"), F.lit(True).alias("_found"))
    spread = F.when(F.col(col).isNull(), 1 + F.pmod(F.xxhash64(*[F.col(c) for c in df.columns[:2]]), F.lit(NULL_KEY_SLICES))).otherwise(0)
    return (df.withColumn("_slice", spread.cast("int")).join(keys, (F.col(col) == F.col("_key")) & (F.col("_slice") == F.col("_key_slice")), "left")
            .withColumn(flag, F.col(col).isNotNull() & F.col("_found").isNull()).drop("_key", "_key_slice", "_found", "_slice"))


def accepted(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNull()).drop("reject_reason")


def rejected(df: DataFrame) -> DataFrame:
    return df.where(F.col("reject_reason").isNotNull())
