"""Skew-safe running sums, last values and positions.

A running total per key is usually ``sum() over (partition by key order by …)``,
which puts every row of a key into one task: a customer holding a third of all rows
would run on one core. Here the rows are range-partitioned once by (key, order), so
a large key, even one large day of a key, is cut into several slices, and the total
is computed in three steps:

1. the sliced rows are written (the slice number is then a fact, not a function of
   a partitioning that a re-run could draw differently);
2. one aggregate row per (key, slice) gives each slice its offset, the sum of the
   key's earlier slices, by a window over those few rows;
3. a window inside each (key, slice) gives the local total; offset + local is it.

No task holds more than one slice, which is as large as a shuffle partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyman.session import written


def _sliced(df: DataFrame, keys: Sequence[Column]) -> DataFrame:
    """``df`` with ``_slice``: the number of its range of ``keys``, in their order."""
    return written(df.repartitionByRange(*keys).withColumn("_slice", F.spark_partition_id()), "slices")


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Add column ``out`` = Σ ``value`` over all rows of the same ``by`` key up to and
    including this one. ``order`` must make the order total within a key."""
    by = list(by)
    d = _sliced(df, [*[F.col(c) for c in by], *order])
    totals = d.groupBy(*by, "_slice").agg(F.sum(value).alias("_total"))
    # without a key the window holds one row for each slice
    earlier = (Window.partitionBy(*by) if by else Window).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*by, "_slice", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_local", F.sum(value).over(local))
    joined = d.join(offsets.select(*[F.col(c).alias(f"_key_{c}") for c in by], F.col("_slice").alias("_key__slice"), "_offset"),
                    [F.col(c).eqNullSafe(F.col(f"_key_{c}")) for c in [*by, "_slice"]])
    return joined.select(*df.columns, (F.col("_offset") + F.col("_local")).alias(out))


def running_last(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: str, out: str) -> DataFrame:
    """Add column ``out``: the last ``value`` that isn't null among all rows of the same ``by``
    key up to and including this one, sliced like ``running_total``. ``order`` must make
    the order total within a key."""
    by = list(by)
    d = _sliced(df, [*[F.col(c) for c in by], *order])
    has = F.col(value).isNotNull()
    lasts = d.where(has).groupBy(*by, "_slice").agg(F.max_by(F.col(value), F.struct(*order)).alias("_last"))
    slices = d.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_rows")).join(lasts, [*by, "_slice"], "left")
    earlier = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = slices.select(*by, "_slice", F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    local = Window.partitionBy(*by, "_slice").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = d.withColumn("_local", F.last(value, ignorenulls=True).over(local))
    return d.join(offsets, [*by, "_slice"]).select(*df.columns, F.coalesce("_local", "_before").alias(out))


def with_position(df: DataFrame, order: Sequence[Column], out: str = "position") -> DataFrame:
    """Add ``out`` = 1-based position in ``order``, which must be total, without a
    window over the whole table."""
    numbered = running_total(df.withColumn("_one", F.lit(1).cast("bigint")), [], order, "_one", out)
    return numbered.drop("_one").withColumn(out, F.col(out).cast("bigint"))
