"""Typed load of stored model tables.

A stored table is a parquet directory ``{root}/{name}`` (fact tables
partitioned by their business date). Reading with the declared schema
skips inference and lets Spark prune partitions and push filters down.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.sources.schemas import SCHEMAS

# Business date of each fact table; it is stored partitioned by this date's month (daily
# directories would hold tiny files for all but the largest days).
PARTITION_DATE = {
    "sales": "sale_date", "payments": "payment_date", "expenses": "expense_date",
    "carcass_purchases": "purchase_date", "branch_transfers": "transfer_date", "daily_stock": "stock_date",
    "closing_counts": "stock_date", "notifications": "alert_date",
}


def partitioned_writer(df: DataFrame, partition_cols: list[str]):
    """A writer partitioned by ``partition_cols`` whose rows are first
    rebalanced on those columns (the REBALANCE hint): AQE clusters each
    partition value into as few files as its size needs, coalescing small
    values together and splitting a hot value (today's date in a stream)
    over several tasks by the advisory partition size."""
    return df.hint("rebalance", *partition_cols).write.partitionBy(*partition_cols)


MONTH = "business_month"


def month_of(date):
    return F.date_format(date, "yyyy-MM")


def fact_writer(df: DataFrame, table: str):
    return partitioned_writer(df.withColumn(MONTH, month_of(F.col(PARTITION_DATE[table]))), [MONTH])


#: Every write of a fact table goes to its own ``ingest_batch=…`` directory, so that a
#: retried batch replaces what it wrote; the base table is the batch "initial".
BATCH = "ingest_batch"


def batch_path(root: str, table: str, batch: str) -> str:
    return f"{root.rstrip('/')}/{table}/{BATCH}={batch}"


def load_table(spark: SparkSession, root: str, name: str, months: DataFrame | None = None) -> DataFrame:
    """The table in its declared columns; batch and month directories don't show.
    ``months`` (one column, ``business_month``) keeps only these months' directories."""
    df = spark.read.schema(SCHEMAS[name]).parquet(f"{root.rstrip('/')}/{name}")
    if months is not None and name in PARTITION_DATE:
        df = df.join(months, MONTH, "left_semi")
    return df.select(*[f.name for f in SCHEMAS[name].fields])


def load_tables(spark: SparkSession, root: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """``{name: DataFrame}`` for the model tables stored under ``root``."""
    return {n: load_table(spark, root, n) for n in (names or SCHEMAS)}


def store_tables(tables: Mapping[str, DataFrame], root: str, mode: str = "overwrite") -> None:
    """Write model tables under ``root`` in their declared column order,
    facts partitioned by business month (as the batch "initial")."""
    for name, df in tables.items():
        if name not in SCHEMAS:
            continue
        cols = [f.name for f in SCHEMAS[name].fields]
        typed = df.select(*[F.col(c).cast(SCHEMAS[name][c].dataType) for c in cols])
        if name in PARTITION_DATE:
            fact_writer(typed, name).mode(mode).parquet(batch_path(root, name, "initial"))
        else:
            typed.write.mode(mode).parquet(f"{root.rstrip('/')}/{name}")


def column_checks(tables: Mapping[str, DataFrame], names: Iterable[str]) -> DataFrame:
    """S1's load check: for each column of each table, its rows, its values and a sum that
    every value enters (numbers themselves, text lengths, days and seconds), so a column
    that was read wrongly shows. One pass over each table."""

    def number(df: DataFrame, name: str):
        kind, c = df.schema[name].dataType.simpleString(), F.col(name)
        if kind == "bigint":
            return c.cast("decimal(38,0)")
        if kind == "boolean":
            return c.cast("int").cast("decimal(38,0)")
        if kind == "string":
            return F.length(c).cast("decimal(38,0)")
        if kind == "date":
            return F.datediff(c, F.lit("1970-01-01").cast("date")).cast("decimal(38,0)")
        if kind == "timestamp_ntz":
            return F.unix_seconds(c.cast("timestamp")).cast("decimal(38,0)")
        return c.cast("decimal(38,2)")

    out = None
    for table in names:
        df = tables[table]
        sums = df.agg(F.count(F.lit(1)).alias("n"), *[F.count(c).alias(f"n_{c}") for c in df.columns], *[F.sum(number(df, c)).alias(f"s_{c}") for c in df.columns])
        rows = [F.struct(F.lit(table).alias("table_name"), F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"n_{c}").alias("n_values"),
                         F.coalesce(F.col(f"s_{c}").cast("double"), F.lit(0.0)).alias("checksum")) for c in df.columns]
        part = sums.select(F.explode(F.array(*rows)).alias("r")).select("r.*")
        out = part if out is None else out.unionByName(part)
    return out
