"""Registered forms of the load and write paths: each writes the stand-in tables under
a fresh folder of the session's checkpoint folder and returns what is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.operators.alerts import profit_alerts, variance_alerts
from tallyman.operators.validate import validate_payments
from tallyman.session import checkpoint_dir
from tallyman.sources import sinks, tables
from tallyman.sources.fixtures import FixtureTables
from tallyman.sources.schemas import MODEL_TABLES


def _root(t: FixtureTables, name: str) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/tallyman-{name}-{uuid.uuid4().hex[:12]}"


def load_tables(t: FixtureTables) -> DataFrame:
    """The model tables stored as production stores them, loaded with their declared
    types, and a checksum of every column."""
    root = _root(t, "tables")
    tables.store_tables({n: t[n] for n in MODEL_TABLES}, root)
    return tables.column_checks(tables.load_tables(t.spark, root), MODEL_TABLES)


def append_events(t: FixtureTables) -> DataFrame:
    """S3: validated payments appended in two batches, one of them twice; what the table
    and the quarantine hold afterwards."""
    root, quarantine = _root(t, "events"), _root(t, "quarantine")
    posted = validate_payments(t)
    early = F.col("payment_date") < F.lit("1996-01-01").cast("date")
    late = posted.where(~F.coalesce(early, F.lit(False)))
    sinks.append_events(posted.where(early), "payments", root, quarantine)
    for _ in range(2):  # a batch repeated replaces itself
        sinks.append_events(late, "payments", root, quarantine, batch_id=7)
    kept = tables.load_table(t.spark, root, "payments").drop("created_at").withColumn("reject_reason", F.lit(None).cast("string"))
    bad = t.spark.read.schema(posted.schema).parquet(f"{quarantine}/payments")
    return kept.unionByName(bad.select(*kept.columns))


def replace_alerts(t: FixtureTables) -> DataFrame:
    """The variance and loss checks of all days stored as one run, then those of the
    1997 days again as a second run without loss alerts; the alerts in force."""
    root = _root(t, "alerts")
    variance, losses = variance_alerts(t), profit_alerts(t)
    fresh = variance.unionByName(losses)
    days = t["daily_stock"].select(F.col("stock_date").alias("alert_date")).unionByName(losses.select("alert_date")).distinct()
    types = F.explode(F.array(F.lit("high_variance"), F.lit("negative_profit")))
    scope = days.withColumn("alert_type", types)
    sinks.write_alert_run(fresh, scope, root, "19980101-000000000001")
    year = F.year("alert_date") == 1997
    sinks.write_alert_run(variance.where(year), scope.where(year), root, "19980101-000000000002")
    return sinks.current_alerts(t.spark, root)
