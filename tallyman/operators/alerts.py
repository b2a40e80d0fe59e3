"""Alerts: variance, loss, target and credit alerts in the notifications
shape, their idempotent regeneration and read flags.

The reference's check functions loop over view rows for one date; here
each check is one filter + projection over all dates at once (or one date
when ``on`` is given).
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyman.functions.money import text
from tallyman.operators.credit import credit_limit_crossings
from tallyman.operators.profit import branch_target_progress, daily_branch_profit
from tallyman.operators.stock import daily_stock_variance

Tables = Mapping[str, DataFrame]
NOTIFICATION_COLS = ["branch_id", "customer_id", "alert_type", "message", "severity", "is_read", "alert_date"]
# Fixed thresholds of the reference's alert functions.
VARIANCE_PCT = 5
VARIANCE_CRITICAL_PCT = 15
TARGET_PCT = 80


def _shape(df: DataFrame, alert_type: str, message: Column, severity: Column, alert_date: Column) -> DataFrame:
    return df.select(
        F.col("branch_id").cast("bigint").alias("branch_id"), F.lit(None).cast("bigint").alias("customer_id"),
        F.lit(alert_type).alias("alert_type"), message.alias("message"), severity.alias("severity"),
        F.lit(False).alias("is_read"), alert_date.alias("alert_date"))


def variance_alerts(t: Tables, on: dt.date | None = None) -> DataFrame:
    """A1: loss-side variance above 5 % (NULL excluded); critical above 15 %.
    ``"{branch}: {product} variance is {kg}kg ({pct}%), above normal"``."""
    v = daily_stock_variance(t)
    if on is not None:
        v = v.where(F.col("stock_date") == F.lit(on))
    v = v.where(F.col("variance_pct") > VARIANCE_PCT)
    msg = F.concat(F.col("branch_name"), F.lit(": "), F.col("product_name"), F.lit(" variance is "),
                   text("variance_kg"), F.lit("kg ("), text("variance_pct"), F.lit("%), above normal"))
    sev = F.when(F.col("variance_pct") > VARIANCE_CRITICAL_PCT, "critical").otherwise("warning")
    return _shape(v, "high_variance", msg, sev, F.col("stock_date"))


def profit_alerts(t: Tables, on: dt.date | None = None, profit: DataFrame | None = None) -> DataFrame:
    """A2: a branch-day with negative gross profit (as the profit view
    reports it); critical. ``"{branch} made a loss of {abs} today"``."""
    p = daily_branch_profit(t) if profit is None else profit
    if on is not None:
        p = p.where(F.col("report_date") == F.lit(on))
    p = p.where(F.col("gross_profit") < 0)
    msg = F.concat(F.col("branch_name"), F.lit(" made a loss of "), text(F.abs("gross_profit")), F.lit(" today"))
    return _shape(p, "negative_profit", msg, F.lit("critical"), F.col("report_date"))


def target_alerts(t: Tables, run_date: dt.date, profit: DataFrame | None = None) -> DataFrame:
    """A3: every target (finished, running or future) below 80 % (NULL
    excluded), dated on the run date. ``"{branch} is at {pct}% of its
    {period} target"``."""
    p = branch_target_progress(t, profit).where(F.col("pct_of_target") < TARGET_PCT)
    msg = F.concat(F.col("branch_name"), F.lit(" is at "), text("pct_of_target"), F.lit("% of its "),
                   F.col("period_type"), F.lit(" target"))
    return _shape(p, "target_performance", msg, F.lit("warning"), F.lit(run_date))


def alert_feed(t: Tables, run_date: dt.date) -> DataFrame:
    """A4: variance, loss, target and credit-crossing alerts as one
    notifications-shaped DataFrame (unread)."""
    credit = credit_limit_crossings(t).select(*NOTIFICATION_COLS)
    profit = daily_branch_profit(t)
    return (variance_alerts(t).unionByName(profit_alerts(t, profit=profit))
            .unionByName(target_alerts(t, run_date, profit=profit)).unionByName(credit))


def regenerated_scope(t: Tables, run_date: dt.date, profit: DataFrame | None = None) -> DataFrame:
    """The (alert_type, alert_date) pairs one regeneration run replaces: the
    variance check for every stock day, the loss check for every report
    day, the target check for the run date."""
    v = t["daily_stock"].select(F.lit("high_variance").alias("alert_type"),
                                F.col("stock_date").alias("alert_date")).distinct()
    p = (daily_branch_profit(t) if profit is None else profit).select(
        F.lit("negative_profit").alias("alert_type"), F.col("report_date").alias("alert_date")).distinct()
    tg = t["branches"].select(F.lit("target_performance").alias("alert_type"),
                              F.lit(run_date).alias("alert_date")).distinct()
    return v.unionByName(p).unionByName(tg)


def replace_alert_partitions(existing: DataFrame, fresh: DataFrame, scope: DataFrame) -> DataFrame:
    """Delete every existing alert whose (alert_type, alert_date) is in scope,
    then add the fresh ones: running it twice gives the same rows, read flags
    of replaced alerts reset, and a pair where nothing fires ends up empty."""
    kept = existing.join(scope, ["alert_type", "alert_date"], "left_anti")
    return kept.select(*NOTIFICATION_COLS).unionByName(fresh.select(*NOTIFICATION_COLS))


def regenerate_alerts(t: Tables, run_date: dt.date) -> DataFrame:
    """A5: the notifications table after one run of the three checks."""
    profit = daily_branch_profit(t)
    fresh = (variance_alerts(t).unionByName(profit_alerts(t, profit=profit))
             .unionByName(target_alerts(t, run_date, profit=profit)))
    return replace_alert_partitions(t["notifications"], fresh, regenerated_scope(t, run_date, profit=profit))


def mark_read(t: Tables) -> DataFrame:
    """Notifications with ``is_read`` set for every acknowledged id."""
    acks = t["read_acks"].select("id").distinct().withColumn("_ack", F.lit(True))
    n = t["notifications"]
    return (n.join(acks, "id", "left")
            .select("id", *[c for c in NOTIFICATION_COLS if c != "is_read"],
                    (F.col("is_read") | F.coalesce(F.col("_ack"), F.lit(False))).alias("is_read")))


def mark_read_not_found(t: Tables) -> DataFrame:
    """Acknowledged ids that match no notification (the 'not found' reply)."""
    return t["read_acks"].select("id").distinct().join(t["notifications"].select("id"), "id", "left_anti")
