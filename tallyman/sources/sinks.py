"""Write paths.

S3 ``append_events``: validated rows are appended to a fact table
partitioned by business month; rejected rows go to a quarantine table with
their reason. Returns the accepted rows (the reference's ``RETURNING *``).

S4 ``write_alert_run`` / ``current_alerts``: idempotent alert regeneration. Each run
is one directory with the fresh alerts and, for every (type, date) pair it checked, a
marker row; the alerts of a pair are those of the latest run that checked it (runs are
named by time, see ``streaming/snapshots.stream_id``, so a new stream never repeats an old name). So a run
replaces its pairs, also those where nothing fires any more, by a single write that
becomes visible as a whole; nothing is deleted and nothing collected.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.functions.rules import accepted, rejected
from tallyman.sources.tables import batch_path, fact_writer


def append_events(validated: DataFrame, table: str, root: str, quarantine_root: str | None = None,
                  batch_id: int | str | None = None) -> DataFrame:
    """Append the accepted rows of a validated DataFrame to ``root/table``
    (partitioned by business month), the rejected ones to
    ``quarantine_root/table``; return the accepted rows.

    Every append is a batch with an id and a directory of its own, written with
    overwrite: repeating a batch (a retried micro-batch) replaces exactly what it
    wrote before. Without an id the append gets a new one."""
    batch = f"append-{uuid.uuid4().hex}" if batch_id is None else str(batch_id)
    ok, bad = accepted(validated), rejected(validated)
    fact_writer(ok, table).mode("overwrite").parquet(batch_path(root, table, batch))
    if quarantine_root is not None:
        bad.write.mode("overwrite").parquet(batch_path(quarantine_root, table, batch))
    return ok


ALERT_COLS = ["branch_id", "customer_id", "alert_type", "message", "severity", "is_read", "alert_date"]


def write_alert_run(fresh: DataFrame, scope: DataFrame, root: str, run: str) -> None:
    """Store one regeneration: ``fresh`` alerts, replacing all alerts of the (alert_type,
    alert_date) pairs of ``scope``. Repeating a run replaces it; runs whose name sorts
    higher win, so names begin with the time their stream or job began."""
    alerts = fresh.select(*ALERT_COLS, F.lit(False).alias("is_marker"))
    marks = scope.select("alert_type", "alert_date").distinct()
    marks = marks.select(*[F.col(c) if c in ("alert_type", "alert_date") else F.lit(None).cast(fresh.schema[c].dataType).alias(c) for c in ALERT_COLS],
                         F.lit(True).alias("is_marker"))
    alerts.unionByName(marks).write.mode("overwrite").parquet(f"{root.rstrip('/')}/run={run}")


def current_alerts(spark: SparkSession, root: str) -> DataFrame:
    """The alerts in force: of each pair, the rows of the latest run that checked it."""
    rows = spark.read.parquet(root).withColumn("run", F.col("run").cast("string"))
    pair = ["alert_type", "alert_date"]
    latest = rows.where("is_marker").groupBy(*pair).agg(F.max("run").alias("run"))
    return rows.where("not is_marker").join(latest, [*pair, "run"], "left_semi").select(*ALERT_COLS)
