"""Streaming jobs run once (``availableNow``) over the stored stand-in
tables, returning what their sink holds as a DataFrame, so that each can be
compared with the oracle of its batch twin (ST1 = C5, ST2 = T5, ST3 = V1,
ST4 = R2x). Each call runs the stream with a fresh checkpoint and output
folder under the session's checkpoint folder; all files available are read,
``FILES_A_BATCH`` to a micro-batch.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.session import checkpoint_dir
from tallyman.sources.fixtures import FixtureTables
from tallyman.sources.sinks import current_alerts
from tallyman.sources.tables import store_tables
from tallyman.streaming import jobs
from tallyman.streaming.stateful import BALANCES, LEDGER


#: Bound of a registered run's micro-batches, so state carries over several of them where
#: a table has more files. Crossings and the stock ledger depend on arrival order, which
#: files don't have: they are fed their events in ``PHASES`` parts by time of arrival.
FILES_A_BATCH, PHASES = 2, 3


def _run_dir(t: FixtureTables, name: str) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/tallyman-streams/{name}-{uuid.uuid4().hex[:12]}"


def _finish(q) -> None:
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def _fed_in_order(t: FixtureTables, d: str, tables: list[str], start, again: bool = False) -> None:
    """Run a stream over the tables' rows in parts by time of arrival, each appended to
    ``d/in`` before the stream goes on; ``again``: each part is delivered twice, the second
    time together with the next part."""
    first = t[tables[0]]
    cuts = first.agg(F.percentile_approx(F.unix_micros(F.col("created_at").cast("timestamp")), [i / PHASES for i in range(1, PHASES)])).first()[0]
    at = lambda: F.unix_micros(F.col("created_at").cast("timestamp"))
    for phase in range(PHASES + again):
        for part in (phase, phase - 1) if again else (phase,):
            if not 0 <= part < PHASES:
                continue
            low, high = (cuts[part - 1] if part else None), (cuts[part] if part < PHASES - 1 else None)
            for name in tables:
                rows = t[name] if low is None else t[name].where(at() > low)
                (rows if high is None else rows.where(at() <= high)).write.mode("append").parquet(f"{d}/in/{name}")
        _finish(start())


def stream_credit_alerts(t: FixtureTables) -> DataFrame:
    """ST1: limit-crossing alerts from the sales and payment streams, over several micro-batches."""
    d = _run_dir(t, "credit")
    _fed_in_order(t, d, ["sales", "payments"], lambda: jobs.start_credit_alerts(
        t.spark, f"{d}/in/sales", f"{d}/in/payments", t["customers"], f"{d}/out", checkpoint=f"{d}/ck"))
    return t.spark.read.parquet(f"{d}/out/alerts").drop("stream", "batch")


def stream_redelivered_alerts(t: FixtureTables) -> DataFrame:
    """ST1 where every event is delivered twice: the alerts are those of each event once."""
    d = _run_dir(t, "redelivered")
    _fed_in_order(t, d, ["sales", "payments"], lambda: jobs.start_credit_alerts(
        t.spark, f"{d}/in/sales", f"{d}/in/payments", t["customers"], f"{d}/out", checkpoint=f"{d}/ck", redelivered="30 days"), again=True)
    return t.spark.read.parquet(f"{d}/out/alerts").drop("stream", "batch")


def stream_stock_ledger(t: FixtureTables) -> DataFrame:
    """ST2: the stock ledger kept as a keyed table from transfer and count streams, over
    several micro-batches."""
    d = _run_dir(t, "stock")
    _fed_in_order(t, d, ["branch_transfers", "closing_counts"], lambda: jobs.start_stock_ledger(
        t.spark, f"{d}/in/branch_transfers", f"{d}/in/closing_counts", t["breakdown_records"], f"{d}/out", checkpoint=f"{d}/ck"))
    return jobs.latest_state(t.spark, f"{d}/out", LEDGER, ["branch_id", "product_id"], f"{d}/ck")


def stream_validated_ingest(t: FixtureTables) -> DataFrame:
    """ST3: raw sales validated as a stream into accepted and quarantined rows."""
    d = _run_dir(t, "ingest")
    dims = {k: t[k] for k in ("branches", "products", "customers")}
    _finish(jobs.start_validated_ingest(t.spark, t.path("raw_sales"), dims, f"{d}/db", f"{d}/quarantine",
                                        checkpoint=f"{d}/ck", max_files=FILES_A_BATCH))
    ok = t.spark.read.parquet(f"{d}/db/sales").drop("ingest_batch", "business_month").withColumn(
        "reject_reason", F.lit(None).cast("string"))
    bad = t.spark.read.parquet(f"{d}/quarantine/sales").drop("ingest_batch")
    return ok.unionByName(bad)


def stream_branch_totals(t: FixtureTables) -> DataFrame:
    """ST4: running revenue, discount and expenses per branch-day."""
    d = _run_dir(t, "totals")
    _finish(jobs.start_branch_totals(t.spark, t.path("sales"), t.path("expenses"), t["products"],
                                     f"{d}/out", checkpoint=f"{d}/ck", max_files=FILES_A_BATCH))
    return jobs.branch_totals(t.spark, f"{d}/out", f"{d}/ck")


def stream_credit_balances(t: FixtureTables) -> DataFrame:
    """ST1: the balance of every customer with activity, kept over the micro-batches."""
    d = _run_dir(t, "balances")
    _finish(jobs.start_credit_balances(t.spark, t.path("sales"), t.path("payments"), f"{d}/out", checkpoint=f"{d}/ck",
                                       max_files=FILES_A_BATCH))
    kept = jobs.latest_state(t.spark, f"{d}/out", BALANCES, ["customer_id"], f"{d}/ck")
    return kept.select("customer_id", (F.col("cents") / 100).cast("decimal(28,2)").alias("balance_owed"))


def stream_alert_regeneration(t: FixtureTables) -> DataFrame:
    """ST5: expenses arrive as a stream; each micro-batch regenerates the alerts of the
    days it touched, over the stored tables; the alerts in force."""
    d = _run_dir(t, "alerts")
    store_tables({n: t[n] for n in ("branches", "products", "sales", "expenses", "daily_stock")}, f"{d}/db")
    _finish(jobs.start_alert_regeneration(t.spark, t.path("expenses"), "expense_date", f"{d}/db", f"{d}/alerts", t["expenses"].schema,
                                          checkpoint=f"{d}/ck", max_files=FILES_A_BATCH))
    return current_alerts(t.spark, f"{d}/alerts").drop("customer_id")
