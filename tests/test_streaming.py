"""Stream results equal their batch twins (SURVEY §5 (3))."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from paths import SF001
from tallyman.operators import alerts, credit, profit, stock, validate
from tallyman.sources.fixtures import fixture_tables
from tallyman.sources.sinks import current_alerts
from tallyman.sources.tables import load_tables, store_tables
from tallyman.streaming import jobs
from tallyman.streaming.snapshots import KeyedSnapshot, stream_id
from tallyman.streaming.stateful import LEDGER

CUT = dt.datetime(1997, 1, 1)


@pytest.fixture(scope="module")
def t(spark):
    return fixture_tables(spark, SF001)


def _write_in_two_phases(df, path, ts_col="created_at"):
    """Rows that arrived before CUT first, the rest after, as two appends."""
    early, late = df.where(F.col(ts_col) < F.lit(CUT)), df.where(F.col(ts_col) >= F.lit(CUT))
    return lambda phase: (early if phase == 0 else late).coalesce(1).write.mode("append").parquet(path)


def _run_two_phases(writers, start):
    for phase in (0, 1):
        for w in writers:
            w(phase)
        q = start()
        q.awaitTermination()
        assert q.exception() is None


def test_credit_stream_equals_batch(spark, t, scratch):
    w1 = _write_in_two_phases(t["sales"], f"{scratch}/sales")
    w2 = _write_in_two_phases(t["payments"], f"{scratch}/payments")
    start = lambda: jobs.start_credit_alerts(spark, f"{scratch}/sales", f"{scratch}/payments", t["customers"],  # noqa
                                             f"{scratch}/out", checkpoint=f"{scratch}/ck")
    _run_two_phases([w1, w2], start)
    got = spark.read.parquet(f"{scratch}/out/alerts").select("customer_id", "event_id", "message", "alert_date")
    want = credit.credit_limit_crossings(t).select("customer_id", "event_id", "message", "alert_date")
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stock_stream_equals_replay(spark, t, scratch):
    w1 = _write_in_two_phases(t["branch_transfers"], f"{scratch}/transfers")
    w2 = _write_in_two_phases(t["closing_counts"], f"{scratch}/counts")
    start = lambda: jobs.start_stock_ledger(spark, f"{scratch}/transfers", f"{scratch}/counts",  # noqa
                                            t["breakdown_records"], f"{scratch}/out", checkpoint=f"{scratch}/ck")
    _run_two_phases([w1, w2], start)
    got = jobs.latest_state(spark, f"{scratch}/out", LEDGER, ["branch_id", "product_id"], f"{scratch}/ck")
    cols = ["branch_id", "product_id", "stock_date", "opening_kg", "received_kg", "closing_kg"]
    want = stock.stock_ledger_replay(t).select(*cols)
    got = got.select(*cols)
    assert got.count() == want.count() > 0
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_validated_ingest_stream(spark, t, scratch):
    raw = t["raw_sales"]
    raw.where(F.col("sale_date") < F.lit(CUT.date())).coalesce(1).write.parquet(f"{scratch}/raw")
    dims = {k: t[k] for k in ("branches", "products", "customers")}
    q = jobs.start_validated_ingest(spark, f"{scratch}/raw", dims, f"{scratch}/db", f"{scratch}/quarantine",
                                    checkpoint=f"{scratch}/ck")
    q.awaitTermination()
    raw.where(F.col("sale_date") >= F.lit(CUT.date())).coalesce(1).write.mode("append").parquet(f"{scratch}/raw")
    q = jobs.start_validated_ingest(spark, f"{scratch}/raw", dims, f"{scratch}/db", f"{scratch}/quarantine",
                                    checkpoint=f"{scratch}/ck")
    q.awaitTermination()
    ok = spark.read.parquet(f"{scratch}/db/sales")
    bad = spark.read.parquet(f"{scratch}/quarantine/sales")
    v = validate.validate_sales(t)
    assert ok.count() == v.where("reject_reason IS NULL").count()
    assert bad.count() == v.where("reject_reason IS NOT NULL").count() > 0
    assert ok.count() + bad.count() == raw.count()


def test_branch_totals_stream_equals_full_profit(spark, t, scratch):
    w1 = _write_in_two_phases(t["sales"], f"{scratch}/sales")
    w2 = _write_in_two_phases(t["expenses"], f"{scratch}/expenses")
    start = lambda: jobs.start_branch_totals(spark, f"{scratch}/sales", f"{scratch}/expenses", t["products"],  # noqa
                                             f"{scratch}/out", checkpoint=f"{scratch}/ck")
    _run_two_phases([w1, w2], start)
    got = jobs.branch_totals(spark, f"{scratch}/out", f"{scratch}/ck")
    cols = ["branch_id", "report_date", "revenue", "discount_given", "expenses", "gross_profit"]
    want = profit.daily_branch_profit_full(t).select(*cols)
    got = got.select(*[F.col(c).cast("double") if c not in cols[:2] else F.col(c) for c in cols])
    want = want.select(*[F.col(c).cast("double") if c not in cols[:2] else F.col(c) for c in cols])
    assert got.count() == want.count()
    assert got.exceptAll(want).count() == 0


def test_alert_regeneration_for_touched_days(spark, t, scratch):
    names = ["branches", "products", "sales", "expenses", "daily_stock"]
    year = {"sales": "sale_date", "expenses": "expense_date", "daily_stock": "stock_date"}
    # a day's alerts read only that day's rows: storing one year keeps the partition count small
    store_tables({n: (t[n].where(F.year(year[n]) == 1997) if n in year else t[n]) for n in names}, f"{scratch}/db")
    # a micro-batch touches a few days: here every stock day of one month
    days = (t["daily_stock"].where(F.trunc("stock_date", "month") == F.lit(dt.date(1997, 3, 1)))
            .select(F.col("stock_date").alias("alert_date")).distinct())
    for run in ("20260101-1", "20260101-1", "20260102-0"):  # a run repeated, and a later one, leave the same rows
        jobs.regenerate_for_days(spark, f"{scratch}/db", f"{scratch}/alerts", days, run)
        got = current_alerts(spark, f"{scratch}/alerts").select("alert_type", "alert_date", "message", "severity")
        want = (alerts.variance_alerts(t).unionByName(alerts.profit_alerts(t))
                .join(days, "alert_date", "left_semi").select("alert_type", "alert_date", "message", "severity"))
        assert got.count() == want.count() > 0
        assert got.exceptAll(want).count() == 0
    tt = load_tables(spark, f"{scratch}/db", names)
    assert tt["sales"].count() == t["sales"].where(F.year("sale_date") == 1997).count()


def test_a_stream_that_lost_its_checkpoint_keeps_earlier_results(spark, t, scratch):
    """Batch numbers start anew; what the first stream ingested stays, and the new alerts win."""
    dims = {k: t[k] for k in ("branches", "products", "customers")}
    t["raw_sales"].limit(400).coalesce(1).write.parquet(f"{scratch}/raw1")
    t["raw_sales"].exceptAll(t["raw_sales"].limit(400)).limit(300).coalesce(1).write.parquet(f"{scratch}/raw2")
    counts = []
    for n in (1, 2):  # the second has a checkpoint folder of its own, empty
        jobs.start_validated_ingest(spark, f"{scratch}/raw{n}", dims, f"{scratch}/db", f"{scratch}/quarantine", checkpoint=f"{scratch}/ck{n}").awaitTermination()
        counts.append(spark.read.parquet(f"{scratch}/db/sales").count() + spark.read.parquet(f"{scratch}/quarantine/sales").count())
    assert counts == [400, 700]
    assert stream_id(spark, f"{scratch}/ck1") < stream_id(spark, f"{scratch}/ck2") == stream_id(spark, f"{scratch}/ck2")

    names = ["branches", "products", "sales", "expenses", "daily_stock"]
    days = t["expenses"].select("expense_date").distinct().orderBy("expense_date").limit(3)
    some = t["expenses"].join(days, "expense_date", "left_semi")
    some.coalesce(1).write.parquet(f"{scratch}/changes")
    dear = t["expenses"].withColumn("amount", (F.col("amount") + 900000).cast("decimal(12,2)"))
    for n, expenses in ((1, t["expenses"]), (2, dear)):  # the days' expenses are corrected before the second run
        store_tables({k: (expenses if k == "expenses" else t[k]).join(days.withColumnRenamed("expense_date", c), c, "left_semi") if (c := {"sales": "sale_date", "expenses": "expense_date", "daily_stock": "stock_date"}.get(k)) else t[k] for k in names}, f"{scratch}/db{n}")
        jobs.start_alert_regeneration(spark, f"{scratch}/changes", "expense_date", f"{scratch}/db{n}", f"{scratch}/alerts", t["expenses"].schema, checkpoint=f"{scratch}/ack{n}").awaitTermination()
    tt = load_tables(spark, f"{scratch}/db2", names)
    want = alerts.variance_alerts(tt).unionByName(alerts.profit_alerts(tt)).select("alert_type", "alert_date", "message")
    got = current_alerts(spark, f"{scratch}/alerts").select("alert_type", "alert_date", "message")
    assert got.count() == want.count() > 0 and got.exceptAll(want).count() == 0


def test_a_keyed_snapshot_rewrites_only_touched_buckets(spark, scratch):
    snap = KeyedSnapshot(spark, f"{scratch}/snap", "k bigint, n decimal(28,0)", ["k"], buckets=4)
    table = lambda rows: spark.createDataFrame(rows, "k bigint, n bigint")
    held = {}
    for version in range(5):
        rows = [(k, version + k) for k in range(version, 60, version + 1)] if version != 3 else [(7, 1)]
        for _ in range(2):  # a repeated batch changes nothing
            snap.add(version, table(rows), ["k"], ["n"])
        for k, n in rows:
            held[k] = held.get(k, 0) + n
        assert {r["k"]: int(r["n"]) for r in snap.current().collect()} == held
    before, after = snap._manifest(3), snap._manifest(4)
    assert len(before) == 4 and sum(v == 3 for v in before.values()) == 1  # one key, one bucket
    manifests = spark.read.schema("bucket int, held bigint, version bigint").parquet(f"{scratch}/snap/manifest")
    assert {r["version"] for r in manifests.select("version").distinct().collect()} == {3, 4} and len(after) == 4
