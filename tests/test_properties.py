"""Invariants (SURVEY §5 (3)) and edge rows (§5 (4))."""

import datetime as dt
import re
from decimal import Decimal as D

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from paths import SF001
from tallyman.functions.dates import period_end
from tallyman.functions.prefix import running_total, with_position
from tallyman.operators import alerts, credit, profit, stock, validate, yields
from tallyman.plans.queries import RUN_DATE
from tallyman.sources.fixtures import fixture_tables
from tallyman.sources.seed import SEED_DATE


@pytest.fixture(scope="module")
def t(spark):
    return fixture_tables(spark, SF001)


def test_validation_keeps_every_row_once(t):
    for fn, raw in [(validate.validate_sales, "raw_sales"), (validate.validate_closing_counts, "raw_closing_counts"),
                    (validate.validate_branch_transfers, "raw_branch_transfers"),
                    (validate.validate_payments, "raw_payments"), (validate.validate_expenses, "raw_expenses"),
                    (validate.validate_customers, "raw_customers"),
                    (validate.validate_carcass_purchases, "raw_carcass_purchases")]:
        out = fn(t)
        assert out.count() == t[raw].count(), raw
        assert out.select("id").distinct().count() == t[raw].select("id").distinct().count()


def test_validation_reasons_seen(t):
    got = {r[0] for r in validate.validate_sales(t).select("reject_reason").distinct().collect()}
    assert {None, "missing_required", "bad_payment_type", "credit_needs_customer", "bad_weight_or_price",
            "bad_discount_reason", "unknown_product"} <= got
    got = {r[0] for r in validate.validate_closing_counts(t).select("reject_reason").distinct().collect()}
    assert {None, "bad_closing", "closing_null"} <= got


def test_breakdown_batches_all_or_nothing(t):
    v = validate.validate_breakdown_batches(t)
    mixed = v.groupBy("post_id").agg(F.countDistinct(F.coalesce("reject_reason", F.lit("ok"))).alias("n"))
    assert mixed.where("n > 1").count() == 0
    reasons = {r[0] for r in v.select("reject_reason").distinct().collect()}
    assert {None, "missing_required", "negative_output", "duplicate_product"} <= reasons


def test_ledger_received_equals_transfers(t):
    total = t["branch_transfers"].agg(F.sum("weight_sent_kg")).first()[0]
    assert stock.stock_ledger_build(t).agg(F.sum("received_kg")).first()[0] == total
    assert stock.stock_ledger_replay(t).agg(F.sum("received_kg")).first()[0] == total


def test_replay_differs_from_settled_only_in_openings(t):
    cols = ["branch_id", "product_id", "stock_date"]
    a = stock.stock_ledger_build(t).alias("a")
    b = stock.stock_ledger_replay(t).alias("b")
    j = a.join(b, cols)
    assert j.count() == a.count() == b.count()
    assert j.where((F.col("a.received_kg") != F.col("b.received_kg"))
                   | (F.col("a.closing_kg") != F.col("b.closing_kg"))).count() == 0
    assert j.where(F.col("a.opening_kg") != F.col("b.opening_kg")).count() > 0


def test_loss_plus_output_is_received(t):
    bad = yields.breakdown_loss(t).where(F.col("loss_kg") + F.col("total_output_kg") != F.col("received_weight_kg"))
    assert bad.count() == 0


def test_statement_ends_at_balance(t):
    last = (credit.customer_statement(t).groupBy("customer_id")
            .agg(F.max_by("running_balance", F.struct("entry_date", "entry_type", "created_at", "entry_id"))
                 .alias("end"), F.sum("amount").alias("total"), F.count(F.lit(1)).alias("n")))
    bal = credit.customer_balances(t).select("customer_id", "balance_owed")
    j = last.join(bal, "customer_id")
    assert j.where(F.col("end") != F.col("total")).count() == 0
    # the stored balance rounds each charge to cents (half a cent at most per entry)
    diff = j.where(F.abs(F.col("end") - F.col("balance_owed")) > F.col("n") * D("0.005"))
    assert diff.count() == 0


def test_regeneration_twice_equals_once(t):
    once = alerts.regenerate_alerts({**t}, RUN_DATE)
    twice = alerts.replace_alert_partitions(
        once, alerts.variance_alerts(t).unionByName(alerts.profit_alerts(t)).unionByName(alerts.target_alerts(t, RUN_DATE)),
        alerts.regenerated_scope(t, RUN_DATE))
    assert once.exceptAll(twice).count() == 0 and twice.exceptAll(once).count() == 0


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 40), st.integers(-500, 500)), min_size=1, max_size=60))
def test_running_total_equals_plain_window(spark, rows):
    rows = [(k if i % 3 else 0, d, i, v) for i, (k, d, v) in enumerate(rows)]  # key 0 is hot
    df = spark.createDataFrame(rows, "k int, d int, id int, v int")
    got = running_total(df, ["k"], [F.col("d"), F.col("id")], "v", "run")
    w = Window.partitionBy("k").orderBy("d", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumn("run", F.sum("v").over(w))
    assert sorted(got.select("id", "run").collect()) == sorted(want.select("id", "run").collect())


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.text(alphabet="abc", max_size=2)), min_size=1, max_size=40))
def test_position_equals_global_row_number(spark, rows):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "id int, a int, b string")
    got = with_position(df, [F.col("a").desc_nulls_first(), F.col("b"), F.col("id")])
    want = df.withColumn("position", F.row_number().over(Window.orderBy(F.col("a").desc(), "b", "id")))
    assert sorted(got.select("id", "position").collect()) == sorted(want.select("id", "position").collect())


# --- edge rows ---------------------------------------------------------------------
def _with(seed, **tables):
    return {**seed, **tables}


def test_zero_available_gives_null_pct_and_no_alert(spark, seed):
    ds = spark.createDataFrame([(1, 1, 1, SEED_DATE, D("0"), D("0"), D("0"))], seed["daily_stock"].schema)
    sales = seed["sales"].where("1 = 0")
    t = _with(seed, daily_stock=ds, sales=sales)
    [r] = stock.daily_stock_variance(t).collect()
    assert r["variance_pct"] is None and r["variance_kg"] == 0
    assert alerts.variance_alerts(t).count() == 0


def test_variance_thresholds_are_strict(spark, seed):
    # available 100, no sales: closing 95 → 5.00 % (no alert), 94 → 6 % warning, 85 → 15 % warning, 84 → critical
    rows = [(i, 1, i, SEED_DATE, D("50"), D("50"), D(c)) for i, c in enumerate(["95", "94", "85", "84"], start=1)]
    ds = spark.createDataFrame(rows, seed["daily_stock"].schema)
    t = _with(seed, daily_stock=ds, sales=seed["sales"].where("1 = 0"))
    got = sorted((re.search(r"\((.*)%\)", r["message"]).group(1), r["severity"])
                 for r in alerts.variance_alerts(t).collect())
    assert got == [("15.00", "warning"), ("16.00", "critical"), ("6.00", "warning")]


def test_zero_target_and_target_threshold(spark, seed):
    start = dt.date(2026, 7, 13)
    pt = spark.createDataFrame([(1, 1, "weekly", start, D("0")), (2, 1, "daily", SEED_DATE, D("54437.50")),
                                (3, 1, "daily", dt.date(2026, 7, 15), D("54437.51"))], seed["profit_targets"].schema)
    t = _with(seed, profit_targets=pt)
    rows = {r["profit_target_id"]: r for r in profit.branch_target_progress(t).collect()}
    assert rows[1]["pct_of_target"] is None
    assert rows[2]["pct_of_target"] == D("80.0")       # 43550 / 54437.50 = 80 % exactly: no alert
    assert rows[3]["pct_of_target"] == D("0.0")
    assert {r["message"] for r in alerts.target_alerts(t, RUN_DATE).collect()} == {"Main branch is at 0.0% of its daily target"}


def test_month_end_period(spark):
    df = spark.createDataFrame([("monthly", dt.date(2026, 1, 31)), ("monthly", dt.date(2026, 2, 1)),
                                ("weekly", dt.date(2026, 12, 28)), ("daily", dt.date(2026, 3, 1))], "t string, s date")
    got = [r[0] for r in df.select(period_end("t", "s")).collect()]
    assert got == [dt.date(2026, 2, 27), dt.date(2026, 2, 28), dt.date(2027, 1, 3), dt.date(2026, 3, 1)]


def test_exact_limit_is_not_a_crossing(spark, seed):
    ts = dt.datetime(2026, 7, 14, 12)
    more = spark.createDataFrame([(11, 1, 1, 1, SEED_DATE, D("1.00"), D("600.00"), "credit", "none", ts)],
                                 seed["sales"].schema)
    t = _with(seed, sales=seed["sales"].unionByName(more))   # 2400 + 600 = 3000 = limit
    assert credit.credit_limit_crossings(t).count() == 0
    assert credit.credit_over_limit_updates(t).count() == 0


def test_null_reason_counts_no_discount(spark, seed):
    sales = seed["sales"].withColumn("discount_reason", F.lit(None).cast("string"))
    [r] = profit.daily_revenue(_with(seed, sales=sales)).collect()
    assert r["discount_given"] == 0


def test_gap_days_fill_from_latest_earlier_row(spark, seed):
    s = seed["daily_stock"].schema
    ds = spark.createDataFrame([(1, 1, 1, dt.date(2026, 7, 1), D("0"), D("10"), D("7")),
                                (2, 1, 1, dt.date(2026, 7, 9), None, D("10"), D("3")),
                                (3, 1, 1, dt.date(2026, 7, 20), D("1"), D("0"), D("0"))], s)
    rows = {r["id"]: r["opening_kg"] for r in stock.opening_stock_fill({"daily_stock_unfilled": ds}).collect()}
    assert rows == {1: D("0"), 2: D("7"), 3: D("1")}
