"""The reference's own expected values, on its seed data (FIXTURES.md §1)."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyman.operators import alerts, credit, profit, reports, stock, yields
from tallyman.sources.seed import SEED_DATE

DAY = SEED_DATE


def by(rows, key):
    return {r[key]: r for r in rows}


def test_variance_view(seed):
    rows = by(stock.daily_stock_variance(seed).collect(), "product_name")
    expect = {"Beef cuts": ("42.00", "1.00", "1.92"), "Mutton": ("19.00", "3.00", "11.54"),
              "Matumbo": ("9.00", "0.00", "0.00"), "Liver": ("0", "5.00", "83.33"),
              "Bones": ("0", "12.00", "80.00"), "Fat": ("0", "7.00", "77.78")}
    for name, (sold, kg, pct) in expect.items():
        r = rows[name]
        assert r["sold_kg"] == D(sold) and r["variance_kg"] == D(kg) and r["variance_pct"] == D(pct), r


def test_profit_view(seed):
    [r] = profit.daily_branch_profit(seed).collect()
    assert (r["branch_name"], r["report_date"]) == ("Main branch", DAY)
    assert r["revenue"] == D("44050.0000") and r["discount_given"] == D("200.0000")
    assert r["expenses"] == D("500.00") and r["gross_profit"] == D("43550.0000")


def test_expense_only_day_vanishes_in_view_but_not_in_fix(spark, seed):
    extra = spark.createDataFrame([(2, 2, DAY, "Rent", D("99.00"), dt.datetime(2026, 7, 14, 9))],
                                  seed["expenses"].schema)
    t = {**seed, "expenses": seed["expenses"].unionByName(extra)}
    assert [r["branch_name"] for r in profit.daily_branch_profit(t).collect()] == ["Main branch"]
    b = by(profit.daily_branch_profit_full(t).collect(), "branch_name")["Branch B"]
    assert (b["revenue"], b["expenses"], b["gross_profit"]) == (0, D("99.00"), D("-99.00"))


def test_target_progress(seed):
    [r] = profit.branch_target_progress(seed).collect()
    assert r["period_start"] == dt.date(2026, 7, 13) and r["period_end"] == dt.date(2026, 7, 19)
    assert r["actual_profit"] == D("43550") and r["pct_of_target"] == D("90.7")


def test_variance_alerts_four_not_three(seed):
    rows = alerts.variance_alerts(seed, on=DAY).collect()
    sev = {r["message"].split(": ")[1].split(" variance")[0]: r["severity"] for r in rows}
    assert sev == {"Mutton": "warning", "Liver": "critical", "Bones": "critical", "Fat": "critical"}
    assert "Main branch: Mutton variance is 3.00kg (11.54%), above normal" in {r["message"] for r in rows}


def test_no_profit_or_target_alerts(seed):
    assert alerts.profit_alerts(seed, on=DAY).count() == 0
    assert alerts.target_alerts(seed, run_date=DAY).count() == 0


def test_regeneration_is_idempotent(seed):
    scope = alerts.regenerated_scope(seed, run_date=DAY)
    fresh = alerts.variance_alerts(seed)
    once = alerts.replace_alert_partitions(seed["notifications"], fresh, scope)
    twice = alerts.replace_alert_partitions(once, fresh, scope)
    assert once.where(F.col("alert_type") == "high_variance").count() == 4
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


def _credit_sequence(spark, seed):
    """The trigger test: +5 kg @ 650 credit, −2000 payment, +1 kg @ 650 credit."""
    ts = lambda h: dt.datetime(2026, 7, 14, h)
    more = spark.createDataFrame(
        [(11, 1, 1, 1, DAY, D("5.00"), D("650.00"), "credit", "regular_customer", ts(12)),
         (12, 1, 1, 1, DAY, D("1.00"), D("650.00"), "credit", "regular_customer", ts(14))],
        seed["sales"].schema)
    pay = spark.createDataFrame([(1, 1, 1, DAY, D("2000.00"), ts(13))], seed["payments"].schema)
    return {**seed, "sales": seed["sales"].unionByName(more), "payments": pay}


def test_balance_sequence(spark, seed):
    t = _credit_sequence(spark, seed)
    hist = credit.balance_history(t).orderBy("created_at", "kind", "event_id").collect()
    assert [r["balance_after"] for r in hist] == [D("2400.00"), D("5650.00"), D("3650.00"), D("4300.00")]
    [b] = credit.customer_balances(t).collect()
    assert b["balance_owed"] == D("4300.00")


def test_credit_crossing_alert_once(spark, seed):
    t = _credit_sequence(spark, seed)
    msgs = [r["message"] for r in credit.credit_limit_crossings(t).collect()]
    assert msgs == ["Mama Njeri crossed their credit limit of 3000.00, now owes 5650.00"]
    every = sorted(r["balance_after"] for r in credit.credit_over_limit_updates(t).collect())
    assert every == [D("3650.00"), D("4300.00"), D("5650.00")]


def test_statement_first_line(seed):
    [r] = credit.customer_statement(seed).collect()
    assert r["description"] == "Beef cuts — 4.00kg @ 600.00 (Main branch)"
    assert r["amount"] == D("2400") and r["running_balance"] == D("2400")


def test_transfer_creates_next_day_row(spark, seed):
    tomorrow = DAY + dt.timedelta(days=1)
    tr = spark.createDataFrame([(9, 1, 1, D("15.00"), tomorrow, dt.datetime(2026, 7, 15, 7))],
                               seed["branch_transfers"].schema)
    t = {**seed, "branch_transfers": tr}
    rows = stock.transfers_to_stock(t).where((F.col("product_id") == 1) & (F.col("stock_date") == tomorrow)).collect()
    assert [(r["opening_kg"], r["received_kg"], r["closing_kg"]) for r in rows] == [(D("9.00"), D("15.00"), D("0.00"))]


def test_yield_and_loss(seed):
    assert yields.breakdown_yield(seed).where("flagged").count() == 0
    [r] = yields.breakdown_loss(seed).collect()
    assert r["total_output_kg"] == D("158.00") and r["loss_kg"] == D("18.00")
    assert round(r["loss_pct"], 1) == 10.2


def test_allocation_matrix(seed):
    rows = yields.allocation_matrix(seed).where(F.col("to_branch_id").isNotNull()).collect()
    assert sorted(r["sent_kg"] for r in rows) == [D("27.00"), D("30.00"), D("40.00")]
    assert {r["total_sent_kg"] for r in rows} == {D("97.00")}


def test_default_branch_and_sheet(seed):
    [b] = reports.default_branch(seed).collect()
    assert b["name"] == "Main branch"
    sheet = reports.closing_sheet(seed).collect()
    assert len(sheet) == 6 and all(r["entered"] for r in sheet)


def test_branch_report_nested(seed):
    [r] = reports.branch_report(seed).collect()
    assert (r["branch_name"], r["report_date"], r["profit"]["gross_profit"]) == ("Main branch", DAY, D("43550.0000"))
    assert [x["product_name"] for x in r["stock_variance"]] == ["Beef cuts", "Bones", "Fat", "Liver", "Matumbo", "Mutton"]
    assert [x["pct_of_target"] for x in r["targets"]] == [D("90.7")]
