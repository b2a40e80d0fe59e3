"""Listing filters and orders, comparison order, row scope."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from paths import SF001
from tallyman.operators import listings, reports, scope
from tallyman.sources.fixtures import fixture_tables
from tallyman.sources.seed import SEED_DATE


def test_is_read_text_filter(spark):
    t = fixture_tables(spark, SF001)
    n = t["notifications"]
    total, read = n.count(), n.where("is_read").count()
    assert listings.list_notifications(t).count() == total
    assert listings.list_notifications(t, is_read="true").count() == read
    assert listings.list_notifications(t, is_read="yes").count() == total - read   # any other text: unread
    assert listings.list_notifications(t, is_read="false", branch_id=3).where(F.col("branch_id") != 3).count() == 0


def test_optional_sales_filters(spark):
    t = fixture_tables(spark, SF001)
    day = t["sales"].select(F.min("sale_date")).first()[0]
    rows = listings.list_sales(t, branch_id=2, date=day).collect()
    want = t["sales"].where((F.col("branch_id") == 2) & (F.col("sale_date") == day)).count()
    assert len(rows) == want and all(r["branch_id"] == 2 and r["sale_date"] == day for r in rows)
    ordered = listings.list_sales(t, branch_id=2).select("sale_date", "created_at").collect()
    assert ordered == sorted(ordered, key=lambda r: (r[0], r[1]), reverse=True)


def test_comparison_puts_null_pct_first(spark, seed):
    start = dt.date(2026, 7, 13)
    pt = spark.createDataFrame([(1, 1, "weekly", start, D("48000")), (2, 2, "weekly", start, D("0")),
                                (3, 3, "weekly", start, D("1000"))], seed["profit_targets"].schema)
    rows = reports.branch_comparison({**seed, "profit_targets": pt}).orderBy("position").collect()
    assert [r["branch_id"] for r in rows] == [2, 1, 3]       # NULL pct first, then 90.7 %, then 0 %
    assert [r["position"] for r in rows] == [1, 2, 3]


def test_scope_admin_all_attendant_own(seed):
    rows = scope.branch_scope(seed).collect()
    sales = {r["id"]: r["branch_id"] for r in seed["sales"].collect()}
    assert {r["row_id"] for r in rows} == set(sales) and len(rows) == len(sales)
    assert all(r["admin_sees"] for r in rows)
    assert {r["row_id"]: r["first_attendant_id"] for r in rows} == {s: 2 if b == 1 else None for s, b in sales.items()}
    seen = lambda *who: {r["id"] for r in scope.visible_rows(seed["sales"], *who).collect()}
    assert seen("admin", None) == set(sales)
    assert seen("attendant", 1) == {s for s, b in sales.items() if b == 1}
    assert seen("attendant", None) == set()


def test_latest_target_per_type(spark, seed):
    pt = spark.createDataFrame([(1, 1, "weekly", dt.date(2026, 7, 6), D("1")), (2, 1, "weekly", dt.date(2026, 7, 13),
                                D("48000")), (3, 1, "daily", SEED_DATE, D("40000"))], seed["profit_targets"].schema)
    rows = reports.latest_target_comparison({**seed, "profit_targets": pt}).collect()
    assert sorted((r["period_type"], r["profit_target_id"]) for r in rows) == [("daily", 3), ("weekly", 2)]
