"""Cases that the stand-in tables don't reach by themselves: huge keys and weights,
days without facts, hot keys, folders of a cluster."""

import datetime as dt
from decimal import Decimal as D
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from tallyman.operators import credit, listings, reports, stock
from tallyman.session import checkpoint_dir
from tallyman.sources.fixtures import _line_id

DAY = dt.date(2026, 7, 16)
STOCK = "id bigint, branch_id bigint, product_id bigint, stock_date date, opening_kg decimal(28,2), received_kg decimal(28,2), closing_kg decimal(28,2)"


def test_report_of_a_day_without_facts(seed):
    [r] = reports.branch_report(seed, date=dt.date(2031, 1, 1), branch_id=1).collect()
    assert r["profit"] is None and r["stock_variance"] == [] and r["report_date"] == dt.date(2031, 1, 1)


def test_stock_day_above_a_million_kg(spark, seed):
    ds = spark.createDataFrame([(1, 1, 1, DAY, D("900000.00"), D("900000.00"), D("1500000.00"))], STOCK)
    [v] = stock.daily_stock_variance({**seed, "daily_stock": ds, "sales": seed["sales"].limit(0)}).collect()
    assert v["variance_kg"] == D("300000.00")
    count = spark.createDataFrame([(1, 1, 1, DAY, D("2000000.00"), dt.datetime(2026, 7, 16, 23))], "id bigint, branch_id bigint, product_id bigint, stock_date date, closing_kg decimal(28,2), created_at timestamp_ntz")
    [r] = stock.closing_count_upsert({**seed, "daily_stock": ds, "closing_counts": count}).collect()
    assert r["closing_kg"] == D("2000000.00") and not r["created"]


def test_count_of_a_day_without_stock_row_creates_it(spark, seed):
    ds = spark.createDataFrame([(1, 1, 1, DAY, D("1"), D("2"), D("3"))], STOCK)
    count = spark.createDataFrame([(1, 1, 1, DAY + dt.timedelta(2), D("7"), dt.datetime(2026, 7, 18, 23))], "id bigint, branch_id bigint, product_id bigint, stock_date date, closing_kg decimal(28,2), created_at timestamp_ntz")
    rows = {r["stock_date"]: r for r in stock.closing_count_upsert({**seed, "daily_stock": ds, "closing_counts": count}).collect()}
    new = rows[DAY + dt.timedelta(2)]
    assert new["created"] and (new["opening_kg"], new["received_kg"], new["closing_kg"]) == (D("3"), D("0"), D("7"))


def test_line_ids_of_huge_keys(spark):
    rows = [(10**12 + i, j, 10**9, 10**8) for i in range(50) for j in range(7)]
    ids = spark.createDataFrame(rows, "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint").select(_line_id().alias("id")).collect()
    assert len({r["id"] for r in ids}) == len(rows) and all(0 <= r["id"] < 2**60 for r in ids)


def test_a_customers_single_day_is_split(spark, seed):
    """One customer, one day, many changes: slices are smaller than the day."""
    n = 4000
    sales = spark.range(n).select(
        F.col("id"), F.lit(1).cast("bigint").alias("branch_id"), F.lit(1).cast("bigint").alias("product_id"), F.lit(1).cast("bigint").alias("customer_id"),
        F.lit(DAY).alias("sale_date"), F.lit(D("1.00")).alias("weight_kg"), F.lit(D("2.00")).alias("price_charged"), F.lit("credit").alias("payment_type"),
        F.lit(None).cast("string").alias("discount_reason"), F.lit(dt.datetime(2026, 7, 16)).cast("timestamp_ntz").alias("created_at"))
    t = {**seed, "sales": sales, "payments": seed["payments"].limit(0)}
    out = credit.customer_statement(t).where("customer_id = 1").orderBy("entry_id").select("running_balance").collect()
    assert [r[0] for r in out] == [D("2.0000") * (i + 1) for i in range(n)]


def test_branch_day_details_meet_their_total_in_slices(seed):
    plan = reports.sales_day_total(seed)._jdf.queryExecution().optimizedPlan().toString()
    assert "_slice" in plan


@pytest.mark.parametrize("name,keys", [
    ("list_daily_stock", [("stock_date", True), ("product_name", False)]),
    ("list_sales", [("sale_date", True), ("created_at", True)]),
    ("list_carcass_purchases", [("purchase_date", True)]),
    ("list_branch_transfers", [("transfer_date", True)]),
    ("list_payments", [("payment_date", True)]),
    ("list_expenses", [("expense_date", True)]),
    ("list_customers", [("balance_owed", True), ("name", False)]),
    ("list_notifications", [("created_at", True)]),
])
def test_listing_order_row_by_row(spark, name, keys):
    from paths import SF001
    from tallyman.sources.fixtures import fixture_tables

    rows = [tuple(r[k] for k, _ in keys) for r in getattr(listings, name)(fixture_tables(spark, SF001)).collect()]
    want = list(rows)
    for i, (_, down) in reversed(list(enumerate(keys))):
        want.sort(key=lambda r: r[i], reverse=down)
    assert rows == want and rows


def test_a_cluster_must_name_its_shared_folder():
    ctx = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(
        master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None))
    with pytest.raises(ValueError):
        checkpoint_dir(ctx("spark://host:7077"))
    with pytest.raises(ValueError):
        checkpoint_dir(ctx("local-cluster[2,1,1024]"))
    assert checkpoint_dir(ctx("local[2]"))
