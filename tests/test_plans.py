"""Plan shape: no cross products or nested-loop joins anywhere, and
optional filters reach the parquet scan."""

import datetime as dt
import re
from decimal import Decimal as D

import pytest
from pyspark.sql import functions as F

from paths import SF001
from tallyman.operators import listings, yields
from tallyman.plans.queries import spark_queries
from tallyman.sources.fixtures import fixture_tables

QUERIES = spark_queries()
#: Queries that run streams or write tables when they are called; only what they read back is lazy.
STREAMS = {q for q in QUERIES if q.startswith("stream_")} | {"load_tables", "append_events", "replace_alerts"}


def physical_plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - STREAMS))
def test_no_cross_products(spark, name):
    plan = physical_plan(QUERIES[name](spark, SF001))
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin"):
        assert bad not in plan, f"{name} plans a {bad}"
    # nor a product in disguise: a subquery's list exploded over the rows of another table
    assert not re.search(r"Generate explode\((coalesce\()?(Subquery|scalar-subquery)", plan), f"{name} explodes a subquery's list"


def test_listing_filters_are_pushed_to_the_scan(spark):
    t = fixture_tables(spark, SF001)
    day = dt.date(1996, 3, 1)
    plan = physical_plan(listings.list_sales(t, branch_id=3, date=day))
    assert "PushedFilters: [IsNotNull(branch_id), IsNotNull(sale_date), EqualTo(branch_id,3)" in plan \
        or ("EqualTo(branch_id,3)" in plan and "EqualTo(sale_date" in plan), plan


def test_scan_reads_only_needed_columns(spark):
    t = fixture_tables(spark, SF001)
    plan = physical_plan(listings.list_expenses(t, branch_id=2).select("id", "amount"))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line and "expenses" in line]
    assert scan and "description" not in scan[0] and "created_at" not in scan[0], scan


def test_allocation_matrix_wide(seed):
    [r] = yields.allocation_matrix_wide(seed, [1, 2, 3]).where(F.col("product_id") == 1).collect()
    assert (r["1"], r["2"], r["3"], r["total_sent_kg"]) == (D("40.00"), D("30.00"), D("27.00"), D("97.00"))
