"""Listings: dimension-enriched, optionally filtered, ordered reads.

An optional filter is applied only when its argument is given (the
reference's ``$1 IS NULL OR col = $1``), so the scan gets the predicate
pushed down when there is one. Ordering is a distributed range sort.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.functions.prefix import with_position
from tallyman.operators.credit import customer_balances

Tables = Mapping[str, DataFrame]


def _where(df: DataFrame, **eq) -> DataFrame:
    for col, value in eq.items():
        if value is not None:
            df = df.where(F.col(col) == F.lit(value))
    return df


def _names(t: Tables, table: str, prefix: str) -> DataFrame:
    return t[table].select(F.col("id").alias(f"{prefix}_id"), F.col("name").alias(f"{prefix}_name"))


def list_branches(t: Tables) -> DataFrame:
    """L1: main branch first, then by name (with each row's position)."""
    b = t["branches"].select("id", "name", "is_main")
    return with_position(b, [F.col("is_main").desc(), F.col("name"), F.col("id")]).orderBy("position")


def list_products(t: Tables) -> DataFrame:
    """L2: meat before by-products, then by name (with each row's position)."""
    p = t["products"].select("id", "name", "price_per_kg", "is_byproduct")
    return with_position(p, [F.col("is_byproduct"), F.col("name"), F.col("id")]).orderBy("position")


def list_daily_stock(t: Tables, date: dt.date | None = None, branch_id: int | None = None) -> DataFrame:
    """L3: stock rows with branch and product names; newest day first, then product."""
    ds = _where(t["daily_stock"], stock_date=date, branch_id=branch_id)
    return (ds.join(_names(t, "branches", "branch"), "branch_id").join(_names(t, "products", "product"), "product_id")
            .orderBy(F.col("stock_date").desc(), "product_name"))


def list_sales(t: Tables, branch_id: int | None = None, date: dt.date | None = None) -> DataFrame:
    """L4: sales with branch, product and (if any) customer name and type;
    newest first."""
    s = _where(t["sales"], branch_id=branch_id, sale_date=date)
    cu = t["customers"].select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"),
                               F.col("customer_type"))
    return (s.join(_names(t, "branches", "branch"), "branch_id").join(_names(t, "products", "product"), "product_id")
            .join(cu, "customer_id", "left")
            .orderBy(F.col("sale_date").desc(), F.col("created_at").desc()))


def list_carcass_purchases(t: Tables, date: dt.date | None = None) -> DataFrame:
    """Carcass purchases with branch name; newest first."""
    cp = _where(t["carcass_purchases"], purchase_date=date)
    return (cp.join(_names(t, "branches", "branch"), "branch_id")
            .orderBy(F.col("purchase_date").desc(), F.col("created_at").desc()))


def list_breakdown_records(t: Tables, carcass_purchase_id: int | None = None) -> DataFrame:
    """Breakdown records with product name; newest carcass first, then product."""
    br = _where(t["breakdown_records"], carcass_purchase_id=carcass_purchase_id)
    return (br.join(_names(t, "products", "product"), "product_id")
            .orderBy(F.col("carcass_purchase_id").desc(), "product_name"))


def list_branch_transfers(t: Tables, breakdown_record_id: int | None = None) -> DataFrame:
    """Transfers with the receiving branch's name; newest first."""
    tr = _where(t["branch_transfers"], breakdown_record_id=breakdown_record_id)
    b = t["branches"].select(F.col("id").alias("to_branch_id"), F.col("name").alias("to_branch_name"))
    return tr.join(b, "to_branch_id").orderBy(F.col("transfer_date").desc())


def list_payments(t: Tables, customer_id: int | None = None) -> DataFrame:
    """Payments with customer name; newest first."""
    p = _where(t["payments"], customer_id=customer_id)
    return p.join(_names(t, "customers", "customer"), "customer_id").orderBy(F.col("payment_date").desc())


def list_expenses(t: Tables, branch_id: int | None = None, date: dt.date | None = None) -> DataFrame:
    """Expenses with branch name; newest first."""
    e = _where(t["expenses"], branch_id=branch_id, expense_date=date)
    return e.join(_names(t, "branches", "branch"), "branch_id").orderBy(F.col("expense_date").desc())


def list_customers(t: Tables) -> DataFrame:
    """Every customer (not only those owing), largest balance first,
    with the over-limit flag the credit screen shows."""
    c = customer_balances(t)
    return (c.withColumn("over_limit", F.col("balance_owed") > F.col("credit_limit"))
            .orderBy(F.col("balance_owed").desc(), "name"))


def list_notifications(t: Tables, is_read: str | None = None, branch_id: int | None = None) -> DataFrame:
    """Notifications with branch and customer names. ``is_read`` is the
    query-string text: 'true' → read only, any other text → unread only,
    absent → all. Newest first."""
    n = t["notifications"]
    if is_read is not None:
        n = n.where(F.col("is_read") == F.lit(is_read == "true"))
    n = _where(n, branch_id=branch_id)
    return (n.join(_names(t, "branches", "branch"), "branch_id", "left")
            .join(_names(t, "customers", "customer"), "customer_id", "left")
            .orderBy(F.col("created_at").desc(), F.col("id").desc()))
