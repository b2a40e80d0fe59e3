"""The reference's seed data as DataFrames.

Inline VALUES rows name their branch and product; ids are resolved by
joining the dimensions on name, as the seed's scalar subqueries do. The
seed's CURRENT_DATE is a parameter (default 2026-07-14, a Tuesday).
"""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.sources.schemas import KG, MONEY, PCT, PRICE, SCHEMAS

SEED_DATE = dt.date(2026, 7, 14)

# Fixed values of the reference seed script.
BRANCHES = [("Main branch", True), ("Branch B", False), ("Branch C", False)]
PRODUCTS = [("Beef cuts", "650.00", False), ("Mutton", "750.00", False), ("Matumbo", "300.00", True),
            ("Liver", "500.00", True), ("Bones", "150.00", True), ("Fat", "200.00", True)]
BREAKDOWN = [("Beef cuts", "97.00", "55.00"), ("Bones", "24.00", "12.00"), ("Fat", "22.00", "10.00"),
             ("Matumbo", "10.00", "6.00"), ("Liver", "5.00", "3.00")]
TRANSFERS = [("Main branch", "40.00"), ("Branch B", "30.00"), ("Branch C", "27.00")]
STOCK = [("Beef cuts", "12.00", "40.00", "9.00"), ("Mutton", "6.00", "20.00", "4.00"),
         ("Matumbo", "2.00", "8.00", "1.00"), ("Liver", "1.00", "5.00", "1.00"),
         ("Bones", "3.00", "12.00", "3.00"), ("Fat", "2.00", "7.00", "2.00")]
SALES = [("Beef cuts", None, "38.00", "650.00", "cash", "none"),
         ("Mutton", None, "19.00", "750.00", "cash", "none"),
         ("Matumbo", None, "9.00", "300.00", "cash", "none"),
         ("Beef cuts", "Mama Njeri", "4.00", "600.00", "credit", "regular_customer")]
CUSTOMERS = [("Mama Njeri", "individual", "0712345678", "0", "3000.00")]
EXPENSES = [("Main branch", "Transport from main branch", "500.00")]
TARGETS = [("Main branch", "weekly", "48000.00")]


def _values(spark: SparkSession, rows, ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, ddl)


def seed_tables(spark: SparkSession, today: dt.date = SEED_DATE) -> dict[str, DataFrame]:
    d = F.lit(today)
    ts = F.lit(dt.datetime.combine(today, dt.time(8, 0))).cast("timestamp_ntz")
    branches = _values(spark, [(i + 1, n, m) for i, (n, m) in enumerate(BRANCHES)],
                       "id bigint, name string, is_main boolean")
    products = _values(spark, [(i + 1, n, Decimal(p), b) for i, (n, p, b) in enumerate(PRODUCTS)],
                       "id bigint, name string, price_per_kg decimal(10,2), is_byproduct boolean")
    customers = _values(spark, [(i + 1, n, t, ph, Decimal(bal), Decimal(lim))
                                for i, (n, t, ph, bal, lim) in enumerate(CUSTOMERS)],
                        "id bigint, name string, customer_type string, phone string, "
                        "balance_owed decimal(12,2), credit_limit decimal(12,2)")
    bid = branches.select(F.col("id").alias("branch_id"), F.col("name").alias("branch_name"))
    pid = products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    main = branches.where("is_main").select(F.col("id").alias("branch_id"))
    main_id = branches.where("is_main").select(F.max("id")).scalar()

    carcass = main.select(F.lit(1).cast("bigint").alias("id"), "branch_id", F.lit("beef").alias("animal_type"),
                          F.lit(Decimal("180.00")).cast(KG).alias("invoice_weight_kg"),
                          F.lit(Decimal("176.00")).cast(KG).alias("received_weight_kg"),
                          F.lit(Decimal("65000.00")).cast(MONEY).alias("cost"),
                          d.alias("purchase_date"), ts.alias("created_at"))
    bd = _values(spark, [(i + 1, n, Decimal(o), Decimal(e)) for i, (n, o, e) in enumerate(BREAKDOWN)],
                 "id bigint, product_name string, output_weight_kg decimal(8,2), expected_yield_pct decimal(5,2)")
    breakdown = bd.join(pid, "product_name").select(
        "id", F.lit(1).cast("bigint").alias("carcass_purchase_id"), "product_id", "output_weight_kg",
        F.col("expected_yield_pct").cast(PCT), ts.alias("created_at"))
    beef_record = (breakdown.join(pid.where(F.col("product_name") == "Beef cuts"), "product_id")
                   .select(F.max("id")).scalar())
    tv = _values(spark, [(i + 1, n, Decimal(w)) for i, (n, w) in enumerate(TRANSFERS)],
                 "id bigint, branch_name string, weight_sent_kg decimal(8,2)")
    transfers = tv.join(bid, "branch_name").select(
        "id", beef_record.alias("breakdown_record_id"), F.col("branch_id").alias("to_branch_id"), "weight_sent_kg",
        d.alias("transfer_date"), ts.alias("created_at"))
    sv = _values(spark, [(i + 1, n, Decimal(o), Decimal(r), Decimal(c)) for i, (n, o, r, c) in enumerate(STOCK)],
                 "id bigint, product_name string, opening_kg decimal(8,2), received_kg decimal(8,2), "
                 "closing_kg decimal(8,2)")
    stock = sv.join(pid, "product_name").select(
        "id", main_id.alias("branch_id"), "product_id", d.alias("stock_date"), "opening_kg", "received_kg", "closing_kg")
    cust = customers.select(F.col("id").alias("customer_id"), F.col("name").alias("customer_name"))
    sl = _values(spark, [(i + 1, p, c, Decimal(w), Decimal(pr), pt, r) for i, (p, c, w, pr, pt, r) in enumerate(SALES)],
                 "id bigint, product_name string, customer_name string, weight_kg decimal(8,2), "
                 "price_charged decimal(10,2), payment_type string, discount_reason string")
    sales = (sl.join(pid, "product_name").join(cust, "customer_name", "left")
             .select("id", main_id.alias("branch_id"), "product_id", "customer_id", d.alias("sale_date"), "weight_kg",
                     F.col("price_charged").cast(PRICE), "payment_type", "discount_reason",
                     F.timestamp_add("MINUTE", F.col("id").cast("int"), ts).alias("created_at")))
    ev = _values(spark, [(i + 1, b, ds, Decimal(a)) for i, (b, ds, a) in enumerate(EXPENSES)],
                 "id bigint, branch_name string, description string, amount decimal(12,2)")
    expenses = ev.join(bid, "branch_name").select("id", "branch_id", d.alias("expense_date"), "description",
                                                  F.col("amount").cast(MONEY), ts.alias("created_at"))
    tg = _values(spark, [(i + 1, b, p, Decimal(a)) for i, (b, p, a) in enumerate(TARGETS)],
                 "id bigint, branch_name string, period_type string, target_amount decimal(12,2)")
    targets = tg.join(bid, "branch_name").select(
        "id", "branch_id", "period_type", F.date_trunc("week", d).cast("date").alias("period_start"),
        F.col("target_amount").cast(MONEY))
    empty = lambda name: spark.createDataFrame([], SCHEMAS[name])
    return {
        "branches": branches, "products": products, "customers": customers, "carcass_purchases": carcass,
        "breakdown_records": breakdown, "branch_transfers": transfers, "daily_stock": stock, "sales": sales,
        "payments": empty("payments"), "expenses": expenses, "profit_targets": targets,
        "closing_counts": empty("closing_counts"), "notifications": empty("notifications"),
        "users": spark.createDataFrame([(1, "admin", "admin", None), (2, "main", "attendant", 1)],
                                       "id bigint, username string, role string, branch_id bigint"),
    }
