"""Declared schemas of the retail model tables.

Ids are BIGINT (SERIAL at scale overflows INT), money and weights keep their
declared DECIMAL precision, timestamps carry no zone (TIMESTAMP_NTZ).
"""

from __future__ import annotations

from pyspark.sql import types as T

ID = T.LongType()
KG = T.DecimalType(8, 2)
STOCK_KG = T.DecimalType(28, 2)  # weights summed over many rows
PRICE = T.DecimalType(10, 2)
MONEY = T.DecimalType(12, 2)
PCT = T.DecimalType(5, 2)
TS = T.TimestampNTZType()


def _f(name: str, dtype: T.DataType, nullable: bool = False) -> T.StructField:
    return T.StructField(name, dtype, nullable)


SCHEMAS: dict[str, T.StructType] = {
    "branches": T.StructType([
        _f("id", ID), _f("name", T.StringType()), _f("is_main", T.BooleanType()),
    ]),
    "products": T.StructType([
        _f("id", ID), _f("name", T.StringType()), _f("price_per_kg", PRICE),
        _f("is_byproduct", T.BooleanType()),
    ]),
    "customers": T.StructType([
        _f("id", ID), _f("name", T.StringType()), _f("customer_type", T.StringType()),
        _f("phone", T.StringType(), True), _f("balance_owed", MONEY), _f("credit_limit", MONEY),
    ]),
    "carcass_purchases": T.StructType([
        _f("id", ID), _f("branch_id", ID), _f("animal_type", T.StringType()),
        _f("invoice_weight_kg", KG), _f("received_weight_kg", KG), _f("cost", MONEY),
        _f("purchase_date", T.DateType()), _f("created_at", TS),
    ]),
    "breakdown_records": T.StructType([
        _f("id", ID), _f("carcass_purchase_id", ID), _f("product_id", ID),
        _f("output_weight_kg", KG), _f("expected_yield_pct", PCT), _f("created_at", TS),
    ]),
    "branch_transfers": T.StructType([
        _f("id", ID), _f("breakdown_record_id", ID), _f("to_branch_id", ID),
        _f("weight_sent_kg", KG), _f("transfer_date", T.DateType()), _f("created_at", TS),
    ]),
    "daily_stock": T.StructType([
        _f("id", ID), _f("branch_id", ID), _f("product_id", ID), _f("stock_date", T.DateType()),
        _f("opening_kg", STOCK_KG, True), _f("received_kg", STOCK_KG), _f("closing_kg", STOCK_KG), _f("created_at", TS, True),
    ]),
    "closing_counts": T.StructType([
        _f("id", ID), _f("branch_id", ID), _f("product_id", ID), _f("stock_date", T.DateType()),
        _f("closing_kg", STOCK_KG), _f("created_at", TS),
    ]),
    "sales": T.StructType([
        _f("id", ID), _f("branch_id", ID), _f("product_id", ID), _f("customer_id", ID, True),
        _f("sale_date", T.DateType()), _f("weight_kg", KG), _f("price_charged", PRICE),
        _f("payment_type", T.StringType()), _f("discount_reason", T.StringType(), True),
        _f("created_at", TS),
    ]),
    "payments": T.StructType([
        _f("id", ID), _f("customer_id", ID), _f("branch_id", ID), _f("payment_date", T.DateType()),
        _f("amount", MONEY), _f("created_at", TS),
    ]),
    "expenses": T.StructType([
        _f("id", ID), _f("branch_id", ID), _f("expense_date", T.DateType()),
        _f("description", T.StringType()), _f("amount", MONEY), _f("created_at", TS),
    ]),
    "profit_targets": T.StructType([
        _f("id", ID), _f("branch_id", ID), _f("period_type", T.StringType()),
        _f("period_start", T.DateType()), _f("target_amount", MONEY),
    ]),
    "notifications": T.StructType([
        _f("id", ID, True), _f("branch_id", ID, True), _f("customer_id", ID, True),
        _f("alert_type", T.StringType()),
        _f("message", T.StringType()), _f("severity", T.StringType()),
        _f("is_read", T.BooleanType()), _f("alert_date", T.DateType()), _f("created_at", TS, True),
    ]),
    "users": T.StructType([
        _f("id", ID), _f("username", T.StringType()), _f("role", T.StringType()),
        _f("branch_id", ID, True),
    ]),
}

MODEL_TABLES = tuple(SCHEMAS)

# Fixed domains from the reference schema's CHECK constraints.
ANIMAL_TYPES = ("beef", "mutton")
CUSTOMER_TYPES = ("individual", "school", "hotel")
PAYMENT_TYPES = ("cash", "credit")
DISCOUNT_REASONS = ("none", "regular_customer", "school_hotel", "weekly_promo_day")
PERIOD_TYPES = ("daily", "weekly", "monthly")
ALERT_TYPES = ("high_variance", "negative_profit", "high_credit_balance", "target_performance")
SEVERITIES = ("info", "warning", "critical")
USER_ROLES = ("admin", "attendant")
