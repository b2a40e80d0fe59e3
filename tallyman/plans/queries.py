"""Registered queries: name → operator applied to the stand-in tables.

Each entry takes the lazy table mapping and returns the operator's result
DataFrame; ``spark_queries()`` wraps them as ``(spark, sf_dir) → DataFrame``
with the final comparison casts.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from tallyman.operators import alerts, credit, listings, profit, reports, scope, stock, validate, yields
from tallyman.plans import stream_queries, write_queries
from tallyman.plans.finalize import finalize
from tallyman.sources.fixtures import fixture_tables

Tables = Mapping[str, DataFrame]
#: The day the registered alert checks are run for (their oracles name the same day).
RUN_DATE = dt.date(2001, 8, 1)
REGISTRY: dict[str, Callable[[Tables], DataFrame]] = {}


def register(name: str):
    def deco(fn: Callable[[Tables], DataFrame]):
        REGISTRY[name] = fn
        return fn
    return deco


# 2.4 report views ---------------------------------------------------------
register("daily_stock_variance")(stock.daily_stock_variance)
register("daily_revenue")(profit.daily_revenue)
register("daily_expenses")(profit.daily_expenses)
register("daily_branch_profit")(profit.daily_branch_profit)
register("daily_branch_profit_full")(profit.daily_branch_profit_full)
register("branch_target_progress")(profit.branch_target_progress)

# 2.5 stock ledger -----------------------------------------------------------
register("opening_stock_fill")(stock.opening_stock_fill)
register("transfers_to_stock")(stock.transfers_to_stock)
register("closing_count_upsert")(stock.closing_count_upsert)
register("stock_ledger_build")(stock.stock_ledger_build)
register("stock_ledger_replay")(stock.stock_ledger_replay)

# 2.6 customer credit --------------------------------------------------------
register("credit_charges")(credit.credit_charges)
register("payment_credits")(credit.payment_credits)
register("customer_balances")(credit.customer_balances)
register("customer_statement")(credit.customer_statement)
register("credit_limit_crossings")(credit.credit_limit_crossings)
register("credit_over_limit_updates")(credit.credit_over_limit_updates)

# 2.7 alerts -------------------------------------------------------------------
register("variance_alerts")(alerts.variance_alerts)
register("profit_alerts")(alerts.profit_alerts)
register("target_alerts")(lambda t: alerts.target_alerts(t, RUN_DATE))
register("alert_feed")(lambda t: alerts.alert_feed(t, RUN_DATE))
register("regenerate_alerts")(lambda t: alerts.regenerate_alerts(t, RUN_DATE))
register("mark_read")(alerts.mark_read)
register("mark_read_not_found")(alerts.mark_read_not_found)

# 2.8 yield and allocation -----------------------------------------------------
register("breakdown_yield")(yields.breakdown_yield)
register("breakdown_loss")(yields.breakdown_loss)
register("allocation_matrix")(yields.allocation_matrix)
register("allocation_requests")(yields.allocation_requests)
register("breakdown_item_requests")(yields.breakdown_item_requests)
register("breakdown_form_rejects")(yields.breakdown_form_rejects)

# 2.1 sources ----------------------------------------------------------------------
register("load_tables")(write_queries.load_tables)
register("append_events")(write_queries.append_events)
register("replace_alerts")(write_queries.replace_alerts)

# 2.2 ingest validation ----------------------------------------------------------
register("validate_sales")(validate.validate_sales)
register("validate_closing_counts")(validate.validate_closing_counts)
register("validate_carcass_purchases")(validate.validate_carcass_purchases)
register("validate_breakdown_batches")(validate.validate_breakdown_batches)
register("validate_branch_transfers")(validate.validate_branch_transfers)
register("validate_payments")(validate.validate_payments)
register("validate_expenses")(validate.validate_expenses)
register("validate_customers")(validate.validate_customers)
register("constraint_report")(validate.constraint_report)

# 2.3 listings -------------------------------------------------------------------
register("list_branches")(listings.list_branches)
register("list_products")(listings.list_products)
register("list_daily_stock")(listings.list_daily_stock)
register("list_sales")(listings.list_sales)
register("list_carcass_purchases")(listings.list_carcass_purchases)
register("list_breakdown_records")(listings.list_breakdown_records)
register("list_branch_transfers")(listings.list_branch_transfers)
register("list_payments")(listings.list_payments)
register("list_expenses")(listings.list_expenses)
register("list_customers")(listings.list_customers)
register("list_notifications")(listings.list_notifications)

# 2.4 reports (R4–R6) ------------------------------------------------------------
register("branch_report")(lambda t: reports.branch_report(t, rendered=True))
register("branch_comparison")(reports.branch_comparison)
register("latest_target_comparison")(reports.latest_target_comparison)

# 2.9 dashboard ------------------------------------------------------------------
register("sales_day_total")(reports.sales_day_total)
register("expense_day_total")(reports.expense_day_total)
register("target_progress_bar")(reports.target_progress_bar)
register("variance_flags")(reports.variance_flags)
register("closing_sheet")(reports.closing_sheet)
register("default_branch")(reports.default_branch)
register("default_price_fill")(reports.default_price_fill)

# 2.10 row scope -----------------------------------------------------------------
register("branch_scope")(scope.branch_scope)

# 2.11 streaming forms (run once over stored inputs) ------------------------------
register("stream_credit_alerts")(stream_queries.stream_credit_alerts)
register("stream_redelivered_alerts")(stream_queries.stream_redelivered_alerts)
register("stream_stock_ledger")(stream_queries.stream_stock_ledger)
register("stream_validated_ingest")(stream_queries.stream_validated_ingest)
register("stream_branch_totals")(stream_queries.stream_branch_totals)
register("stream_credit_balances")(stream_queries.stream_credit_balances)
register("stream_alert_regeneration")(stream_queries.stream_alert_regeneration)


def spark_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(fn):
        return lambda spark, sf_dir: finalize(fn(fixture_tables(spark, sf_dir)))
    return {name: bind(fn) for name, fn in REGISTRY.items()}
