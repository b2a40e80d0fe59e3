"""Branch revenue, expenses, profit and progress against targets.

Everything aggregates facts down to (branch, day) before any join, so the
joins only ever see one row per branch-day; hot branches are handled by the
map-side partial aggregation of ``groupBy``.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.functions.dates import period_days, period_end
from tallyman.functions.money import pct_of

Tables = Mapping[str, DataFrame]


def _branch_names(t: Tables) -> DataFrame:
    return t["branches"].select(F.col("id").alias("branch_id"), F.col("name").alias("branch_name"))


def daily_revenue(t: Tables) -> DataFrame:
    """Per (branch, sale day) revenue Σ weight*price_charged and the
    discount given Σ weight*(list − charged) over sales whose reason is not
    'none' (a NULL reason counts 0). Uses today's list price."""
    p = t["products"].select(F.col("id").alias("product_id"), "price_per_kg")
    s = t["sales"].select("branch_id", "product_id", "sale_date", "weight_kg", "price_charged",
                          "discount_reason")
    w, charged = F.col("weight_kg"), F.col("price_charged")
    disc = F.when(F.col("discount_reason") != "none", w * (F.col("price_per_kg") - charged)).otherwise(0)
    return (s.join(p, "product_id")
            .groupBy("branch_id", "sale_date")
            .agg(F.sum(w * charged).alias("revenue"), F.sum(disc).alias("discount_given")))


def daily_expenses(t: Tables) -> DataFrame:
    """Per (branch, expense day) Σ amount."""
    return (t["expenses"].groupBy("branch_id", F.col("expense_date").alias("sale_date"))
            .agg(F.sum("amount").alias("total_expenses")))


def _profit_columns(df: DataFrame, date_col: str) -> DataFrame:
    rev = F.coalesce(F.col("revenue"), F.lit(0))
    exp = F.coalesce(F.col("total_expenses"), F.lit(0))
    return df.select(
        "branch_id", "branch_name", F.col(date_col).alias("report_date"),
        rev.alias("revenue"),
        F.coalesce(F.col("discount_given"), F.lit(0)).alias("discount_given"),
        exp.alias("expenses"),
        (rev - exp).alias("gross_profit"),
    )


def daily_branch_profit(t: Tables) -> DataFrame:
    """R2: the reference view as written. Expenses attach only to a day that
    has revenue (``e.date = r.date``), so expense-only days vanish (Q1)."""
    j = (_branch_names(t).join(daily_revenue(t), "branch_id")
         .join(daily_expenses(t), ["branch_id", "sale_date"], "left"))
    return _profit_columns(j, "sale_date")


def daily_branch_profit_full(t: Tables) -> DataFrame:
    """R2x: the intended view: revenue and expense days full-outer joined,
    so expense-only days appear with revenue 0."""
    j = daily_revenue(t).join(daily_expenses(t), ["branch_id", "sale_date"], "full_outer")
    return _profit_columns(_branch_names(t).join(j, "branch_id"), "sale_date")


def branch_target_progress(t: Tables, profit: DataFrame | None = None) -> DataFrame:
    """Each target with the Σ gross profit of its branch over the period's
    days (inclusive). The range join is rewritten as an equi-join: a target
    expands to its ≤ 31 days, then joins the one-row-per-branch-day profit."""
    profit = daily_branch_profit(t) if profit is None else profit
    pt = t["profit_targets"].join(_branch_names(t), "branch_id")
    days = pt.select(F.col("id").alias("pt_id"), "branch_id",
                     F.explode(period_days("period_type", "period_start")).alias("report_date"))
    sums = (days.join(profit.select("branch_id", "report_date", "gross_profit"),
                      ["branch_id", "report_date"])
            .groupBy("pt_id").agg(F.sum("gross_profit").alias("actual")))
    actual = F.coalesce(F.col("actual").cast("decimal(24,4)"), F.lit(0).cast("decimal(24,4)"))
    return (pt.join(sums, pt.id == sums.pt_id, "left")
            .select(
                F.col("id").alias("profit_target_id"), "branch_id", "branch_name", "period_type",
                "period_start", period_end("period_type", "period_start").alias("period_end"),
                "target_amount", actual.alias("actual_profit"),
                pct_of(actual, "target_amount", 1).alias("pct_of_target")))
