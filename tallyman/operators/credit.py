"""Customer credit: charges, payments, balances, statements, limit alerts.

A credit sale with a customer raises the customer's balance, every payment
lowers it (it may go below zero). The balance column has two decimals, so
each charge is rounded to cents before it is added (the plain statement
keeps the exact product). Ordering:

* arrival order (what the balance triggers saw): created_at, charges before
  payments, id;
* statement order: business date, charges before payments, created_at, id.

Running balances use the two-level running total of
``tallyman.functions.prefix`` bucketed by day, so a very large customer is
spread over one task per day instead of one task overall.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.functions.money import text
from tallyman.functions.prefix import running_total

Tables = Mapping[str, DataFrame]
CHARGE, PAYMENT = 0, 1
BALANCE_TEXT = "decimal(38,2)"


def credit_charges(t: Tables) -> DataFrame:
    """Credit sales that name a customer; amount = weight * price.
    Cash sales count for nothing even when they name a customer."""
    s = t["sales"].where((F.col("payment_type") == "credit") & F.col("customer_id").isNotNull())
    return s.select(
        F.col("id").alias("sale_id"), "customer_id", "branch_id", "product_id", "sale_date",
        "weight_kg", "price_charged", (F.col("weight_kg") * F.col("price_charged")).alias("amount"),
        "created_at")


def payment_credits(t: Tables) -> DataFrame:
    """Every payment, as a negative change of the balance."""
    return t["payments"].select(
        F.col("id").alias("payment_id"), "customer_id", "branch_id", "payment_date",
        (-F.col("amount")).alias("amount"), "created_at")


def balance_events(t: Tables) -> DataFrame:
    """Charges (rounded to cents) and payments as one stream of balance
    changes: (customer_id, kind, event_id, event_date, created_at, delta)."""
    c = credit_charges(t).select(
        "customer_id", F.lit(CHARGE).alias("kind"), F.col("sale_id").alias("event_id"),
        F.col("sale_date").alias("event_date"), "created_at",
        F.round("amount", 2).cast("decimal(20,2)").alias("delta"))
    p = payment_credits(t).select(
        "customer_id", F.lit(PAYMENT).alias("kind"), F.col("payment_id").alias("event_id"),
        F.col("payment_date").alias("event_date"), "created_at",
        F.col("amount").cast("decimal(20,2)").alias("delta"))
    return c.unionByName(p)


def customer_balances(t: Tables) -> DataFrame:
    """Balance per customer = Σ charges − Σ payments; 0 without activity."""
    sums = balance_events(t).groupBy("customer_id").agg(F.sum("delta").alias("total"))
    cu = t["customers"].select(F.col("id").alias("customer_id"), "name", "customer_type", "credit_limit")
    return (cu.join(sums, "customer_id", "left")
            .select("customer_id", "name", "customer_type", "credit_limit",
                    F.coalesce(F.col("total"), F.lit(0)).cast("decimal(38,2)").alias("balance_owed")))


def balance_history(t: Tables) -> DataFrame:
    """Every balance change in arrival order with the balance before and
    after it, and the customer's name and limit."""
    ev = running_total(balance_events(t), ["customer_id"], [F.col("created_at"), F.col("kind"), F.col("event_id")],
                       "delta", "balance_after")
    cu = t["customers"].select(F.col("id").alias("customer_id"), "name", "credit_limit")
    return (ev.join(cu, "customer_id")
            .withColumn("balance_before", F.col("balance_after") - F.col("delta")))


def _credit_alert(df: DataFrame, message) -> DataFrame:
    return df.select(
        F.lit(None).cast("bigint").alias("branch_id"), "customer_id",
        F.lit("high_credit_balance").alias("alert_type"), message.alias("message"),
        F.lit("warning").alias("severity"), F.lit(False).alias("is_read"),
        F.to_date("created_at").alias("alert_date"),
        F.col("kind").alias("event_kind"), "event_id", "balance_after")


def credit_limit_crossings(t: Tables) -> DataFrame:
    """Alert when a change takes the balance from ≤ limit to > limit
    (an upward crossing, in arrival order); later changes while still over
    the limit do not alert again."""
    h = balance_history(t)
    crossed = h.where((F.col("balance_before") <= F.col("credit_limit"))
                      & (F.col("balance_after") > F.col("credit_limit")))
    msg = F.concat(F.col("name"), F.lit(" crossed their credit limit of "), text("credit_limit"),
                   F.lit(", now owes "), text(F.col("balance_after").cast(BALANCE_TEXT)))
    return _credit_alert(crossed, msg)


def credit_over_limit_updates(t: Tables) -> DataFrame:
    """C6 (first version of the alert): one alert for every change after
    which the balance is above the limit, payments included."""
    h = balance_history(t)
    over = h.where(F.col("balance_after") > F.col("credit_limit"))
    msg = F.concat(F.col("name"), F.lit(" owes "), text(F.col("balance_after").cast(BALANCE_TEXT)),
                   F.lit(", above their limit of "), text("credit_limit"))
    return _credit_alert(over, msg)


def customer_statement(t: Tables) -> DataFrame:
    """C4: every customer's ledger of credit charges and payments, ordered by
    date with charges before payments on the same date (then created_at, id),
    with a running balance from 0. Charges read
    ``"{product} — {weight}kg @ {price} ({branch})"``; payments read
    ``"Payment received"`` with a negative amount. Amounts are exact."""
    b = t["branches"].select(F.col("id").alias("branch_id"), F.col("name").alias("branch_name"))
    p = t["products"].select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    charges = (credit_charges(t).join(b, "branch_id").join(p, "product_id")
               .select("customer_id", F.lit("charge").alias("entry_type"), F.lit(CHARGE).alias("kind"),
                       F.col("sale_id").alias("entry_id"), F.col("sale_date").alias("entry_date"),
                       "created_at",
                       F.concat(F.col("product_name"), F.lit(" — "), text("weight_kg"), F.lit("kg @ "),
                                text("price_charged"), F.lit(" ("), F.col("branch_name"), F.lit(")"))
                       .alias("description"),
                       F.col("amount").cast("decimal(22,4)").alias("amount")))
    pays = payment_credits(t).select(
        "customer_id", F.lit("payment").alias("entry_type"), F.lit(PAYMENT).alias("kind"),
        F.col("payment_id").alias("entry_id"), F.col("payment_date").alias("entry_date"), "created_at",
        F.lit("Payment received").alias("description"), F.col("amount").cast("decimal(22,4)").alias("amount"))
    known = t["customers"].select(F.col("id").alias("customer_id"))
    ledger = charges.unionByName(pays).join(known, "customer_id", "left_semi")
    out = running_total(ledger, ["customer_id"],
                        [F.col("entry_date"), F.col("kind"), F.col("created_at"), F.col("entry_id")], "amount", "running_balance")
    return out.select("customer_id", "entry_type", "entry_id", "entry_date", "created_at", "description",
                      "amount", "running_balance")
