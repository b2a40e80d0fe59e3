"""ST1 and ST2: the reference's row triggers over micro-batches.

Events are taken in arrival order (created_at, kind, id); a micro-batch holds events
that arrived after those of the batches before. Each batch is an ordinary Spark job over
its events and the state before it, which is a keyed table (``KeyedSnapshot``):

* ST1: a running sum of the batch (``running_total``: slices of events are summed apart,
  so a customer with a third of all events splits over tasks) plus the balance before
  the batch gives the balance before and after each event, hence the crossings;
* ST2: the batch replay of the stock ledger (T5, ``replayed_days``) with the days of
  earlier batches as existing ones.

No watermark bounds the state: back-dated rows are always accepted, as in the reference.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyman.functions.prefix import running_total
from tallyman.operators.stock import replayed_days

CHARGE, PAYMENT = 0, 1
TRANSFER, COUNT = 0, 1


# --- ST1: credit balance and limit crossing --------------------------------------
BALANCES = "customer_id bigint, cents decimal(28,0)"


def credit_events(sales: DataFrame, payments: DataFrame) -> DataFrame:
    """Balance changes in cents: credit sales naming a customer (weight *
    price rounded to cents) and payments (negative)."""
    c = sales.where((F.col("payment_type") == "credit") & F.col("customer_id").isNotNull()).select(
        "customer_id", F.lit(CHARGE).alias("kind"), F.col("id").alias("event_id"), "created_at",
        (F.round(F.col("weight_kg") * F.col("price_charged"), 2) * 100).cast("bigint").alias("cents"))
    p = payments.select("customer_id", F.lit(PAYMENT).alias("kind"), F.col("id").alias("event_id"), "created_at",
                        (-F.col("amount") * 100).cast("bigint").alias("cents"))
    return c.unionByName(p)


def crossing_alerts(events: DataFrame, before: DataFrame, customers: DataFrame) -> DataFrame:
    """ST1: the limit-crossing alerts of a batch's events, given each customer's balance
    (``customer_id, cents``) before the batch."""
    cu = customers.select(F.col("id").alias("customer_id"), "name", "credit_limit")
    known = events.join(cu.select("customer_id"), "customer_id", "left_semi").withColumn("cents", F.col("cents").cast("decimal(28,0)"))
    sums = running_total(known, ["customer_id"], [F.col("created_at"), F.col("kind"), F.col("event_id")], "cents", "sum")
    sums = sums.join(before.withColumnRenamed("cents", "entry"), "customer_id", "left").join(cu, "customer_id")
    money = lambda c: (c / 100).cast("decimal(28,2)")
    after = F.coalesce("entry", F.lit(0)) + F.col("sum")
    sums = sums.withColumn("balance_after", money(after)).withColumn("balance_before", money(after - F.col("cents")))
    crossed = sums.where((F.col("balance_before") <= F.col("credit_limit")) & (F.col("balance_after") > F.col("credit_limit")))
    message = F.concat(F.col("name"), F.lit(" crossed their credit limit of "), F.col("credit_limit").cast("string"), F.lit(", now owes "), F.col("balance_after").cast("string"))
    return crossed.select(
        F.lit(None).cast("bigint").alias("branch_id"), "customer_id", F.lit("high_credit_balance").alias("alert_type"), message.alias("message"),
        F.lit("warning").alias("severity"), F.lit(False).alias("is_read"), F.to_date("created_at").alias("alert_date"),
        F.col("kind").alias("event_kind"), "event_id", F.col("balance_after").cast("decimal(38,2)").alias("balance_after"))


# --- ST2: stock ledger per (branch, product) ------------------------------------------
LEDGER = ("branch_id bigint, product_id bigint, stock_date date, opening_kg decimal(28,2), "
          "received_kg decimal(28,2), closing_kg decimal(28,2), created_at timestamp_ntz")


def stock_events(transfers: DataFrame, counts: DataFrame, breakdown_records: DataFrame) -> DataFrame:
    """Transfers (product from their breakdown record, a static table) and
    night counts as one event stream."""
    br = breakdown_records.select(F.col("id").alias("breakdown_record_id"), "product_id")
    tr = transfers.join(br, "breakdown_record_id").select(
        F.col("to_branch_id").alias("branch_id"), "product_id", F.col("transfer_date").alias("stock_date"),
        "created_at", F.lit(TRANSFER).alias("kind"), "id", F.col("weight_sent_kg").cast("decimal(28,2)").alias("kg"))
    ct = counts.select("branch_id", "product_id", "stock_date", "created_at", F.lit(COUNT).alias("kind"), "id", F.col("closing_kg").cast("decimal(28,2)").alias("kg"))
    return tr.unionByName(ct)


def changed_days(events: DataFrame, existing: DataFrame) -> DataFrame:
    """ST2: the stock days that a batch's events create or change, as they are after it."""
    moved = events.where(F.col("kind") == TRANSFER).withColumnRenamed("kg", "weight_sent_kg")
    counted = events.where(F.col("kind") == COUNT).withColumnRenamed("kg", "closing_kg")
    return replayed_days(moved, counted, existing)
