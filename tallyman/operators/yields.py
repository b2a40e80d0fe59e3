"""Carcass yield and allocation (the breakdown screen's arithmetic).

The screen computes in JavaScript numbers, so the percentages here are
DOUBLE, like the screen; weights and sums stay DECIMAL.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Tables = Mapping[str, DataFrame]
YIELD_TOLERANCE_PCT = 3  # fixed by the reference screen


def breakdown_yield(t: Tables) -> DataFrame:
    """Actual yield % = output / received * 100 (0 when received is 0);
    flagged when output ≠ 0 and |actual − expected| > 3 points (unrounded)."""
    cp = t["carcass_purchases"].select(F.col("id").alias("carcass_purchase_id"), "received_weight_kg")
    p = t["products"].select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    br = t["breakdown_records"].join(cp, "carcass_purchase_id").join(p, "product_id")
    rec = F.col("received_weight_kg").cast("double")
    actual = F.when(rec != 0, F.col("output_weight_kg").cast("double") / rec * 100).otherwise(F.lit(0.0))
    flagged = ((F.col("output_weight_kg") != 0)
               & (F.abs(actual - F.col("expected_yield_pct").cast("double")) > YIELD_TOLERANCE_PCT))
    return br.select(F.col("id").alias("breakdown_record_id"), "carcass_purchase_id", "product_id", "product_name",
                     "output_weight_kg", "expected_yield_pct", actual.alias("actual_pct"),
                     flagged.alias("flagged"))


def breakdown_loss(t: Tables) -> DataFrame:
    """Y2: per carcass, received vs Σ output: loss = received − Σ output (may
    be negative) and loss % of received (NULL when received is 0)."""
    out = t["breakdown_records"].groupBy("carcass_purchase_id").agg(F.sum("output_weight_kg").alias("total_output"))
    cp = t["carcass_purchases"].select(F.col("id").alias("carcass_purchase_id"), "received_weight_kg")
    j = cp.join(out, "carcass_purchase_id", "left")
    total = F.coalesce(F.col("total_output"), F.lit(0)).cast("decimal(18,2)")
    loss = F.col("received_weight_kg") - total
    rec = F.col("received_weight_kg").cast("double")
    return j.select("carcass_purchase_id", "received_weight_kg", total.alias("total_output_kg"),
                    loss.alias("loss_kg"),
                    F.when(rec > 0, loss.cast("double") / rec * 100).alias("loss_pct"))


def allocation_matrix(t: Tables) -> DataFrame:
    """Y3 (long form): per breakdown record and receiving branch Σ sent, with
    the record's output and total sent; records with nothing sent get one
    row with no branch. Over-allocation is not blocked, only visible."""
    sent = (t["branch_transfers"].groupBy("breakdown_record_id", "to_branch_id")
            .agg(F.sum("weight_sent_kg").alias("sent_kg")))
    totals = sent.groupBy("breakdown_record_id").agg(F.sum("sent_kg").alias("total_sent_kg"))
    br = t["breakdown_records"].select(F.col("id").alias("breakdown_record_id"), "product_id", "output_weight_kg")
    return (br.join(sent, "breakdown_record_id", "left").join(totals, "breakdown_record_id", "left")
            .select("breakdown_record_id", "product_id", "output_weight_kg", "to_branch_id",
                    "sent_kg", F.coalesce(F.col("total_sent_kg"), F.lit(0)).alias("total_sent_kg"),
                    (F.coalesce(F.col("total_sent_kg"), F.lit(0)) > F.col("output_weight_kg"))
                    .alias("over_allocated")))


def allocation_matrix_wide(t: Tables, branch_ids: list[int]) -> DataFrame:
    """Y3 as the screen shows it: one column per branch (ids given, so the
    pivot needs no extra pass over the data) plus the total."""
    long = allocation_matrix(t).where(F.col("to_branch_id").isNotNull())
    wide = (long.groupBy("breakdown_record_id").pivot("to_branch_id", branch_ids).agg(F.sum("sent_kg")))
    br = t["breakdown_records"].select(F.col("id").alias("breakdown_record_id"), "product_id", "output_weight_kg")
    tot = long.groupBy("breakdown_record_id").agg(F.sum("sent_kg").alias("total_sent_kg"))
    return br.join(wide, "breakdown_record_id", "left").join(tot, "breakdown_record_id", "left")


def allocation_requests(t: Tables) -> DataFrame:
    """The allocation form {record: {branch: weight}} flattened to one
    transfer request per cell whose weight is a number > 0, dated on the
    carcass's purchase day."""
    f = t["allocation_forms"]
    cp = t["carcass_purchases"].select(F.col("id").alias("carcass_purchase_id"), "purchase_date")
    rows = f.select("carcass_purchase_id", F.explode("allocations").alias("breakdown_record_id", "cells"))
    cells = rows.select("carcass_purchase_id", "breakdown_record_id",
                        F.explode("cells").alias("to_branch_id", "_v"))
    weight = F.expr("try_cast(trim(_v) AS decimal(8,2))")
    return (cells.withColumn("weight_sent_kg", weight).where(F.col("weight_sent_kg") > 0)
            .join(cp, "carcass_purchase_id")
            .select("carcass_purchase_id", "breakdown_record_id", "to_branch_id", "weight_sent_kg",
                    F.col("purchase_date").alias("transfer_date")))


def breakdown_item_requests(t: Tables) -> DataFrame:
    """The breakdown form {product: {output, expected}} turned into
    items: only rows with a non-empty output; a blank or non-numeric
    expected % becomes 0. A form with no items is refused, see
    ``breakdown_form_rejects``."""
    rows = t["breakdown_forms"].select("carcass_purchase_id", F.explode("rows").alias("product_id", "r"))
    out_txt = F.col("r.output_weight_kg")
    exp_num = F.expr("try_cast(trim(r.expected_yield_pct) AS decimal(5,2))")
    return (rows.where(out_txt.isNotNull() & (out_txt != ""))
            .select("carcass_purchase_id", "product_id",
                    F.expr("try_cast(trim(r.output_weight_kg) AS decimal(8,2))").alias("output_weight_kg"),
                    F.coalesce(exp_num, F.lit(0).cast("decimal(5,2)")).alias("expected_yield_pct")))


def breakdown_form_rejects(t: Tables) -> DataFrame:
    """Forms without a single item ('Enter at least one product output')."""
    items = breakdown_item_requests(t).select("carcass_purchase_id").distinct()
    return (t["breakdown_forms"].select("carcass_purchase_id").join(items, "carcass_purchase_id", "left_anti")
            .withColumn("reject_reason", F.lit("no_items")))
