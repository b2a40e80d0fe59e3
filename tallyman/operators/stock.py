"""Daily stock: variance view and the stock ledger built from events.

Windows here are partitioned by (branch, product) only: a daily_stock key is
unique per day, so one partition holds at most one row per calendar day no
matter how large the data grows.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyman.functions.asof import earlier_in_both
from tallyman.functions.money import pct_of
from tallyman.functions.prefix import running_last
from tallyman.session import written

Tables = Mapping[str, DataFrame]
KEY = ["branch_id", "product_id", "stock_date"]


def sold_per_stock_day(t: Tables) -> DataFrame:
    """Σ sales weight per (branch, product, day), aggregated before any join."""
    return (t["sales"].groupBy("branch_id", "product_id", F.col("sale_date").alias("stock_date"))
            .agg(F.sum("weight_kg").alias("sold")))


def daily_stock_variance(t: Tables) -> DataFrame:
    """Every daily_stock row with its sold weight and the unexplained
    variance ``opening + received − sold − closing`` (positive = loss), as kg
    and as a percentage of what was available (NULL when nothing was).
    Sales without a stock row never appear."""
    sold_days = sold_per_stock_day(t)  # asks for sales first: the stand-in stock rows reuse stored ones
    ds = t["daily_stock"]
    b = t["branches"].select(F.col("id").alias("branch_id"), F.col("name").alias("branch_name"))
    p = t["products"].select(F.col("id").alias("product_id"), F.col("name").alias("product_name"))
    sold = F.coalesce(F.col("sold"), F.lit(0))
    avail = F.col("opening_kg") + F.col("received_kg")
    variance = avail - sold - F.col("closing_kg")
    return (ds.join(b, "branch_id").join(p, "product_id")
            .join(sold_days, KEY, "left")
            .select(
                F.col("id").alias("daily_stock_id"), "branch_id", "product_id",
                "branch_name", "product_name", "stock_date", "opening_kg", "received_kg",
                sold.alias("sold_kg"), "closing_kg",
                variance.alias("variance_kg"),
                pct_of(variance, avail, 2).alias("variance_pct")))


# --- stock ledger ------------------------------------------------------------
LEDGER_COLS = ["branch_id", "product_id", "stock_date", "opening_kg", "received_kg", "closing_kg"]


def _previous_closing():
    w = Window.partitionBy("branch_id", "product_id").orderBy("stock_date")
    return F.lag("closing_kg").over(w)


def opening_stock_fill(t: Tables, table: str = "daily_stock_unfilled") -> DataFrame:
    """A row that came in with a NULL opening takes the closing of the
    latest earlier day of the same (branch, product), gaps allowed, else 0;
    a given opening stays. Days are unique per key, so the latest earlier
    row is the previous row of the (branch, product) window."""
    ds = t[table]
    filled = F.coalesce(F.col("opening_kg"), _previous_closing(), F.lit(0)).cast("decimal(28,2)")
    return ds.select("id", "branch_id", "product_id", "stock_date",
                     filled.alias("opening_kg"), "received_kg", "closing_kg",
                     F.col("opening_kg").isNull().alias("opening_filled"))


def transfers_per_stock_day(t: Tables) -> DataFrame:
    """Σ weight sent per (receiving branch, product, transfer day); the
    product comes from the transfer's breakdown record."""
    br = t["breakdown_records"].select(F.col("id").alias("breakdown_record_id"), "product_id")
    tr = t["branch_transfers"].select("breakdown_record_id", F.col("to_branch_id").alias("branch_id"),
                                      F.col("transfer_date").alias("stock_date"), "weight_sent_kg")
    return (tr.join(br, "breakdown_record_id")
            .groupBy(*KEY).agg(F.sum("weight_sent_kg").alias("received_in")))


def last_counts(t: Tables) -> DataFrame:
    """Last write wins: the latest night count per stock day."""
    return (t["closing_counts"].groupBy(*KEY)
            .agg(F.max_by("closing_kg", F.struct("created_at", "id")).alias("counted")))


def _merge_into_stock(existing: DataFrame, incoming: DataFrame, received, closing) -> DataFrame:
    """Full-outer merge of daily_stock with per-key increments (an upsert on
    the unique key). Existing rows keep their opening; created rows take the
    previous day's closing of the merged table (T1), else 0."""
    j = existing.select(*LEDGER_COLS, F.lit(True).alias("_old")).join(incoming, KEY, "full_outer")
    rows = j.select(*KEY, "opening_kg", received.cast("decimal(28,2)").alias("received_kg"),
                    closing.cast("decimal(28,2)").alias("closing_kg"), F.col("_old").isNull().alias("created"))
    opening = F.when(F.col("created"), F.coalesce(_previous_closing(), F.lit(0))).otherwise(F.col("opening_kg"))
    return rows.select(*KEY, opening.cast("decimal(28,2)").alias("opening_kg"), "received_kg", "closing_kg",
                       "created")


def transfers_to_stock(t: Tables) -> DataFrame:
    """Apply every transfer to daily_stock: an existing (branch, product,
    day) row gets ``received += weight``; a missing one is created with the
    weight as received, closing 0 and the opening of T1."""
    zero = F.lit(0)
    received = F.coalesce(F.col("received_kg"), zero) + F.coalesce(F.col("received_in"), zero)
    return _merge_into_stock(t["daily_stock"], transfers_per_stock_day(t), received,
                             F.coalesce(F.col("closing_kg"), zero))


def closing_count_upsert(t: Tables) -> DataFrame:
    """Apply the night counts to daily_stock: the last count sets
    closing_kg of an existing row; a missing row is created with received 0
    and the opening of T1. Opening and received of existing rows stay."""
    return _merge_into_stock(t["daily_stock"], last_counts(t), F.coalesce(F.col("received_kg"), F.lit(0)),
                             F.coalesce(F.col("counted"), F.col("closing_kg")))


def stock_ledger_build(t: Tables) -> DataFrame:
    """T4 (settled): the whole daily_stock from events alone: received =
    Σ transfers, closing = last count (0 if none), opening = previous
    day's final closing (0 for the first day)."""
    j = transfers_per_stock_day(t).join(last_counts(t), KEY, "full_outer")
    closing = F.coalesce(F.col("counted"), F.lit(0)).cast("decimal(28,2)")
    rows = j.select(*KEY, F.coalesce(F.col("received_in"), F.lit(0)).cast("decimal(28,2)").alias("received_kg"),
                    closing.alias("closing_kg"))
    return rows.select(*KEY, F.coalesce(_previous_closing(), F.lit(0)).cast("decimal(28,2)").alias("opening_kg"),
                       "received_kg", "closing_kg")


def transfers_in(t: Tables) -> DataFrame:
    """Transfers with the product they move (from their breakdown record)."""
    br = t["breakdown_records"].select(F.col("id").alias("breakdown_record_id"), "product_id")
    return t["branch_transfers"].join(br, "breakdown_record_id").select(
        F.col("to_branch_id").alias("branch_id"), "product_id", F.col("transfer_date").alias("stock_date"), "created_at", "id", "weight_sent_kg")


def replayed_days(transfers: DataFrame, counts: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """The stock days that these events, in arrival order (time, transfers before counts, id),
    create or change in a ledger: ``branch_id, product_id, stock_date, opening_kg,
    received_kg, closing_kg, created_at``. ``existing`` holds the days of earlier events.

    A day is created by its first event. Its opening is the closing, as known at that
    moment, of the latest earlier day that already existed, else 0, and is never revised.
    So it takes a lookup in two orders (an earlier business day, and created earlier:
    ``earlier_in_both``) and then the last count of that day that arrived before
    (``running_last``); both split hot keys and hot days over tasks."""
    seq = lambda kind: F.struct(F.col("created_at").alias("ts"), F.lit(kind).alias("kind"), F.col("id").alias("event_id"))
    moved = transfers.groupBy(*KEY).agg(F.min(seq(0)).alias("moved"), F.sum("weight_sent_kg").alias("received_in"))
    counted = counts.groupBy(*KEY).agg(F.min(seq(1)).alias("counted"), F.max_by("closing_kg", seq(1)).alias("last_count"))
    days = moved.join(counted, KEY, "full_outer").withColumn("born", F.least("moved", "counted"))  # least skips NULLs
    pair = ["branch_id", "product_id"]
    if existing is not None:
        old = existing.select(*KEY, "opening_kg", "received_kg", "closing_kg", "created_at")
        days = days.join(old, KEY, "left")
        fresh = days.where(F.col("created_at").isNull()).select(*KEY, "born")
    else:
        days = days.withColumns({c: F.lit(None).cast("decimal(28,2)") for c in ("opening_kg", "received_kg", "closing_kg")}).withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
        fresh = days.select(*KEY, "born")

    epoch = F.lit("1970-01-01").cast("date")
    fresh = earlier_in_both(fresh.withColumn("_day", F.datediff("stock_date", epoch)), pair, "_day", "born", "_prev")
    fresh = fresh.select(*KEY, "born", F.date_add(epoch, F.col("_prev").cast("int")).alias("prev"))
    known = F.lit(None).cast("decimal(28,2)")
    if existing is not None:
        # days of earlier events all exist before: the latest one by date (a row a day of the key)
        marks = fresh.select(*KEY, "born", "prev", F.lit(None).cast("date").alias("seen"), known.alias("closed")).unionByName(
            old.join(fresh.select(*pair).distinct(), pair, "left_semi").select(*KEY, F.lit(None).cast(fresh.schema["born"].dataType).alias("born"), F.lit(None).cast("date").alias("prev"),
                                                               F.col("stock_date").alias("seen"), F.col("closing_kg").alias("closed")))
        so_far = Window.partitionBy(*pair).orderBy("stock_date").rowsBetween(Window.unboundedPreceding, -1)
        marks = marks.withColumn("_old", F.last(F.when(F.col("seen").isNotNull(), F.struct("seen", "closed")), ignorenulls=True).over(so_far)).where(F.col("born").isNotNull())
        from_old = F.col("_old").isNotNull() & (F.col("prev").isNull() | (F.col("_old.seen") > F.col("prev")))
        fresh = marks.select(*KEY, "born", F.when(from_old, F.col("_old.seen")).otherwise(F.col("prev")).alias("prev"), F.when(from_old, F.col("_old.closed")).alias("closed"))
    else:
        fresh = fresh.withColumn("closed", known)

    # the last count of the day before, as known when the day was created
    fresh = written(fresh, "asof-days")  # sliced, joined and read again
    probes = fresh.where(F.col("prev").isNotNull()).select(*pair, F.col("prev").alias("stock_date"), F.col("born").alias("seq"), F.lit(0).alias("is_count"),
                                                         known.alias("value"), F.col("stock_date").alias("of_day"))
    facts = counts.select(*KEY, seq(1).alias("seq"), F.lit(1).alias("is_count"), F.col("closing_kg").cast("decimal(28,2)").alias("value"), F.lit(None).cast("date").alias("of_day"))
    facts = facts.join(probes.select(*KEY).distinct(), KEY, "left_semi")
    seen = running_last(probes.unionByName(facts), KEY, [F.col("seq"), F.col("is_count"), F.col("of_day")], "value", "known")
    seen = seen.where(F.col("is_count") == 0).select(*pair, F.col("of_day").alias("stock_date"), "known")
    fresh = fresh.join(seen, KEY, "left").select(*KEY, F.coalesce("known", "closed", F.lit(0)).alias("first_opening"))

    zero, kg = F.lit(0), "decimal(28,2)"
    return days.join(fresh, KEY, "left").select(
        *KEY, F.coalesce("opening_kg", "first_opening").cast(kg).alias("opening_kg"),
        (F.coalesce("received_kg", zero) + F.coalesce("received_in", zero)).cast(kg).alias("received_kg"),
        F.coalesce("last_count", "closing_kg", zero).cast(kg).alias("closing_kg"), F.coalesce("created_at", F.col("born.ts")).alias("created_at"))


def stock_ledger_replay(t: Tables) -> DataFrame:
    """T5 (arrival order): daily_stock as the triggers leave it when events arrive one by
    one: the opening is a snapshot taken when the row is created, so a previous day's
    count that arrives later does not reach it."""
    return replayed_days(transfers_in(t), t["closing_counts"])
