"""Streaming jobs over parquet directories (file streams).

Every job reads its inputs with ``readStream`` and the declared schema and checkpoints
under the session's shared checkpoint folder unless told otherwise. What a micro-batch
writes is named by the stream (an id of its checkpoint) and the batch, so repeating a
batch after a failure rewrites the same files, and a stream that starts again with an
empty checkpoint never overwrites what an earlier one wrote.

ST1 ``start_credit_alerts`` / ``start_credit_balances``  balances and limit crossings
ST2 ``start_stock_ledger``      the stock ledger in arrival order
ST3 ``start_validated_ingest``  raw sales → accepted / quarantine
ST4 ``start_branch_totals``     running revenue, discount, expenses per branch-day
ST5 ``start_alert_regeneration``  re-check only the days a batch touched

State (ST1, ST2, ST4) is a ``KeyedSnapshot`` under the job's output folder.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyman.operators.alerts import profit_alerts, variance_alerts
from tallyman.operators.validate import validate_sales
from tallyman.session import checkpoint_dir
from tallyman.sources.schemas import SCHEMAS
from tallyman.sources.sinks import append_events, write_alert_run
from tallyman.sources.tables import MONTH, load_table, month_of
from tallyman.streaming.snapshots import KeyedSnapshot, stream_id
from tallyman.streaming.stateful import BALANCES, LEDGER, changed_days, credit_events, crossing_alerts, stock_events

RAW_SALES_DDL = ("id bigint, branch_id bigint, product_id bigint, customer_id bigint, sale_date date, "
                 "weight_kg decimal(8,2), price_charged decimal(10,2), payment_type string, "
                 "discount_reason string, created_at timestamp_ntz")


def read_stream(spark: SparkSession, path: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def _ckpt(spark: SparkSession, name: str, given: str | None) -> str:
    return given or f"{checkpoint_dir(spark).rstrip('/')}/streams/{name}"


def once_each(events: DataFrame, keys: list[str], arrived: str, delay: str) -> DataFrame:
    """Events without redelivered ones: of equal ``keys`` that arrive within ``delay`` of each
    other the first counts. Events older than the watermark are redelivered ones, too, as
    ``arrived`` is the time of arrival."""
    timed = events.withColumn("_arrived", F.col(arrived).cast("timestamp")).withWatermark("_arrived", delay)
    return timed.dropDuplicatesWithinWatermark(keys).drop("_arrived")


def _start(events: DataFrame, write, checkpoint: str) -> StreamingQuery:
    return events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _snapshot(spark: SparkSession, out: str, stream: str, schema: str, bucket_by: list[str], buckets: int) -> KeyedSnapshot:
    return KeyedSnapshot(spark, f"{out.rstrip('/')}/state/stream={stream}", schema, bucket_by, buckets)


def latest_state(spark: SparkSession, out: str, schema: str, bucket_by: list[str], checkpoint: str) -> DataFrame:
    """What the job with this checkpoint keeps as state."""
    return _snapshot(spark, out, stream_id(spark, checkpoint), schema, bucket_by, BUCKETS).current()


#: Buckets of a job's state: a batch rewrites those it touches, each by one or more tasks.
BUCKETS = 32


def start_credit_alerts(spark: SparkSession, sales_path: str, payments_path: str, customers: DataFrame,
                        out: str, checkpoint: str | None = None, max_files: int | None = None, redelivered: str | None = None) -> StreamingQuery:
    """ST1 runner: crossing alerts appended under ``out/alerts``, balances in ``out/state``.
    ``redelivered`` (a duration) drops events that are delivered again within it."""
    ck = _ckpt(spark, "credit_alerts", checkpoint)
    stream = stream_id(spark, ck)
    balances = _snapshot(spark, out, stream, BALANCES, ["customer_id"], BUCKETS)
    events = credit_events(read_stream(spark, sales_path, SCHEMAS["sales"], max_files), read_stream(spark, payments_path, SCHEMAS["payments"], max_files))
    if redelivered:
        events = once_each(events, ["kind", "event_id"], "created_at", redelivered)

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()  # the alerts, the buckets they touch and the new balances read it
        try:
            def grown(before: DataFrame) -> DataFrame:
                alerts = crossing_alerts(held, before, customers)
                alerts.write.mode("overwrite").parquet(f"{out.rstrip('/')}/alerts/stream={stream}/batch={batch_id:012d}")
                deltas = held.select("customer_id", F.col("cents").cast("decimal(28,0)").alias("cents"))
                return before.unionByName(deltas).groupBy("customer_id").agg(F.sum("cents").alias("cents"))

            balances.update(batch_id, held, grown)
        finally:
            held.unpersist()
    return _start(events, write, ck)


def start_credit_balances(spark: SparkSession, sales_path: str, payments_path: str, out: str, checkpoint: str | None = None,
                          max_files: int | None = None) -> StreamingQuery:
    """ST1 balances: the balance of every customer with activity. A batch's changes are
    summed on the map side, so a bulk account is one row a task; read them with
    ``latest_state(spark, out, BALANCES, ["customer_id"], checkpoint)``."""
    ck = _ckpt(spark, "credit_balances", checkpoint)
    balances = _snapshot(spark, out, stream_id(spark, ck), BALANCES, ["customer_id"], BUCKETS)
    events = credit_events(read_stream(spark, sales_path, SCHEMAS["sales"], max_files), read_stream(spark, payments_path, SCHEMAS["payments"], max_files))

    def write(batch: DataFrame, batch_id: int) -> None:
        balances.add(batch_id, batch.groupBy("customer_id").agg(F.sum(F.col("cents").cast("decimal(28,0)")).alias("cents")), ["customer_id"], ["cents"])
    return _start(events, write, ck)


def start_stock_ledger(spark: SparkSession, transfers_path: str, counts_path: str, breakdown_records: DataFrame,
                       out: str, checkpoint: str | None = None, max_files: int | None = None) -> StreamingQuery:
    """ST2 runner: the days each batch changes under ``out/changes``, the ledger in ``out/state``
    (``latest_state(spark, out, LEDGER, ["branch_id", "product_id"], checkpoint)``)."""
    ck = _ckpt(spark, "stock_ledger", checkpoint)
    stream = stream_id(spark, ck)
    ledger = _snapshot(spark, out, stream, LEDGER, ["branch_id", "product_id"], BUCKETS)
    events = stock_events(read_stream(spark, transfers_path, SCHEMAS["branch_transfers"], max_files),
                          read_stream(spark, counts_path, SCHEMAS["closing_counts"], max_files), breakdown_records)
    key = ["branch_id", "product_id", "stock_date"]

    def write(batch: DataFrame, batch_id: int) -> None:
        held = batch.persist()
        try:
            def merged(before: DataFrame) -> DataFrame:
                path = f"{out.rstrip('/')}/changes/stream={stream}/batch={batch_id:012d}"
                changed_days(held, before).write.mode("overwrite").parquet(path)
                changed = spark.read.schema(before.schema).parquet(path)
                return before.join(changed, key, "left_anti").unionByName(changed.select(*before.columns))

            ledger.update(batch_id, held, merged)
        finally:
            held.unpersist()
    return _start(events, write, ck)


def start_validated_ingest(spark: SparkSession, raw_sales_path: str, dims: Mapping[str, DataFrame], root: str,
                           quarantine_root: str, checkpoint: str | None = None,
                           max_files: int | None = None) -> StreamingQuery:
    """ST3: validate each micro-batch of raw sales (V1, stream-static key
    checks) and write accepted rows to ``root/sales`` and rejected rows to
    ``quarantine_root/sales``, both keyed by stream and batch for idempotent retries.
    A stream that starts again with an empty checkpoint reads all files again and adds
    what it reads; it deletes nothing."""
    ck = _ckpt(spark, "validated_ingest", checkpoint)
    stream = stream_id(spark, ck)
    raw = read_stream(spark, raw_sales_path, RAW_SALES_DDL, max_files)
    validated = validate_sales({**dims, "raw_sales": raw})

    def write(df: DataFrame, batch_id: int) -> None:
        held = df.persist()  # two writes, one validation
        try:
            append_events(held, "sales", root, quarantine_root, batch_id=f"{stream}-{batch_id:012d}")
        finally:
            held.unpersist()
    return _start(validated, write, ck)


def branch_day_amounts(sales: DataFrame, expenses: DataFrame, products: DataFrame) -> DataFrame:
    """Per-row contributions to (branch, day) revenue, discount and expenses."""
    p = products.select(F.col("id").alias("product_id"), "price_per_kg")
    w, ch = F.col("weight_kg"), F.col("price_charged")
    s = sales.join(p, "product_id").select(
        "branch_id", F.col("sale_date").alias("report_date"), (w * ch).cast("decimal(20,4)").alias("revenue"),
        F.when(F.col("discount_reason") != "none", w * (F.col("price_per_kg") - ch)).otherwise(0)
        .cast("decimal(20,4)").alias("discount_given"),
        F.lit(0).cast("decimal(20,4)").alias("expenses"))
    e = expenses.select("branch_id", F.col("expense_date").alias("report_date"),
                        F.lit(0).cast("decimal(20,4)").alias("revenue"),
                        F.lit(0).cast("decimal(20,4)").alias("discount_given"),
                        F.col("amount").cast("decimal(20,4)").alias("expenses"))
    return s.unionByName(e)


TOTALS = "branch_id bigint, report_date date, revenue decimal(38,4), discount_given decimal(38,4), expenses decimal(38,4)"


def start_branch_totals(spark: SparkSession, sales_path: str, expenses_path: str, products: DataFrame, out: str,
                        checkpoint: str | None = None, max_files: int | None = None) -> StreamingQuery:
    """ST4: running totals per (branch, day); no watermark on the business date, so a late
    row still counts. Read them with ``branch_totals(spark, out, checkpoint)``."""
    ck = _ckpt(spark, "branch_totals", checkpoint)
    totals = _snapshot(spark, out, stream_id(spark, ck), TOTALS, ["branch_id", "report_date"], BUCKETS)
    amounts = branch_day_amounts(read_stream(spark, sales_path, SCHEMAS["sales"], max_files), read_stream(spark, expenses_path, SCHEMAS["expenses"], max_files), products)
    keys, sums = ["branch_id", "report_date"], ["revenue", "discount_given", "expenses"]

    def write(batch: DataFrame, batch_id: int) -> None:
        totals.add(batch_id, batch.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums]), keys, sums)
    return _start(amounts, write, ck)


def branch_totals(spark: SparkSession, out: str, checkpoint: str) -> DataFrame:
    t = latest_state(spark, out, TOTALS, ["branch_id", "report_date"], checkpoint)
    return t.withColumn("gross_profit", F.col("revenue") - F.col("expenses"))


def regenerate_for_days(spark: SparkSession, root: str, alerts_root: str, days: DataFrame, run: str) -> None:
    """Re-run the variance and loss checks for the given days (one column
    ``alert_date``) over the stored tables, as run ``run`` of the stored alerts.
    Both checks of a day read only that day's rows, so the fact tables are
    semi-joined with the days first: on date-partitioned tables that is a
    partition-pruned scan, not a full one."""
    d = days.select("alert_date").distinct()
    months = d.select(month_of(F.col("alert_date")).alias(MONTH)).distinct()
    t = {n: load_table(spark, root, n, months) for n in ("branches", "products", "sales", "expenses", "daily_stock")}
    only = {name: t[name].join(d.withColumnRenamed("alert_date", col), col, "left_semi")
            for name, col in (("sales", "sale_date"), ("expenses", "expense_date"), ("daily_stock", "stock_date"))}
    t = {**t, **only}
    fresh = variance_alerts(t).unionByName(profit_alerts(t))
    scope = (d.select(F.lit("high_variance").alias("alert_type"), "alert_date")
             .unionByName(d.select(F.lit("negative_profit").alias("alert_type"), "alert_date")))
    write_alert_run(fresh, scope, alerts_root, run)


def start_alert_regeneration(spark: SparkSession, changes_path: str, date_col: str, root: str, alerts_root: str,
                             schema, checkpoint: str | None = None, max_files: int | None = None) -> StreamingQuery:
    """ST5: for each micro-batch of changed rows (already stored under
    ``root``), regenerate the alerts of the days it touched only."""
    ck = _ckpt(spark, "alert_regeneration", checkpoint)
    stream = stream_id(spark, ck)
    changes = read_stream(spark, changes_path, schema, max_files)

    def run(df: DataFrame, batch_id: int) -> None:
        regenerate_for_days(spark, root, alerts_root, df.select(F.col(date_col).alias("alert_date")), run=f"{stream}-{batch_id:012d}")
    return _start(changes, run, ck)
