"""Branch report, branch comparison and the dashboard's derived numbers."""

from __future__ import annotations

import datetime as dt
from collections.abc import Mapping

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyman.functions.prefix import with_position
from tallyman.operators.profit import branch_target_progress, daily_branch_profit
from tallyman.operators.stock import daily_stock_variance

Tables = Mapping[str, DataFrame]
VARIANCE_FLAG_PCT = 5   # the dashboard's two-sided flag
FULL_BAR_PCT = 100


VARIANCE_ITEM = ["product_name", "daily_stock_id", "opening_kg", "received_kg", "sold_kg", "closing_kg",
                 "variance_kg", "variance_pct"]


def _variance_items(var: DataFrame, fields: list[str] = VARIANCE_ITEM) -> DataFrame:
    """Per branch-day, the stock rows sorted by product name (then id)."""
    return var.groupBy("branch_id", F.col("stock_date").alias("report_date")).agg(
        F.array_sort(F.collect_list(F.struct(*fields))).alias("stock_variance"))


def _target_items(targets: DataFrame) -> DataFrame:
    return targets.groupBy("branch_id").agg(
        F.sort_array(F.collect_list(F.struct("period_start", "period_type", "profit_target_id", "period_end",
                                             "target_amount", "actual_profit", "pct_of_target")), asc=False)
        .alias("targets"))


def _dec_text(c):
    return F.coalesce(c.cast("string"), F.lit("null"))


def branch_report(t: Tables, date: dt.date | None = None, branch_id: int | None = None,
                  rendered: bool = False) -> DataFrame:
    """For every (branch, day) that has a profit or stock row (or just
    the given ones): the profit row (NULL if none), the stock variance rows
    ordered by product name, and the branch's targets, newest period first.

    Lists are bounded: one entry per product per day, one per target period
    per branch; each is built by one aggregate and joined to the (branch,
    day) spine. ``rendered`` flattens the profit row into columns and each
    list into a count and a text, computed before the join, so a branch's
    target text is built once, not once per day."""
    profit = daily_branch_profit(t)
    var = daily_stock_variance(t)
    targets = branch_target_progress(t, profit)
    if branch_id is not None:
        profit = profit.where(F.col("branch_id") == branch_id)
        var = var.where(F.col("branch_id") == branch_id)
        targets = targets.where(F.col("branch_id") == branch_id)
    if date is not None:
        profit = profit.where(F.col("report_date") == F.lit(date))
        var = var.where(F.col("stock_date") == F.lit(date))
    if branch_id is not None and date is not None:
        # a requested day is always answered, even without any fact
        spine = t["branches"].where(F.col("id") == branch_id).select(F.col("id").alias("branch_id"), F.lit(date).alias("report_date"))
    else:
        spine = None
    names = t["branches"].select(F.col("id").alias("branch_id"), F.col("name").alias("branch_name"))
    if rendered:
        var_lists = _variance_items(var, ["product_name", "daily_stock_id", "variance_kg", "variance_pct"])
        tgt_lists = _target_items(targets)
        var_lists = var_lists.select("branch_id", "report_date", F.size("stock_variance").alias("n_variance"),
                                     F.concat_ws("; ", F.transform("stock_variance", lambda x: F.concat(
                                         x["product_name"], F.lit("="), _dec_text(x["variance_kg"]), F.lit("/"),
                                         _dec_text(x["variance_pct"])))).alias("variance_items"))
        tgt_lists = tgt_lists.select("branch_id", F.size("targets").alias("n_targets"),
                                     F.concat_ws("; ", F.transform("targets", lambda x: F.concat(
                                         x["period_type"], F.lit("@"), x["period_start"].cast("string"), F.lit("="),
                                         _dec_text(x["pct_of_target"])))).alias("target_items"))
        prof = profit.select("branch_id", "report_date", "revenue", "discount_given", "expenses", "gross_profit")
        out = [F.coalesce("n_variance", F.lit(0)).alias("n_variance"),
               F.coalesce("variance_items", F.lit("")).alias("variance_items"),
               F.coalesce("n_targets", F.lit(0)).alias("n_targets"),
               F.coalesce("target_items", F.lit("")).alias("target_items")]
        head = ["branch_id", "branch_name", "report_date", "revenue", "discount_given", "expenses", "gross_profit"]
    else:
        var_lists, tgt_lists = _variance_items(var), _target_items(targets)
        prof = profit.select("branch_id", "report_date",
                             F.struct("revenue", "discount_given", "expenses", "gross_profit").alias("profit"))
        out = [F.coalesce("stock_variance", F.array()).alias("stock_variance"),
               F.coalesce("targets", F.array()).alias("targets")]
        head = ["branch_id", "branch_name", "report_date", "profit"]
    if spine is None:
        body = prof.join(var_lists, ["branch_id", "report_date"], "full_outer")  # the days that have either
    else:
        body = spine.join(prof, ["branch_id", "report_date"], "left").join(var_lists, ["branch_id", "report_date"], "left")
    return body.join(names, "branch_id").join(tgt_lists, "branch_id", "left").select(*head, *out)


def branch_comparison(t: Tables) -> DataFrame:
    """All target rows, newest period first, then highest percentage
    with NULL percentages first (the reference database's DESC order)."""
    r = branch_target_progress(t).select("branch_id", "branch_name", "period_type", "period_start",
                                         "target_amount", "actual_profit", "pct_of_target")
    return with_position(r, [F.col("period_start").desc(), F.col("pct_of_target").desc_nulls_first(), F.col("branch_id"),
                             F.col("period_type")]).orderBy("position")


def latest_target_comparison(t: Tables) -> DataFrame:
    """Per branch and period type only the most recent target period."""
    w = Window.partitionBy("branch_id", "period_type").orderBy(F.col("period_start").desc())
    return (branch_target_progress(t).withColumn("_rn", F.row_number().over(w))
            .where(F.col("_rn") == 1).drop("_rn"))


#: Slices of a branch-day's detail rows.
DAY_SLICES = 16


def _with_day_total(df: DataFrame, date_col: str, amount) -> DataFrame:
    """Detail rows plus the (branch, day) total. The total is summed map-side; it
    joins once per slice of the day, so the detail rows of a hot branch-day meet it
    in ``DAY_SLICES`` tasks instead of one."""
    d = df.withColumn("amount", amount)
    tot = d.groupBy("branch_id", date_col).agg(F.sum("amount").alias("day_total"))
    tot = tot.withColumn("_slice", F.explode(F.sequence(F.lit(0), F.lit(DAY_SLICES - 1))))
    d = d.withColumn("_slice", F.pmod(F.xxhash64("id"), F.lit(DAY_SLICES)).cast("int"))
    return d.join(tot, ["branch_id", date_col, "_slice"]).drop("_slice")


def sales_day_total(t: Tables) -> DataFrame:
    """Each sale's amount (weight * price) and its branch-day total."""
    s = t["sales"].select("id", "branch_id", "sale_date", "product_id", "weight_kg", "price_charged")
    return _with_day_total(s, "sale_date", F.col("weight_kg") * F.col("price_charged"))


def expense_day_total(t: Tables) -> DataFrame:
    """Each expense and its branch-day total."""
    e = t["expenses"].select("id", "branch_id", "expense_date", "description", "amount")
    return _with_day_total(e, "expense_date", F.col("amount"))


def target_progress_bar(t: Tables) -> DataFrame:
    """D3: bar width = min(pct, 100) with a missing pct drawn as 0; 'over'
    when pct ≥ 100."""
    pct = F.coalesce(F.col("pct_of_target"), F.lit(0))
    return branch_target_progress(t).select(
        "profit_target_id", "branch_id", "period_type", "period_start", "pct_of_target",
        F.least(pct, F.lit(FULL_BAR_PCT)).alias("bar_pct"), (pct >= FULL_BAR_PCT).alias("over_target"))


def variance_flags(t: Tables) -> DataFrame:
    """The dashboard flags a stock row when |pct| > 5 (loss or surplus;
    the alert of A1 is one-sided); a missing pct is not flagged."""
    v = daily_stock_variance(t)
    return v.select("daily_stock_id", "branch_id", "product_id", "stock_date", "variance_kg", "variance_pct",
                    (F.abs(F.coalesce(F.col("variance_pct"), F.lit(0))) > VARIANCE_FLAG_PCT).alias("flagged"))


def closing_sheet(t: Tables, date: dt.date | None = None, branch_id: int | None = None) -> DataFrame:
    """The night-count sheet of every (branch, day) that has stock rows, or of the
    given ones: every product, with its closing weight or blank (NULL) when the day
    has no row for it.

    Products get positions by id. The blanks of a day are the gaps between the
    positions it has, so they are generated from its own rows, and their products are
    found by an equi-join on the position; products are never joined with all days."""
    ds = t["daily_stock"]
    if branch_id is not None:
        ds = ds.where(F.col("branch_id") == branch_id)
    if date is not None:
        ds = ds.where(F.col("stock_date") == F.lit(date))
    products = with_position(t["products"].select(F.col("id").alias("product_id"), F.col("name").alias("product_name")), [F.col("product_id")])
    entered = (ds.select("branch_id", "product_id", "stock_date", "closing_kg").join(products, "product_id")
               .withColumn("entered", F.col("closing_kg").isNotNull()))
    days = ds.select("branch_id", "stock_date").distinct()
    end = t["products"].agg(F.count(F.lit(1)) + 1).scalar()  # one number: the position behind the last
    has = entered.select("branch_id", "stock_date", "position").unionByName(days.withColumn("position", F.lit(0).cast("bigint")))
    following = F.lead("position").over(Window.partitionBy("branch_id", "stock_date").orderBy("position"))
    gaps = has.select("branch_id", "stock_date", (F.col("position") + 1).alias("low"), (F.coalesce(following, end) - 1).alias("high"))
    blank = (gaps.where(F.col("low") <= F.col("high"))
             .select("branch_id", "stock_date", F.explode(F.sequence("low", "high")).alias("position")).join(products, "position")
             .select("branch_id", "product_id", "stock_date", F.lit(None).cast(ds.schema["closing_kg"].dataType).alias("closing_kg"),
                     "product_name", F.lit(False).alias("entered")))
    cols = ["branch_id", "stock_date", "product_id", "product_name", "closing_kg", "entered"]
    return entered.select(*cols).unionByName(blank.select(*cols))


def default_branch(t: Tables) -> DataFrame:
    """The branch the screens preselect: the main branch, else the first
    by name (top-1 is the feature)."""
    return t["branches"].orderBy(F.col("is_main").desc(), "name", "id").limit(1)


def default_price_fill(t: Tables) -> DataFrame:
    """A typed sale without a price gets the product's list price; a
    typed price, even 0, stays."""
    p = t["products"].select(F.col("id").alias("product_id"), "price_per_kg")
    s = t["sale_drafts"]
    return (s.join(p, "product_id", "left")
            .select("id", "branch_id", "product_id", "sale_date", "weight_kg",
                    F.coalesce(F.col("price_charged"), F.col("price_per_kg")).alias("price_charged"),
                    F.col("price_charged").isNull().alias("price_filled")))
