"""Ingest validation: every raw row comes out once, with ``reject_reason``
NULL when accepted or the name of the first rule it breaks.

The rules are the API's checks followed by the database's (NOT NULL,
CHECK, foreign keys), in that order; defaults the API applies (customer
NULL, discount reason 'none', customer type 'individual', credit limit
3000) are applied before the database checks, as the insert would.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyman.functions.rules import falsy, falsy_text, first_failure, with_key_check
from tallyman.session import written
from tallyman.sources.schemas import (
    ALERT_TYPES, ANIMAL_TYPES, CUSTOMER_TYPES, DISCOUNT_REASONS, PAYMENT_TYPES, SCHEMAS, SEVERITIES, USER_ROLES,
)

Tables = Mapping[str, DataFrame]
DEFAULT_CREDIT_LIMIT = 3000  # fixed by the reference


def validate_sales(t: Tables) -> DataFrame:
    """V1: sales as posted."""
    r = t["raw_sales"]
    c = F.col
    cust = F.when(falsy(c("customer_id")), F.lit(None)).otherwise(c("customer_id")).cast("bigint")
    reason = F.when(falsy_text(c("discount_reason")), F.lit("none")).otherwise(c("discount_reason"))
    r = r.withColumn("customer_id", cust).withColumn("_reason", reason)
    r = with_key_check(r, t["branches"], "branch_id", "_no_branch")
    r = with_key_check(r, t["products"], "product_id", "_no_product")
    r = with_key_check(r, t["customers"], "customer_id", "_no_customer")
    rules = [
        ("missing_required", falsy(c("branch_id")) | falsy(c("product_id")) | c("sale_date").isNull()
         | falsy(c("weight_kg")) | c("price_charged").isNull() | falsy_text(c("payment_type"))),
        ("bad_payment_type", ~c("payment_type").isin(*PAYMENT_TYPES)),
        ("credit_needs_customer", (c("payment_type") == "credit") & c("customer_id").isNull()),
        ("bad_weight_or_price", (c("weight_kg") <= 0) | (c("price_charged") < 0)),
        ("bad_discount_reason", ~c("_reason").isin(*DISCOUNT_REASONS)),
        ("unknown_branch", c("_no_branch")),
        ("unknown_product", c("_no_product")),
        ("unknown_customer", c("_no_customer")),
    ]
    return r.select("id", "branch_id", "product_id", "customer_id", "sale_date", "weight_kg", "price_charged",
                    "payment_type", c("_reason").alias("discount_reason"),
                    first_failure(rules).alias("reject_reason"))


def validate_closing_counts(t: Tables) -> DataFrame:
    """V2: night counts as posted (closing as typed text). A JSON null passes
    the API's number test and then fails NOT NULL."""
    r = t["raw_closing_counts"]
    c = F.col
    num = F.expr("try_cast(trim(closing_kg) AS decimal(8,2))")
    r = r.withColumn("_closing", num)
    r = with_key_check(r, t["branches"], "branch_id", "_no_branch")
    r = with_key_check(r, t["products"], "product_id", "_no_product")
    rules = [
        ("missing_required", falsy(c("branch_id")) | falsy(c("product_id")) | c("stock_date").isNull()),
        ("bad_closing", c("closing_kg").isNotNull() & (c("_closing").isNull() | (c("_closing") < 0))),
        ("closing_null", c("closing_kg").isNull()),
        ("unknown_branch", c("_no_branch")),
        ("unknown_product", c("_no_product")),
    ]
    return r.select("id", "branch_id", "product_id", "stock_date", c("_closing").alias("closing_kg"),
                    first_failure(rules).alias("reject_reason"))


def validate_carcass_purchases(t: Tables) -> DataFrame:
    """V3: carcass purchases as posted; cost 0 is fine, weights must be > 0."""
    r = with_key_check(t["raw_carcass_purchases"], t["branches"], "branch_id", "_no_branch")
    c = F.col
    rules = [
        ("missing_required", falsy(c("branch_id")) | falsy_text(c("animal_type")) | falsy(c("invoice_weight_kg"))
         | falsy(c("received_weight_kg")) | c("cost").isNull() | c("purchase_date").isNull()),
        ("bad_animal_type", ~c("animal_type").isin(*ANIMAL_TYPES)),
        ("bad_weight_or_cost", (c("invoice_weight_kg") <= 0) | (c("received_weight_kg") <= 0) | (c("cost") < 0)),
        ("unknown_branch", c("_no_branch")),
    ]
    return r.select("id", "branch_id", "animal_type", "invoice_weight_kg", "received_weight_kg", "cost",
                    "purchase_date", first_failure(rules).alias("reject_reason"))


def _late_posts(pairs: DataFrame) -> DataFrame:
    """``post_id`` of posts that come after an accepted one with a pair (carcass, product) of
    theirs. Posts are decided in rounds: one that is the first undecided post of each of
    its pairs is accepted, and rejects those that share a pair with it. Every round accepts
    a post of each carcass that has undecided ones, so rounds are at most as many as a
    carcass has products; a round is joins and aggregates over the undecided pairs, and a
    carcass with very many posts splits over tasks like any other rows."""
    pair = ["carcass_purchase_id", "product_id"]
    shared = pairs.groupBy(*pair).agg(F.count(F.lit(1)).alias("posts")).where(F.col("posts") > 1)
    undecided, late = written(pairs.join(shared.select(*pair), pair, "left_semi"), "posts"), None
    while not undecided.isEmpty():
        first = undecided.groupBy(*pair).agg(F.min("post_id").alias("first"))
        accepted = undecided.join(first, pair).groupBy("post_id").agg(F.min(F.col("first") == F.col("post_id")).alias("ok")).where("ok").select("post_id")
        decided = written(undecided.join(accepted.withColumn("ok", F.lit(True)), "post_id", "left"), "posts-decided")
        rest = decided.where(F.col("ok").isNull()).select("post_id", *pair)
        lost = written(rest.join(decided.where("ok").select(*pair), pair, "left_semi").select("post_id").distinct(), "posts-late")
        late = lost if late is None else late.unionByName(lost)
        undecided = written(rest.join(lost, "post_id", "left_anti"), "posts")
    return undecided.select("post_id") if late is None else late


def validate_breakdown_batches(t: Tables) -> DataFrame:
    """V4: posts of a carcass's breakdown items, each saved all or nothing: one bad item
    rejects every item of its post. A post's reason is the post check, else the first
    item (by position) failing the API checks, else the first failing the database's
    (with pairs the table already holds, and repeats inside the post), else a pair that
    an earlier accepted post of the same carcass took. Posts are decided in ``post_id``
    order; a rejected post takes no pairs. Every post gives at least one row."""
    c = F.col
    b = t["raw_breakdown_batches"]
    items = b.select("post_id", "carcass_purchase_id", F.size(F.coalesce(c("items"), F.array())).alias("_n"),
                     F.posexplode_outer("items").alias("pos", "item"))
    items = items.select("post_id", "carcass_purchase_id", "_n", "pos", c("item.product_id").alias("product_id"),
                         c("item.output_weight_kg").alias("output_weight_kg"),
                         c("item.expected_yield_pct").alias("expected_yield_pct"))
    items = with_key_check(items, t["products"], "product_id", "_no_product")
    items = with_key_check(items, t["carcass_purchases"], "carcass_purchase_id", "_no_carcass")
    stored = t["stored_breakdown_pairs"].select("carcass_purchase_id", "product_id").distinct()
    items = items.join(stored.withColumn("_stored", F.lit(True)), ["carcass_purchase_id", "product_id"], "left")
    repeat = F.row_number().over(Window.partitionBy("post_id", "product_id").orderBy("pos")) > 1  # a post's items
    items = items.withColumn("_dup", c("product_id").isNotNull() & (F.coalesce(c("_stored"), F.lit(False)) | repeat))
    post_rule = first_failure([("missing_required", falsy(c("carcass_purchase_id")) | (c("_n") == 0))])
    api_rule = first_failure([
        ("bad_item", falsy(c("product_id")) | c("output_weight_kg").isNull() | c("expected_yield_pct").isNull()),
        ("negative_output", c("output_weight_kg") < 0),
    ])
    db_rule = first_failure([
        ("negative_expected", c("expected_yield_pct") < 0),
        ("unknown_carcass", c("_no_carcass")),
        ("unknown_product", c("_no_product")),
        ("duplicate_product", c("_dup")),
    ])
    checked = items.withColumn("_post", post_rule).withColumn("_api", api_rule).withColumn("_db", db_rule)
    per_post = checked.groupBy("post_id", "carcass_purchase_id").agg(
        F.first("_post", ignorenulls=True).alias("_post"),
        F.min_by("_api", F.when(c("_api").isNotNull(), c("pos"))).alias("_api"),
        F.min_by("_db", F.when(c("_db").isNotNull(), c("pos"))).alias("_db"))
    per_post = per_post.select("post_id", "carcass_purchase_id", F.coalesce("_post", "_api", "_db").alias("_alone"))

    good = items.join(per_post.where(c("_alone").isNull()).select("post_id"), "post_id", "left_semi")
    late = _late_posts(good.select("post_id", "carcass_purchase_id", "product_id").distinct())
    per_post = per_post.join(late.withColumn("_late", F.lit("duplicate_product")), "post_id", "left")
    reasons = per_post.select("post_id", F.coalesce("_alone", "_late").alias("reject_reason"))
    return (items.join(reasons, "post_id")
            .select("post_id", "carcass_purchase_id", "pos", "product_id", "output_weight_kg", "expected_yield_pct", "reject_reason"))


def validate_branch_transfers(t: Tables) -> DataFrame:
    """V5: transfers as posted; the API wants weight > 0 (the table allows 0)."""
    c = F.col
    r = t["raw_branch_transfers"]
    r = with_key_check(r, t["breakdown_records"], "breakdown_record_id", "_no_record")
    r = with_key_check(r, t["branches"], "to_branch_id", "_no_branch")
    rules = [
        ("missing_required", falsy(c("breakdown_record_id")) | falsy(c("to_branch_id")) | falsy(c("weight_sent_kg"))
         | c("transfer_date").isNull()),
        ("bad_weight", c("weight_sent_kg") <= 0),
        ("unknown_breakdown_record", c("_no_record")),
        ("unknown_branch", c("_no_branch")),
    ]
    return r.select("id", "breakdown_record_id", "to_branch_id", "weight_sent_kg", "transfer_date",
                    first_failure(rules).alias("reject_reason"))


def validate_payments(t: Tables) -> DataFrame:
    """V6: payments as posted; the amount must be > 0."""
    c = F.col
    r = t["raw_payments"]
    r = with_key_check(r, t["customers"], "customer_id", "_no_customer")
    r = with_key_check(r, t["branches"], "branch_id", "_no_branch")
    rules = [
        ("missing_required", falsy(c("customer_id")) | falsy(c("branch_id")) | c("payment_date").isNull()
         | falsy(c("amount"))),
        ("bad_amount", c("amount") <= 0),
        ("unknown_customer", c("_no_customer")),
        ("unknown_branch", c("_no_branch")),
    ]
    return r.select("id", "customer_id", "branch_id", "payment_date", "amount",
                    first_failure(rules).alias("reject_reason"))


def validate_expenses(t: Tables) -> DataFrame:
    """V7: expenses as posted; amount 0 is fine, the description may not be empty."""
    c = F.col
    r = with_key_check(t["raw_expenses"], t["branches"], "branch_id", "_no_branch")
    rules = [
        ("missing_required", falsy(c("branch_id")) | c("expense_date").isNull() | falsy_text(c("description"))
         | c("amount").isNull()),
        ("bad_amount", c("amount") < 0),
        ("unknown_branch", c("_no_branch")),
    ]
    return r.select("id", "branch_id", "expense_date", "description", "amount",
                    first_failure(rules).alias("reject_reason"))


def validate_customers(t: Tables) -> DataFrame:
    """V8: customers as entered: the name is trimmed and required; the type
    defaults to 'individual'; a limit of 0 or none becomes 3000."""
    c = F.col
    r = t["raw_customers"]
    name = F.trim(c("name"))
    ctype = F.when(falsy_text(c("customer_type")), F.lit("individual")).otherwise(c("customer_type"))
    limit = F.coalesce(F.when(c("credit_limit") != 0, c("credit_limit")), F.lit(DEFAULT_CREDIT_LIMIT))
    rules = [
        ("missing_name", falsy_text(name)),
        ("bad_customer_type", ~ctype.isin(*CUSTOMER_TYPES)),
    ]
    return r.select("id", name.alias("name"), ctype.alias("customer_type"),
                    F.when(falsy_text(c("phone")), F.lit(None)).otherwise(c("phone")).alias("phone"),
                    limit.cast("decimal(12,2)").alias("credit_limit"),
                    first_failure(rules).alias("reject_reason"))


#: The tables of the reference's schema (night counts are a separate source).
STORED_TABLES = tuple(n for n in SCHEMAS if n != "closing_counts")


# --- V9: constraint audit of stored tables ----------------------------------------
def _unique(*keys: str) -> tuple[str, Column, Column | None]:
    """Rule: no two rows share ``keys`` (rows without a key share the missing one). The parts
    of a longer key carry their lengths, so different keys never give the same text."""
    parts = [F.col(k).cast("string") for k in keys]
    joined = F.concat(*[F.coalesce(F.concat(F.length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])
    return "unique(" + ", ".join(keys) + ")", F.lit(True), parts[0] if len(parts) == 1 else joined


def _check(rule: str, cond: Column) -> tuple[str, Column, Column | None]:
    """Rule: ``cond`` holds for every row (a NULL result passes, as in SQL)."""
    return rule, F.coalesce(~cond, F.lit(False)), None


def _references(col: str, dim: str) -> tuple[str, Column, Column | None]:
    """Rule: a non-NULL ``col`` names a row of ``dim``."""
    return f"{col} -> {dim}", F.col(col).isNotNull(), F.col(col).cast("string")


def _rules() -> dict[str, list[tuple[str, Column, Column | None]]]:
    """Table → its rules as (name, rows that the rule concerns, key of such a row)."""
    c = F.col
    role = c("role")
    rules = {
        "branches": [_unique("name")],
        "products": [_unique("name"), _check("price_per_kg >= 0", c("price_per_kg") >= 0)],
        "customers": [_check("customer_type in domain", c("customer_type").isin(*CUSTOMER_TYPES))],
        "carcass_purchases": [
            _check("animal_type in domain", c("animal_type").isin(*ANIMAL_TYPES)),
            _check("invoice_weight_kg > 0", c("invoice_weight_kg") > 0),
            _check("received_weight_kg > 0", c("received_weight_kg") > 0),
            _check("cost >= 0", c("cost") >= 0),
            _references("branch_id", "branches")],
        "breakdown_records": [
            _unique("carcass_purchase_id", "product_id"),
            _check("output_weight_kg >= 0", c("output_weight_kg") >= 0),
            _check("expected_yield_pct >= 0", c("expected_yield_pct") >= 0),
            _references("carcass_purchase_id", "carcass_purchases"),
            _references("product_id", "products")],
        "branch_transfers": [
            _check("weight_sent_kg >= 0", c("weight_sent_kg") >= 0),
            _references("breakdown_record_id", "breakdown_records"),
            _references("to_branch_id", "branches")],
        "daily_stock": [
            _unique("branch_id", "product_id", "stock_date"),
            _references("branch_id", "branches"),
            _references("product_id", "products")],
        "sales": [
            _check("weight_kg > 0", c("weight_kg") > 0),
            _check("price_charged >= 0", c("price_charged") >= 0),
            _check("payment_type in domain", c("payment_type").isin(*PAYMENT_TYPES)),
            _check("discount_reason in domain", c("discount_reason").isin(*DISCOUNT_REASONS)),
            _references("branch_id", "branches"),
            _references("product_id", "products"),
            _references("customer_id", "customers")],
        "payments": [
            _check("amount > 0", c("amount") > 0),
            _references("customer_id", "customers"),
            _references("branch_id", "branches")],
        "expenses": [_check("amount >= 0", c("amount") >= 0), _references("branch_id", "branches")],
        "profit_targets": [
            _unique("branch_id", "period_type", "period_start"),
            _check("period_type in domain", c("period_type").isin("daily", "weekly", "monthly")),
            _check("target_amount >= 0", c("target_amount") >= 0),
            _references("branch_id", "branches")],
        "notifications": [
            _check("alert_type in domain", c("alert_type").isin(*ALERT_TYPES)),
            _check("severity in domain", c("severity").isin(*SEVERITIES)),
            _references("branch_id", "branches"),
            _references("customer_id", "customers")],
        "users": [
            _unique("username"),
            _check("role in domain", role.isin(*USER_ROLES)),
            _check("admin has no branch, attendant has one",
                   ((role == "admin") & c("branch_id").isNull()) | ((role == "attendant") & c("branch_id").isNotNull())),
            _references("branch_id", "branches")],
    }
    for table in STORED_TABLES:
        required = [f.name for f in SCHEMAS[table].fields if not f.nullable]
        rules.setdefault(table, []).extend(_check(f"{name} not null", c(name).isNotNull()) for name in required)
        if "id" in required:
            rules[table].append(_unique("id"))
    return rules


_MAIN = "at most one main branch"


def constraint_report(t: Tables) -> DataFrame:
    """V9: for every stored table, the rows breaking each of the schema's
    rules: unique keys, CHECKs, foreign keys, at most one main branch, and
    admin ⇔ no branch for users. One row per (table, rule), 0 when clean.

    Each table is scanned once: a row gives one narrow row (rule, key) for each rule that
    concerns it, and one for each foreign key that may name it. One aggregate over (rule,
    key) counts them, combined in each task before the shuffle, so that a key of a third of
    all rows arrives as one row a task; what a group says of its rule is then summed."""
    rules = _rules()
    names = [(table, rule) for table, own in rules.items() for rule, _, _ in own] + [("branches", _MAIN)]
    number = {name: i for i, name in enumerate(names)}
    named_by: dict[str, list[int]] = {}
    for (_, rule), i in number.items():
        if " -> " in rule:
            named_by.setdefault(rule.rsplit(" -> ", 1)[1], []).append(i)
    rows = None
    for table, own in rules.items():
        told = [F.when(concerned, F.struct(F.lit(number[table, rule]).alias("rule"), (F.lit(None) if key is None else key).cast("string").alias("key"), F.lit(False).alias("named")))
                for rule, concerned, key in own]
        told += [F.struct(F.lit(i).alias("rule"), F.col("id").cast("string").alias("key"), F.lit(True).alias("named")) for i in named_by.get(table, ())]
        if table == "branches":
            told.append(F.when(F.col("is_main"), F.struct(F.lit(number["branches", _MAIN]).alias("rule"), F.lit(None).cast("string").alias("key"), F.lit(False).alias("named"))))
        # rules that don't concern a row go after the explode, which is compiled; array_compact isn't
        part = t[table].select(F.explode(F.array(*told)).alias("r")).where(F.col("r").isNotNull()).select("r.*")
        rows = part if rows is None else rows.unionByName(part)
    groups = rows.groupBy("rule", "key").agg(F.count(F.when(~F.col("named"), 1)).alias("n"), F.max("named").alias("named"))
    single = [i for (_, rule), i in number.items() if rule == _MAIN or rule.startswith("unique(")]
    n, rule = F.col("n"), F.col("rule")
    bad = (F.when(rule.isin(single), F.when(n > 1, n))
           .when(rule.isin([i for own in named_by.values() for i in own]), F.when(~F.col("named"), n)).otherwise(n))
    found = groups.select("rule", F.coalesce(bad, F.lit(0)).alias("n")).groupBy("rule").agg(F.sum("n").alias("bad_rows"))
    listed = rows.sparkSession.createDataFrame([(i, *name) for name, i in number.items()], "rule int, table_name string, name string")
    return (listed.join(found, "rule", "left")
            .select("table_name", F.col("name").alias("rule"), F.coalesce("bad_rows", F.lit(0)).cast("bigint").alias("bad_rows")))
