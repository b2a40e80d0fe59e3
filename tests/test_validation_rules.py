"""Rule-by-rule checks of the validators on hand-made rows (seed dimensions)."""

import datetime as dt
from decimal import Decimal as D

from pyspark.sql import functions as F

from tallyman.operators import validate
from tallyman.streaming.jobs import RAW_SALES_DDL

DAY = dt.date(2026, 7, 14)
TS = dt.datetime(2026, 7, 14, 9)


def reasons(df):
    return {r["id"]: r["reject_reason"] for r in df.collect()}


def test_sales_rules_in_order(spark, seed):
    rows = [
        (1, 1, 1, None, DAY, D("2.00"), D("650.00"), "cash", None, TS),            # clean, reason → none
        (2, 1, 1, None, DAY, D("0.00"), D("650.00"), "cash", "none", TS),          # !weight → missing
        (3, 1, 1, None, DAY, D("2.00"), D("0.00"), "cash", "none", TS),            # price 0 is fine
        (4, 1, 1, None, DAY, D("2.00"), None, "cash", "none", TS),                 # no price → missing
        (5, 1, 1, None, DAY, D("2.00"), D("650.00"), "card", "none", TS),          # bad payment type
        (6, 1, 1, 0, DAY, D("2.00"), D("650.00"), "credit", "none", TS),           # customer 0 is falsy
        (7, 1, 1, None, DAY, D("2.00"), D("-1.00"), "cash", "none", TS),           # negative price
        (8, 1, 1, None, DAY, D("2.00"), D("650.00"), "cash", "other", TS),         # reason domain
        (9, 1, 99, None, DAY, D("2.00"), D("650.00"), "cash", "", TS),             # unknown product
        (10, 1, 1, 42, DAY, D("2.00"), D("650.00"), "credit", "school_hotel", TS),  # unknown customer
        (11, 1, 1, 1, DAY, D("2.00"), D("650.00"), "cash", "none", TS),            # cash naming a customer: fine
    ]
    out = validate.validate_sales({**seed, "raw_sales": spark.createDataFrame(rows, RAW_SALES_DDL)})
    assert reasons(out) == {1: None, 2: "missing_required", 3: None, 4: "missing_required", 5: "bad_payment_type",
                            6: "credit_needs_customer", 7: "bad_weight_or_price", 8: "bad_discount_reason",
                            9: "unknown_product", 10: "unknown_customer", 11: None}
    assert {r["id"]: r["discount_reason"] for r in out.collect()}[1] == "none"


def test_closing_count_rules(spark, seed):
    rows = [(1, 1, 1, DAY, "9"), (2, 1, 1, DAY, "0"), (3, 1, 1, DAY, None), (4, 1, 1, DAY, "-1"),
            (5, 1, 1, DAY, "abc"), (6, 0, 1, DAY, "3"), (7, 1, 7, DAY, "3")]
    raw = spark.createDataFrame(rows, "id bigint, branch_id bigint, product_id bigint, stock_date date, "
                                      "closing_kg string")
    out = validate.validate_closing_counts({**seed, "raw_closing_counts": raw})
    assert reasons(out) == {1: None, 2: None, 3: "closing_null", 4: "bad_closing", 5: "bad_closing",
                            6: "missing_required", 7: "unknown_product"}


def test_expense_and_payment_zero(spark, seed):
    e = spark.createDataFrame([(1, 1, DAY, "Rent", D("0.00")), (2, 1, DAY, "", D("5.00")),
                               (3, 1, DAY, "Rent", D("-5.00"))],
                              "id bigint, branch_id bigint, expense_date date, description string, amount decimal(12,2)")
    assert reasons(validate.validate_expenses({**seed, "raw_expenses": e})) == {
        1: None, 2: "missing_required", 3: "bad_amount"}
    p = spark.createDataFrame([(1, 1, 1, DAY, D("0.00")), (2, 1, 1, DAY, D("-5.00")), (3, 1, 1, DAY, D("10.00"))],
                              "id bigint, customer_id bigint, branch_id bigint, payment_date date, amount decimal(12,2)")
    assert reasons(validate.validate_payments({**seed, "raw_payments": p})) == {
        1: "missing_required", 2: "bad_amount", 3: None}


def test_customer_defaults(spark, seed):
    raw = spark.createDataFrame(
        [(1, "  Hotel Z ", "hotel", "", D("0")), (2, "   ", None, None, None), (3, "Acme", "company", None, None),
         (4, "Shule", None, None, None)],
        "id bigint, name string, customer_type string, phone string, credit_limit decimal(12,2)")
    out = {r["id"]: r for r in validate.validate_customers({**seed, "raw_customers": raw}).collect()}
    assert (out[1]["name"], out[1]["phone"], out[1]["credit_limit"], out[1]["reject_reason"]) == \
        ("Hotel Z", None, D("3000.00"), None)
    assert out[2]["reject_reason"] == "missing_name"
    assert out[3]["reject_reason"] == "bad_customer_type"
    assert (out[4]["customer_type"], out[4]["credit_limit"], out[4]["reject_reason"]) == ("individual", D("3000.00"), None)


ITEM = "struct<product_id:bigint, output_weight_kg:decimal(8,2), expected_yield_pct:decimal(5,2)>"
GOOD = lambda product: (product, D("5.00"), D("3.00"))


def _posts(spark, seed, posts, pairs=()):
    raw = spark.createDataFrame(posts, f"post_id bigint, carcass_purchase_id bigint, items array<{ITEM}>")
    stored = spark.createDataFrame(list(pairs), "carcass_purchase_id bigint, product_id bigint")
    out = validate.validate_breakdown_batches({**seed, "raw_breakdown_batches": raw, "stored_breakdown_pairs": stored}).collect()
    reasons = {}
    for r in out:
        reasons.setdefault(r["post_id"], set()).add(r["reject_reason"])
    assert all(len(v) == 1 for v in reasons.values())
    return {k: v.pop() for k, v in reasons.items()}, len(out)


def test_breakdown_batch_all_or_nothing(spark, seed):
    got, _ = _posts(spark, seed, [
        (1, 1, [GOOD(1), GOOD(5)]), (2, 2, [GOOD(1), (5, D("-1.00"), D("12.00"))]), (3, 3, [GOOD(1), GOOD(1)]), (4, 4, [])])
    assert got == {1: None, 2: "negative_output", 3: "unknown_carcass", 4: "missing_required"}


def test_breakdown_duplicate_product(spark, seed):
    got, rows = _posts(spark, seed, [(1, 1, [GOOD(1), GOOD(5), GOOD(1)])])
    assert got == {1: "duplicate_product"} and rows == 3


def test_breakdown_posts_stand_alone(spark, seed):
    """Posts of one carcass are decided in order against the accepted ones; a post without
    a carcass is rejected, not lost."""
    got, rows = _posts(spark, seed, [
        (1, 1, [GOOD(2)]), (2, 1, [GOOD(2)]), (3, 1, [GOOD(1)]), (4, None, [GOOD(1)]), (5, 1, [GOOD(2), GOOD(3)]), (6, 1, [GOOD(3)])])
    assert got == {1: None, 2: "duplicate_product", 3: None, 4: "missing_required", 5: "duplicate_product", 6: None}
    assert rows == 7


def test_breakdown_pairs_already_stored(spark, seed):
    got, _ = _posts(spark, seed, [(1, 1, [GOOD(2)]), (2, 1, [GOOD(1)])], pairs=[(1, 2)])
    assert got == {1: "duplicate_product", 2: None}


def test_key_check_spreads_rows_without_key(spark):
    from tallyman.functions.rules import with_key_check

    df = spark.range(200).select("id", F.when(F.col("id") % 4 == 0, F.col("id")).alias("k"))
    dim = spark.range(0, 100).select("id")
    out = with_key_check(df, dim, "k", "bad").collect()
    assert len(out) == 200
    assert {r["id"] for r in out if r["bad"]} == set(range(100, 200, 4))
