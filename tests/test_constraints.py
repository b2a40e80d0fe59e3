"""V9 with planted violations, and how often it reads a table."""

import re

from pyspark.sql import functions as F

from paths import SF001
from tallyman.operators.validate import constraint_report
from tallyman.sources.fixtures import fixture_tables


def _counts(t):
    rows = constraint_report(t).collect()
    assert len({(r.table_name, r.rule) for r in rows}) == len(rows)
    return {(r.table_name, r.rule): r.bad_rows for r in rows}


def test_seed_rows_break_nothing(seed):
    assert set(_counts(seed).values()) == {0}


def test_planted_violations_are_counted_by_rule(seed):
    t = dict(seed)
    sales = seed["sales"]
    one = sales.limit(1)
    many = one.withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(500)))).withColumn("customer_id", F.lit(987654).cast(sales.schema["customer_id"].dataType))
    t["sales"] = sales.unionByName(many.withColumn("id", (F.lit(10_000_000) + F.col("n")).cast(sales.schema["id"].dataType)).drop("n")) \
        .unionByName(one.withColumn("weight_kg", F.lit(0).cast(sales.schema["weight_kg"].dataType)))
    t["branches"] = seed["branches"].withColumn("is_main", F.lit(True))
    t["products"] = seed["products"].withColumn("name", F.lit("x, y"))
    t["customers"] = seed["customers"].withColumn("customer_type", F.lit(None).cast("string"))
    got = {k: v for k, v in _counts(t).items() if v}
    expected = {("sales", "customer_id -> customers"): 500, ("sales", "unique(id)"): 2, ("sales", "weight_kg > 0"): 1,
                ("branches", "at most one main branch"): seed["branches"].count(), ("products", "unique(name)"): seed["products"].count()}
    if ("customers", "customer_type not null") in _counts(seed):
        expected[("customers", "customer_type not null")] = seed["customers"].count()
    assert got == expected


def test_empty_tables_break_nothing(seed):
    assert set(_counts({k: v.limit(0) for k, v in seed.items()}).values()) == {0}


def test_each_table_is_scanned_once(spark):
    t = fixture_tables(spark, SF001)
    plan = constraint_report(t)._jdf.queryExecution().optimizedPlan().toString()
    scans = re.findall(r"Relation \[", plan)
    assert len(scans) == plan.count("Generate explode(")
