"""Steps that a large input would pay for again and again: computed once, or not at all."""

import datetime as dt

from pyspark.sql import functions as F

from tallyman.operators.validate import constraint_report
from tallyman.sources.fixtures import FixtureTables
from tallyman.streaming.snapshots import KeyedSnapshot
from tests.paths import SF001


def test_stock_rows_do_not_store_sales(spark, tmp_path):
    t = FixtureTables(spark, SF001, str(tmp_path / "a"))
    lazily = sorted(map(tuple, t["closing_counts"].collect()))
    assert "sales" not in t._cache and "sold_days" not in list(t)
    u = FixtureTables(spark, SF001, str(tmp_path / "b"))
    u["sales"]
    assert lazily == sorted(map(tuple, u["closing_counts"].collect()))


def test_lines_are_shuffled_once_for_sales(spark, tmp_path):
    t = FixtureTables(spark, SF001)
    plan = t["sales"]._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join Inner" in line]
    assert "o_custkey" in joins[1] and "l_orderkey" in joins[0]  # the join with customers lies below that with lines


def test_snapshot_computes_its_deltas_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    deltas = spark.createDataFrame([(k, 1) for k in range(50)], "k bigint, n bigint").coalesce(1).mapInArrow(run, "k bigint, n bigint")
    kept = KeyedSnapshot(spark, str(tmp_path / "s"), "k bigint, n bigint", ["k"], 8)
    kept.add(0, deltas, ["k"], ["n"])
    kept.add(1, deltas, ["k"], ["n"])
    assert kept.current().agg(F.sum("n"), F.count("k")).first() == (100, 50)
    assert seen.value == 100


def test_constraint_keys_need_no_json_and_never_mix(spark):
    t = dict(FixtureTables(spark, SF001))
    day = dt.date(2024, 1, 1)
    targets = [(1, 1, "a1:b", day), (2, 1, "a", day), (3, None, "a", day), (4, None, "a", day), (5, 1, None, day), (6, 1, "-", day)]
    kind = {f.name: f.dataType for f in t["profit_targets"].schema}
    rows = spark.createDataFrame(targets, "id bigint, branch_id bigint, period_type string, period_start date")
    t["profit_targets"] = rows.withColumn("target_amount", F.lit(1).cast(kind["target_amount"]))
    t["users"] = t["users"].withColumn("id", F.lit(None).cast("bigint"))
    report = constraint_report(t)
    plan = report._jdf.queryExecution().optimizedPlan().toString()
    assert "to_json" not in plan and "lambda" not in plan
    got = {(r.table_name, r.rule): r.bad_rows for r in report.collect()}
    assert got["profit_targets", "unique(branch_id, period_type, period_start)"] == 2
    assert got["profit_targets", "unique(id)"] == 0
    assert got["users", "unique(id)"] == t["users"].count() > 1
