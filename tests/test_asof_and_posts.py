"""Lookups in two orders, sliced last values and posts decided in rounds, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from tallyman.functions.asof import earlier_in_both
from tallyman.functions.prefix import running_last
from tallyman.operators.validate import _late_posts


@pytest.mark.parametrize("span", [30, 900, 40_000, 3_000_000])
def test_earlier_in_both_equals_brute_force(spark, span):
    r = random.Random(span)
    rows = []
    for key in range(4):
        n = min(span, (1, 40, 250, 25)[key])
        rows += [(key, p - span // 2, r.randrange(60), i) for i, p in enumerate(r.sample(range(span), n))]
    df = spark.createDataFrame(rows, "k int, p int, t int, i int").withColumn("arrival", F.struct("t", "i"))
    got = {(x.k, x.p): x.found for x in earlier_in_both(df, ["k"], "p", "arrival", "found").collect()}
    assert got == {(k, p): max((q for k2, q, t2, i2 in rows if k2 == k and q < p and (t2, i2) < (t, i)), default=None) for k, p, t, i in rows}


def test_earlier_in_both_of_an_empty_table(spark):
    df = spark.createDataFrame([], "k int, p int, arrival int")
    assert earlier_in_both(df, ["k"], "p", "arrival", "found").count() == 0


def test_running_last_carries_over_slices(spark):
    r = random.Random(2)
    rows = [(k, i, r.choice([None, None, r.randrange(100)])) for k in range(3) for i in range((900, 5, 60)[k])]
    got = {(x.k, x.i): x.last for x in running_last(spark.createDataFrame(rows, "k int, i int, v int"), ["k"], [F.col("i")], "v", "last").collect()}
    want, held = {}, {}
    for k, i, v in rows:
        held[k] = v if v is not None else held.get(k)
        want[k, i] = held[k]
    assert got == want


def test_ten_thousand_posts_of_one_carcass(spark):
    r = random.Random(4)
    posts = [(post, 1 if post < 10_000 else 2, r.sample(range(9), r.randint(1, 3))) for post in range(10_300)]
    pairs = spark.createDataFrame([(post, carcass, p) for post, carcass, products in posts for p in products], "post_id bigint, carcass_purchase_id bigint, product_id bigint")
    taken, late = set(), set()
    for post, carcass, products in posts:
        mine = {(carcass, p) for p in products}
        if mine & taken:
            late.add(post)
        else:
            taken |= mine
    assert {x.post_id for x in _late_posts(pairs).collect()} == late
