"""Stand-in model tables derived from the driver's TPC-H-style parquet tables.

Each builder only shapes rows into the model schema (FIXTURES.md §2); none of
them computes a report. Every table is derived from whole driver tables (no
id subsets): every order is also a carcass purchase, every line item is also
a sale, a breakdown contribution and a branch transfer.

A builder is a lazy DataFrame; with a store, a table is derived and written on its
first use, before the query that asks for it runs. Stock rows exist for the days
that received a transfer; a day with sales only has none (the view must then
ignore those sales), and its night count creates one.
"""

from __future__ import annotations

import os
import threading
import uuid
from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyman.sources.schemas import KG, MONEY, PCT, PRICE, STOCK_KG

DRIVER_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

# Fixed values of the test-data mapping (FIXTURES.md §2).
N_BRANCHES = 25            # one branch per nation
N_PRODUCTS = 6             # product k = l_partkey % 6 + 1
EXPENSE_EPOCH = "1995-01-01"
EXPENSE_SPAN_DAYS = 2404
MAIN_NATIONKEY = 0


def read_driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _product_of(partkey: Column) -> Column:
    return (partkey % N_PRODUCTS + 1).cast("bigint")


def _list_price(product_id: Column) -> Column:
    return (product_id * 100 + 50).cast(PRICE)


def _line_id(li: str = "") -> Column:
    """A 60-bit id of a line from all four of its keys (order and line number alone are
    not unique in the test tables): the first digits of their text's MD5, so keys of any
    size fit into a BIGINT."""
    keys = F.concat_ws("-", *[F.col(f"{li}{n}").cast("string") for n in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")])
    return F.conv(F.substring(F.md5(keys.cast("binary")), 1, 15), 16, 10).cast("bigint")


class FixtureTables(Mapping[str, DataFrame]):
    """``{model table: DataFrame}`` over one driver directory.

    With ``store`` set, each stand-in table is written once as parquet to
    ``store/<table>`` and read back, the way production reads stored model tables:
    later queries scan the stored rows with column pruning and parallel splits
    instead of re-deriving them from the driver tables. Only inputs are stored; every
    query still computes its result from them."""

    def __init__(self, spark: SparkSession, sf_dir: str, store: str | None = None):
        self.spark = spark
        self.sf_dir = sf_dir
        self.store = store
        self._lock = threading.RLock()  # one writer per stored table, even if queries run on several threads
        self._cache: dict[str, DataFrame] = {}
        self._builders: dict[str, Callable[[], DataFrame]] = {
            "branches": self._branches,
            "products": self._products,
            "customers": self._customers,
            "sales": self._sales,
            "payments": self._payments,
            "expenses": self._expenses,
            "carcass_purchases": self._carcass_purchases,
            "breakdown_records": self._breakdown_records,
            "branch_transfers": self._branch_transfers,
            "daily_stock": self._daily_stock,
            "closing_counts": self._closing_counts,
            "daily_stock_unfilled": self._daily_stock_unfilled,
            "profit_targets": self._profit_targets,
            "users": self._users,
            "notifications": self._notifications,
            "allocation_forms": self._allocation_forms,
            "breakdown_forms": self._breakdown_forms,
            "sale_drafts": self._sale_drafts,
            "raw_sales": self._raw_sales,
            "raw_closing_counts": self._raw_closing_counts,
            "raw_carcass_purchases": self._raw_carcass_purchases,
            "raw_breakdown_batches": self._raw_breakdown_batches,
            "stored_breakdown_pairs": self._stored_breakdown_pairs,
            "raw_branch_transfers": self._raw_branch_transfers,
            "raw_payments": self._raw_payments,
            "raw_expenses": self._raw_expenses,
            "raw_customers": self._raw_customers,
            "read_acks": self._read_acks,
        }
        #: Steps that several tables share; stored like tables, but not of the model.
        self._steps: dict[str, Callable[[], DataFrame]] = {"sold_days": self._sold_days}

    # Mapping protocol -------------------------------------------------
    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._builders:
            raise KeyError(name)
        with self._lock:
            return self._get(name)

    def _get(self, name: str) -> DataFrame:
        if name not in self._cache:
            df = (self._steps[name] if name in self._steps else self._builders[name])()
            if self.store is not None:
                path = f"{self.store.rstrip('/')}/{name}"
                df.write.mode("overwrite").parquet(path)
                df = self.spark.read.schema(df.schema).parquet(path)
            self._cache[name] = df
        return self._cache[name]

    def path(self, name: str) -> str:
        """Directory of a stored stand-in table (stored on first use), for
        jobs that read files, such as file streams."""
        if self.store is None:
            raise ValueError("stand-in tables are not stored; use fixture_tables(..., stored=True)")
        self[name]
        return f"{self.store.rstrip('/')}/{name}"

    def __iter__(self) -> Iterator[str]:
        return iter(self._builders)

    def __len__(self) -> int:
        return len(self._builders)

    def raw(self, name: str) -> DataFrame:
        return read_driver_table(self.spark, self.sf_dir, name)

    # Dimensions -------------------------------------------------------
    def _branches(self) -> DataFrame:
        return self.raw("nation").select(
            (F.col("n_nationkey") + 1).cast("bigint").alias("id"),
            F.col("n_name").alias("name"),
            (F.col("n_nationkey") == MAIN_NATIONKEY).alias("is_main"),
        )

    def _products(self) -> DataFrame:
        ids = self.raw("part").select(_product_of(F.col("p_partkey")).alias("id")).distinct()
        return ids.select(
            "id",
            F.concat(F.lit("product_"), F.col("id").cast("string")).alias("name"),
            _list_price(F.col("id")).alias("price_per_kg"),
            (F.col("id") > 2).alias("is_byproduct"),
        )

    def _customers(self) -> DataFrame:
        seg = F.col("c_mktsegment")
        return self.raw("customer").select(
            F.col("c_custkey").alias("id"),
            F.col("c_name").alias("name"),
            F.when(seg == "BUILDING", "school").when(seg == "HOUSEHOLD", "hotel")
            .otherwise("individual").alias("customer_type"),
            F.lit(None).cast("string").alias("phone"),
            F.lit(0).cast(MONEY).alias("balance_owed"),
            F.when(F.col("c_acctbal") < 0, F.lit(3000))
            .otherwise(F.floor("c_acctbal") + 20000).cast(MONEY).alias("credit_limit"),
        )

    def _users(self) -> DataFrame:
        admin = self.raw("nation").where(F.col("n_nationkey") == MAIN_NATIONKEY).select(
            F.lit(0).cast("bigint").alias("id"), F.lit("admin").alias("username"),
            F.lit("admin").alias("role"), F.lit(None).cast("bigint").alias("branch_id"))
        staff = self._branches().select(
            F.col("id").alias("id"),
            F.concat(F.lit("attendant_"), F.col("id").cast("string")).alias("username"),
            F.lit("attendant").alias("role"), F.col("id").alias("branch_id"))
        return admin.unionByName(staff)

    # Facts ------------------------------------------------------------
    def _sales(self) -> DataFrame:
        li = self.raw("lineitem")
        o = self.raw("orders").select("o_orderkey", "o_custkey", "o_orderdate")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        placed = o.join(c, o.o_custkey == c.c_custkey)  # orders first, so that lines are shuffled once
        j = li.join(placed, li.l_orderkey == placed.o_orderkey)
        pid = _product_of(F.col("l_partkey"))
        disc = F.col("l_discount")
        return j.select(
            _line_id().alias("id"),
            (F.col("c_nationkey") + 1).cast("bigint").alias("branch_id"),
            pid.alias("product_id"),
            F.when((F.col("l_returnflag") != "R") & (F.col("l_orderkey") % 3 == 0), F.lit(None))
            .otherwise(F.col("o_custkey")).cast("bigint").alias("customer_id"),
            F.to_date("o_orderdate").alias("sale_date"),
            (F.col("l_quantity").cast(KG) + F.col("l_tax").cast("decimal(4,2)")).cast(KG).alias("weight_kg"),
            (_list_price(pid) * (F.lit(1) - disc.cast("decimal(4,2)"))).cast(PRICE).alias("price_charged"),
            F.when(F.col("l_returnflag") == "R", "credit").otherwise("cash").alias("payment_type"),
            F.when(F.col("l_linenumber") == 7, F.lit(None).cast("string"))
            .when(disc == 0, "none").when(disc < 0.04, "regular_customer")
            .when(disc < 0.08, "school_hotel").otherwise("weekly_promo_day").alias("discount_reason"),
            F.col("l_shipdate").alias("created_at"),
        )

    def _payments(self) -> DataFrame:
        o = self.raw("orders")
        c = self.raw("customer").select("c_custkey", "c_nationkey")
        return o.join(c, o.o_custkey == c.c_custkey).select(
            F.col("o_orderkey").alias("id"),
            F.col("o_custkey").alias("customer_id"),
            (F.col("c_nationkey") + 1).cast("bigint").alias("branch_id"),
            F.to_date("o_orderdate").alias("payment_date"),
            (F.floor(F.col("o_totalprice") / 10) + 1).cast(MONEY).alias("amount"),
            F.col("o_orderdate").alias("created_at"),
        )

    def _expenses(self) -> DataFrame:
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            (F.col("user_id") % N_BRANCHES + 1).cast("bigint").alias("branch_id"),
            F.date_add(F.lit(EXPENSE_EPOCH).cast("date"),
                       (F.col("event_id") % EXPENSE_SPAN_DAYS).cast("int")).alias("expense_date"),
            F.col("event_type").alias("description"),
            (F.col("value").cast(MONEY) * 100).cast(MONEY).alias("amount"),
            F.col("ts").alias("created_at"),
        )

    def _order_weight(self) -> DataFrame:
        return self.raw("lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("w"))

    def _carcass_purchases(self) -> DataFrame:
        o = self.raw("orders")
        j = o.join(self._order_weight(), o.o_orderkey == F.col("l_orderkey"), "left")
        factor = F.when(F.col("o_orderkey") % 50 == 0, F.lit(0.98).cast("decimal(3,2)")) \
            .otherwise(F.lit(1.08).cast("decimal(3,2)"))
        received = (F.coalesce(F.col("w"), F.lit(100.0)).cast("decimal(10,2)") * factor).cast(KG)
        return j.select(
            F.col("o_orderkey").alias("id"),
            F.lit(1).cast("bigint").alias("branch_id"),
            F.when(F.col("o_orderkey") % 20 == 0, "beef").otherwise("mutton").alias("animal_type"),
            (received + 2).cast(KG).alias("invoice_weight_kg"),
            received.alias("received_weight_kg"),
            F.floor("o_totalprice").cast(MONEY).alias("cost"),
            F.to_date("o_orderdate").alias("purchase_date"),
            F.col("o_orderdate").alias("created_at"),
        )

    def _breakdown_records(self) -> DataFrame:
        li = self.raw("lineitem")
        per = li.groupBy("l_orderkey", _product_of(F.col("l_partkey")).alias("product_id")) \
            .agg(F.sum("l_quantity").alias("out"))
        cp = self["carcass_purchases"].select(
            F.col("id").alias("cp_id"), "received_weight_kg", "created_at")
        j = per.join(cp, per.l_orderkey == cp.cp_id)
        rid = F.col("l_orderkey") * 10 + F.col("product_id")
        # output/received*100 rounded half-up to hundredths, in integer cents
        o_c = (F.col("out") * 100).cast("bigint")
        r_c = (F.col("received_weight_kg") * 100).cast("bigint")
        hundredths = F.floor((o_c * 20000 + r_c) / (r_c * 2)).cast("bigint")
        expected = F.greatest(F.lit(0).cast("bigint"), hundredths + (rid % 9 - 4) * 100)
        return j.select(
            rid.alias("id"),
            F.col("l_orderkey").alias("carcass_purchase_id"),
            "product_id",
            F.col("out").cast(KG).alias("output_weight_kg"),
            (expected.cast("decimal(18,0)") * F.lit(0.01).cast("decimal(3,2)")).cast(PCT)
            .alias("expected_yield_pct"),
            "created_at",
        )

    def _branch_transfers(self) -> DataFrame:
        return self.raw("lineitem").select(
            _line_id().alias("id"),
            (F.col("l_orderkey") * 10 + _product_of(F.col("l_partkey"))).alias("breakdown_record_id"),
            (F.col("l_suppkey") % N_BRANCHES + 1).cast("bigint").alias("to_branch_id"),
            F.col("l_quantity").cast(KG).alias("weight_sent_kg"),
            F.to_date("l_shipdate").alias("transfer_date"),
            F.col("l_shipdate").alias("created_at"),
        )

    @staticmethod
    def _day_hash() -> Column:
        return (F.col("branch_id") * 31 + F.col("product_id") * 7 + F.dayofmonth("stock_date")) % 20

    @staticmethod
    def _day_id() -> Column:
        return ((F.col("branch_id") * 10 + F.col("product_id")) * 100000
                + F.datediff("stock_date", F.lit("1970-01-01").cast("date")))

    def _sold_days(self) -> DataFrame:
        """Σ sales weight per (branch, product, day). If sales aren't stored yet they are not
        stored for this: their derivation then reads and computes these four columns only."""
        sales = self._cache["sales"] if "sales" in self._cache else self._sales()
        return sales.groupBy("branch_id", "product_id", F.col("sale_date").alias("stock_date")).agg(F.sum("weight_kg").alias("sold"))

    def _daily_stock(self) -> DataFrame:
        """One row for each (branch, product, day) that received a transfer."""
        days = self.raw("lineitem").select(
            (F.col("l_suppkey") % N_BRANCHES + 1).cast("bigint").alias("branch_id"),
            _product_of(F.col("l_partkey")).alias("product_id"),
            F.to_date("l_shipdate").alias("stock_date")).distinct()
        k = days.join(self._get("sold_days"), ["branch_id", "product_id", "stock_date"], "left").withColumn("h", self._day_hash())
        h = F.col("h")
        sold = F.coalesce(F.col("sold"), F.lit(0).cast(STOCK_KG))
        return k.select(
            self._day_id().alias("id"),
            "branch_id", "product_id", "stock_date",
            F.when(h == 19, 0).otherwise(20).cast(STOCK_KG).alias("opening_kg"),
            F.when(h == 19, F.lit(0)).otherwise(sold + 30).cast(STOCK_KG).alias("received_kg"),
            F.when(h == 19, 0).when(h < 10, 50).when(h < 14, 45).when(h < 17, 20).otherwise(58)
            .cast(STOCK_KG).alias("closing_kg"),
            F.date_add("stock_date", 1).cast("timestamp_ntz").alias("created_at"),
        )

    def _daily_stock_unfilled(self) -> DataFrame:
        """daily_stock as inserted: rows with an even hash came in with a NULL
        opening (to be filled from the previous day), the others with one."""
        return self["daily_stock"].withColumn(
            "opening_kg", F.when(self._day_hash() % 2 == 0, F.lit(None)).otherwise(F.col("opening_kg")).cast(STOCK_KG))

    def _closing_counts(self) -> DataFrame:
        """Night counts, arriving 0–2 days late at 23:00: of every stock row, and (12.5 kg)
        of every day with sales that has no stock row yet. Days with h % 7 == 0 are
        counted again a day later (last write wins). id = day id * 10 + count number."""
        key = ["branch_id", "product_id", "stock_date"]
        stock = self["daily_stock"].select(*key, "closing_kg")
        unseen = self._get("sold_days").join(stock.select(*key), key, "left_anti").select(*key, F.lit(12.5).cast(STOCK_KG).alias("closing_kg"))
        ds = stock.unionByName(unseen).select(self._day_id().alias("id"), *key, "closing_kg", self._day_hash().alias("h"))
        arrival = F.timestamp_add(
            "HOUR", F.lit(23), F.date_add("stock_date", (F.col("h") % 3).cast("int")).cast("timestamp_ntz"))
        first = ds.select((F.col("id") * 10 + 1).alias("id"), *key, "closing_kg", arrival.alias("created_at"))
        again = ds.where(F.col("h") % 7 == 0).select(
            (F.col("id") * 10 + 2).alias("id"), *key,
            (F.col("closing_kg") + F.lit(1.5)).cast(STOCK_KG).alias("closing_kg"),
            F.timestamp_add("HOUR", F.lit(24), arrival).alias("created_at"))
        return first.unionByName(again)

    def _allocation_forms(self) -> DataFrame:
        """The allocation step's form per carcass: {record id: {branch id:
        typed weight}}; a line with no discount was typed as '0'."""
        li = self.raw("lineitem")
        cells = li.groupBy(
            "l_orderkey", (F.col("l_orderkey") * 10 + _product_of(F.col("l_partkey"))).alias("record_id"),
            (F.col("l_suppkey") % N_BRANCHES + 1).cast("bigint").alias("branch_id"),
        ).agg(F.when(F.min("l_discount") == 0, F.lit("0"))
              .otherwise(F.sum("l_quantity").cast(KG).cast("string")).alias("weight"))
        rows = cells.groupBy("l_orderkey", "record_id").agg(
            F.map_from_entries(F.collect_list(F.struct("branch_id", "weight"))).alias("cells"))
        return rows.groupBy(F.col("l_orderkey").alias("carcass_purchase_id")).agg(
            F.map_from_entries(F.collect_list(F.struct("record_id", "cells"))).alias("allocations"))

    def _breakdown_forms(self) -> DataFrame:
        """The breakdown step's form per carcass: {product id: {output,
        expected}} as typed text. Orders whose key is a multiple of 97 were
        left blank; a line with no tax left the expected % blank."""
        li = self.raw("lineitem")
        blank = F.col("l_orderkey") % 97 == 0
        per = li.groupBy("l_orderkey", _product_of(F.col("l_partkey")).alias("product_id")).agg(
            F.sum("l_quantity").alias("q"), F.min("l_tax").alias("tax"))
        row = F.struct(
            F.when(blank, F.lit("")).otherwise(F.col("q").cast(KG).cast("string")).alias("output_weight_kg"),
            F.when(F.col("tax") == 0, F.lit("")).otherwise((F.col("tax") * 100).cast("decimal(5,1)").cast("string"))
            .alias("expected_yield_pct"))
        return per.groupBy(F.col("l_orderkey").alias("carcass_purchase_id")).agg(
            F.map_from_entries(F.collect_list(F.struct("product_id", row))).alias("rows"))

    def _sale_drafts(self) -> DataFrame:
        """Sales as typed: every seventh id left the price blank."""
        s = self["sales"]
        return s.withColumn("price_charged",
                            F.when(F.col("id") % 7 == 6, F.lit(None))
                            .otherwise(F.col("price_charged")).cast(PRICE))

    # Dirty inputs (FIXTURES.md §3): fields overridden by id modulus, first
    # match wins, every other row clean.
    @staticmethod
    def _tag(rules: list[tuple[int, str]]) -> Column:
        out = F.lit("clean")
        for mod, tag in reversed(rules):
            out = F.when(F.col("id") % mod == 0, F.lit(tag)).otherwise(out)
        return out

    def _raw_sales(self) -> DataFrame:
        tag = self._tag([(97, "weight0"), (89, "card"), (83, "credit_nocust"), (79, "product99"),
                         (73, "price_neg"), (71, "price0"), (67, "reason_other"), (61, "reason_null")])
        s = self["sales"].withColumn("_t", tag)
        t = F.col("_t")
        return s.select(
            "id", "branch_id",
            F.when(t == "product99", F.lit(99)).otherwise(F.col("product_id")).cast("bigint").alias("product_id"),
            F.when(t == "credit_nocust", F.lit(None)).otherwise(F.col("customer_id")).cast("bigint").alias("customer_id"),
            "sale_date",
            F.when(t == "weight0", F.lit(0)).otherwise(F.col("weight_kg")).cast(KG).alias("weight_kg"),
            F.when(t == "price_neg", F.lit(-1)).when(t == "price0", F.lit(0)).otherwise(F.col("price_charged"))
            .cast(PRICE).alias("price_charged"),
            F.when(t == "card", F.lit("card")).when(t == "credit_nocust", F.lit("credit"))
            .otherwise(F.col("payment_type")).alias("payment_type"),
            F.when(t == "reason_other", F.lit("other")).when(t == "reason_null", F.lit(None))
            .otherwise(F.col("discount_reason")).alias("discount_reason"),
            "created_at")

    def _raw_closing_counts(self) -> DataFrame:
        tag = self._tag([(31, "null"), (29, "neg"), (23, "abc"), (19, "zero")])
        d = self["daily_stock"].withColumn("_t", tag)
        t = F.col("_t")
        txt = (F.when(t == "null", F.lit(None)).when(t == "neg", F.lit("-1")).when(t == "abc", F.lit("abc"))
               .when(t == "zero", F.lit("0")).otherwise(F.col("closing_kg").cast("string")))
        return d.select("id", "branch_id", "product_id", "stock_date", txt.alias("closing_kg"))

    def _raw_carcass_purchases(self) -> DataFrame:
        tag = self._tag([(70, "goat"), (90, "received0"), (110, "cost0"), (130, "cost_null")])
        d = self["carcass_purchases"].withColumn("_t", tag)
        t = F.col("_t")
        return d.select(
            "id", "branch_id",
            F.when(t == "goat", F.lit("goat")).otherwise(F.col("animal_type")).alias("animal_type"),
            "invoice_weight_kg",
            F.when(t == "received0", F.lit(0)).otherwise(F.col("received_weight_kg")).cast(KG)
            .alias("received_weight_kg"),
            F.when(t == "cost0", F.lit(0)).when(t == "cost_null", F.lit(None)).otherwise(F.col("cost"))
            .cast(MONEY).alias("cost"),
            "purchase_date")

    def _raw_breakdown_batches(self) -> DataFrame:
        """Posts of breakdown items, sorted by product. Each carcass sends one: carcass
        % 70 = 0 without items, % 90 with a first item of output −1, % 110 with its first
        item repeated at the end, % 130 without naming the carcass. Carcass % 60 = 0 sends
        a second post (id + 1) with its first item again, and % 50 = 0 has its first item
        stored already (``stored_breakdown_pairs``)."""
        br = self["breakdown_records"]
        item = F.struct("product_id", "output_weight_kg", "expected_yield_pct")
        g = br.groupBy("carcass_purchase_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
        cid = F.col("carcass_purchase_id")
        first = F.col("items")[0]
        bad_first = F.struct(first["product_id"].alias("product_id"),
                             F.lit(-1).cast(KG).alias("output_weight_kg"),
                             first["expected_yield_pct"].alias("expected_yield_pct"))
        items = (F.when(cid % 70 == 0, F.array().cast(g.schema["items"].dataType))
                 .when(cid % 90 == 0, F.concat(F.array(bad_first), F.slice("items", 2, F.size("items"))))
                 .when(cid % 110 == 0, F.concat(F.col("items"), F.array(first)))
                 .otherwise(F.col("items")))
        named = F.when(cid % 130 == 0, F.lit(None)).otherwise(cid).cast("bigint")
        posts = g.select((cid * 2).alias("post_id"), named.alias("carcass_purchase_id"), items.alias("items"))
        again = g.where(cid % 60 == 0).select((cid * 2 + 1).alias("post_id"), "carcass_purchase_id", F.array(first).alias("items"))
        return posts.unionByName(again)

    def _stored_breakdown_pairs(self) -> DataFrame:
        """Breakdown records that the table holds before the posts arrive."""
        br = self["breakdown_records"].where(F.col("carcass_purchase_id") % 50 == 0)
        return br.groupBy("carcass_purchase_id").agg(F.min("product_id").alias("product_id"))

    def _raw_branch_transfers(self) -> DataFrame:
        tag = self._tag([(37, "weight0"), (41, "branch99"), (43, "record_null")])
        d = self["branch_transfers"].withColumn("_t", tag)
        t = F.col("_t")
        return d.select(
            "id",
            F.when(t == "record_null", F.lit(None)).otherwise(F.col("breakdown_record_id")).cast("bigint")
            .alias("breakdown_record_id"),
            F.when(t == "branch99", F.lit(99)).otherwise(F.col("to_branch_id")).cast("bigint").alias("to_branch_id"),
            F.when(t == "weight0", F.lit(0)).otherwise(F.col("weight_sent_kg")).cast(KG).alias("weight_sent_kg"),
            "transfer_date")

    def _raw_payments(self) -> DataFrame:
        tag = self._tag([(37, "zero"), (41, "neg")])
        d = self["payments"].withColumn("_t", tag)
        t = F.col("_t")
        return d.select("id", "customer_id", "branch_id", "payment_date",
                        F.when(t == "zero", F.lit(0)).when(t == "neg", F.lit(-5)).otherwise(F.col("amount"))
                        .cast(MONEY).alias("amount"))

    def _raw_expenses(self) -> DataFrame:
        tag = self._tag([(37, "zero"), (41, "neg"), (43, "blank")])
        d = self["expenses"].withColumn("_t", tag)
        t = F.col("_t")
        return d.select("id", "branch_id", "expense_date",
                        F.when(t == "blank", F.lit("")).otherwise(F.col("description")).alias("description"),
                        F.when(t == "zero", F.lit(0)).when(t == "neg", F.lit(-5)).otherwise(F.col("amount"))
                        .cast(MONEY).alias("amount"))

    def _raw_customers(self) -> DataFrame:
        tag = self._tag([(37, "name_null"), (41, "name_blank"), (43, "company"), (47, "limit0"),
                         (53, "limit_null"), (59, "type_null")])
        d = self["customers"].withColumn("_t", tag)
        t = F.col("_t")
        return d.select(
            "id",
            F.when(t == "name_null", F.lit(None)).when(t == "name_blank", F.lit("   "))
            .otherwise(F.concat(F.lit(" "), F.col("name"), F.lit(" "))).alias("name"),
            F.when(t == "company", F.lit("company")).when(t == "type_null", F.lit(None))
            .otherwise(F.col("customer_type")).alias("customer_type"),
            "phone",
            F.when(t == "limit0", F.lit(0)).when(t == "limit_null", F.lit(None)).otherwise(F.col("credit_limit"))
            .cast(MONEY).alias("credit_limit"))

    def _notifications(self) -> DataFrame:
        """An earlier notifications table: one alert per event, on the event's
        expense day; every second one already read."""
        et = F.col("event_type")
        atype = (F.when(et.isin("view", "error"), "high_variance").when(et == "click", "negative_profit")
                 .when(et == "purchase", "target_performance").otherwise("high_credit_balance"))
        credit = atype == "high_credit_balance"
        return self.raw("events").select(
            F.col("event_id").alias("id"),
            F.when(credit, F.lit(None)).otherwise(F.col("user_id") % N_BRANCHES + 1).cast("bigint").alias("branch_id"),
            F.when(credit, F.col("user_id") + 1).cast("bigint").alias("customer_id"),
            atype.alias("alert_type"),
            F.concat(F.lit("earlier alert "), F.col("event_id").cast("string")).alias("message"),
            F.lit("info").alias("severity"),
            (F.col("event_id") % 2 == 0).alias("is_read"),
            F.date_add(F.lit(EXPENSE_EPOCH).cast("date"),
                       (F.col("event_id") % EXPENSE_SPAN_DAYS).cast("int")).alias("alert_date"),
            F.col("ts").alias("created_at"),
        )

    def _read_acks(self) -> DataFrame:
        """Notification ids a user marked read: every 'click' event's alert,
        and for every 'signup' event an id that does not exist."""
        ev = self.raw("events")
        known = ev.where(F.col("event_type") == "click").select(F.col("event_id").alias("id"))
        unknown = ev.where(F.col("event_type") == "signup").select((F.col("event_id") + 1000000000).alias("id"))
        return known.unionByName(unknown)

    def _profit_targets(self) -> DataFrame:
        """One target per (branch, calendar month) that has sales or expenses:
        January daily, even months weekly, other months monthly; December's
        target is 0 (its percentage is NULL)."""
        s = self["sales"].select("branch_id", F.trunc("sale_date", "month").alias("period_start"))
        e = self["expenses"].select("branch_id", F.trunc("expense_date", "month").alias("period_start"))
        months = s.unionByName(e).distinct()
        m = F.month("period_start")
        idx = (F.year("period_start") - 1995) * 12 + m - 1
        return months.select(
            (F.col("branch_id") * 1000 + idx).cast("bigint").alias("id"),
            "branch_id",
            F.when(m == 1, "daily").when(m % 2 == 0, "weekly").otherwise("monthly").alias("period_type"),
            "period_start",
            F.when(m == 12, 0).otherwise(150000).cast(MONEY).alias("target_amount"),
        )


_MAPPINGS: dict[tuple[str, str, bool], FixtureTables] = {}
_MAPPINGS_LOCK = threading.Lock()


def fixture_tables(spark: SparkSession, sf_dir: str, stored: bool = True) -> FixtureTables:
    """The stand-in mapping for one (session, directory), built once.

    ``stored`` (default) writes each stand-in table on first use under the
    session's checkpoint folder (``spark.checkpoint.dir`` on a cluster), in a
    folder unique to this mapping; ``stored=False`` keeps every table a lazy
    derivation from the driver tables."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"), stored)
    with _MAPPINGS_LOCK:
        return _mapping(spark, sf_dir, stored, key)


def _mapping(spark: SparkSession, sf_dir: str, stored: bool, key) -> FixtureTables:
    if key not in _MAPPINGS:
        store = None
        if stored:
            from tallyman.session import checkpoint_dir
            tag = os.path.basename(sf_dir.rstrip("/")) or "data"
            store = f"{checkpoint_dir(spark).rstrip('/')}/tallyman-model-{tag}-{uuid.uuid4().hex[:12]}"
        _MAPPINGS[key] = FixtureTables(spark, sf_dir, store)
    return _MAPPINGS[key]
