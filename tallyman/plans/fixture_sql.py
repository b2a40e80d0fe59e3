"""The stand-in table mapping written as DuckDB CTEs, for the oracle SQL.

These mirror ``tallyman.sources.fixtures`` expression by expression; only
the table mapping is shared with the Spark side, never an operator.
"""

from __future__ import annotations

FIXTURE_CTES: dict[str, str] = {
    "m_branches": """
        SELECT CAST(n_nationkey + 1 AS BIGINT) AS id, n_name AS name, n_nationkey = 0 AS is_main
        FROM nation""",
    "m_products": """
        SELECT id, 'product_' || CAST(id AS VARCHAR) AS name,
               CAST(id * 100 + 50 AS DECIMAL(10,2)) AS price_per_kg, id > 2 AS is_byproduct
        FROM (SELECT DISTINCT CAST(p_partkey % 6 + 1 AS BIGINT) AS id FROM part)""",
    "m_customers": """
        SELECT c_custkey AS id, c_name AS name,
               CASE c_mktsegment WHEN 'BUILDING' THEN 'school' WHEN 'HOUSEHOLD' THEN 'hotel'
                    ELSE 'individual' END AS customer_type,
               CAST(NULL AS VARCHAR) AS phone,
               CAST(0 AS DECIMAL(12,2)) AS balance_owed,
               CAST(CASE WHEN c_acctbal < 0 THEN 3000 ELSE floor(c_acctbal) + 20000 END AS DECIMAL(12,2))
                   AS credit_limit
        FROM customer""",
    "m_users": """
        SELECT CAST(0 AS BIGINT) AS id, 'admin' AS username, 'admin' AS role, CAST(NULL AS BIGINT) AS branch_id
        FROM nation WHERE n_nationkey = 0
        UNION ALL
        SELECT id, 'attendant_' || CAST(id AS VARCHAR), 'attendant', id FROM m_branches""",
    "m_sales": """
        SELECT CAST('0x' || substr(md5(concat_ws('-', l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey)), 1, 15) AS BIGINT) AS id,
               CAST(c.c_nationkey + 1 AS BIGINT) AS branch_id,
               CAST(l.l_partkey % 6 + 1 AS BIGINT) AS product_id,
               CASE WHEN l.l_returnflag <> 'R' AND l.l_orderkey % 3 = 0 THEN NULL ELSE o.o_custkey END
                   AS customer_id,
               CAST(o.o_orderdate AS DATE) AS sale_date,
               CAST(CAST(l.l_quantity AS DECIMAL(8,2)) + CAST(l.l_tax AS DECIMAL(4,2)) AS DECIMAL(8,2))
                   AS weight_kg,
               CAST(CAST((l.l_partkey % 6 + 1) * 100 + 50 AS DECIMAL(10,2))
                    * (1 - CAST(l.l_discount AS DECIMAL(4,2))) AS DECIMAL(10,2)) AS price_charged,
               CASE WHEN l.l_returnflag = 'R' THEN 'credit' ELSE 'cash' END AS payment_type,
               CASE WHEN l.l_linenumber = 7 THEN NULL WHEN l.l_discount = 0 THEN 'none'
                    WHEN l.l_discount < 0.04 THEN 'regular_customer'
                    WHEN l.l_discount < 0.08 THEN 'school_hotel' ELSE 'weekly_promo_day' END
                   AS discount_reason,
               l.l_shipdate AS created_at
        FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey
        JOIN customer c ON c.c_custkey = o.o_custkey""",
    "m_payments": """
        SELECT o_orderkey AS id, o_custkey AS customer_id, CAST(c_nationkey + 1 AS BIGINT) AS branch_id,
               CAST(o_orderdate AS DATE) AS payment_date,
               CAST(floor(o_totalprice / 10) + 1 AS DECIMAL(12,2)) AS amount, o_orderdate AS created_at
        FROM orders JOIN customer ON c_custkey = o_custkey""",
    "m_expenses": """
        SELECT event_id AS id, CAST(user_id % 25 + 1 AS BIGINT) AS branch_id,
               CAST(DATE '1995-01-01' + CAST(event_id % 2404 AS INTEGER) AS DATE) AS expense_date,
               event_type AS description,
               CAST(CAST(value AS DECIMAL(12,2)) * 100 AS DECIMAL(12,2)) AS amount, ts AS created_at
        FROM events""",
    "m_carcass_purchases": """
        SELECT id, branch_id, animal_type, CAST(received + 2 AS DECIMAL(8,2)) AS invoice_weight_kg,
               received AS received_weight_kg, cost, purchase_date, created_at
        FROM (
          SELECT o.o_orderkey AS id, CAST(1 AS BIGINT) AS branch_id,
                 CASE WHEN o.o_orderkey % 20 = 0 THEN 'beef' ELSE 'mutton' END AS animal_type,
                 CAST(CAST(coalesce(q.w, 100.0) AS DECIMAL(10,2))
                      * CASE WHEN o.o_orderkey % 50 = 0 THEN CAST(0.98 AS DECIMAL(3,2))
                             ELSE CAST(1.08 AS DECIMAL(3,2)) END AS DECIMAL(8,2)) AS received,
                 CAST(floor(o.o_totalprice) AS DECIMAL(12,2)) AS cost,
                 CAST(o.o_orderdate AS DATE) AS purchase_date, o.o_orderdate AS created_at
          FROM orders o
          LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS w FROM lineitem GROUP BY l_orderkey) q
            ON q.l_orderkey = o.o_orderkey)""",
    "m_breakdown_records": """
        SELECT id, carcass_purchase_id, product_id, CAST(out AS DECIMAL(8,2)) AS output_weight_kg,
               CAST(CAST(greatest(0, hundredths + (id % 9 - 4) * 100) AS DECIMAL(18,0))
                    * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(5,2)) AS expected_yield_pct,
               created_at
        FROM (
          SELECT per.l_orderkey * 10 + per.product_id AS id, per.l_orderkey AS carcass_purchase_id,
                 per.product_id, per.out, cp.created_at,
                 CAST(floor((CAST(per.out * 100 AS BIGINT) * 20000 + CAST(cp.received_weight_kg * 100 AS BIGINT))
                            / (CAST(cp.received_weight_kg * 100 AS BIGINT) * 2)) AS BIGINT) AS hundredths
          FROM (SELECT l_orderkey, CAST(l_partkey % 6 + 1 AS BIGINT) AS product_id, sum(l_quantity) AS out
                FROM lineitem GROUP BY 1, 2) per
          JOIN m_carcass_purchases cp ON cp.id = per.l_orderkey)""",
    "m_branch_transfers": """
        SELECT CAST('0x' || substr(md5(concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey)), 1, 15) AS BIGINT) AS id,
               l_orderkey * 10 + (l_partkey % 6 + 1) AS breakdown_record_id,
               CAST(l_suppkey % 25 + 1 AS BIGINT) AS to_branch_id,
               CAST(l_quantity AS DECIMAL(8,2)) AS weight_sent_kg,
               CAST(l_shipdate AS DATE) AS transfer_date, l_shipdate AS created_at
        FROM lineitem""",
    "m_sold_days": """
        SELECT branch_id, product_id, sale_date AS stock_date, sum(weight_kg) AS sold FROM m_sales GROUP BY ALL""",
    "m_stock_keys": """
        SELECT k.branch_id, k.product_id, k.stock_date, s.sold,
               (k.branch_id * 31 + k.product_id * 7 + day(k.stock_date)) % 20 AS h
        FROM (SELECT DISTINCT CAST(l_suppkey % 25 + 1 AS BIGINT) AS branch_id, CAST(l_partkey % 6 + 1 AS BIGINT) AS product_id,
                     CAST(l_shipdate AS DATE) AS stock_date FROM lineitem) k
        LEFT JOIN m_sold_days s USING (branch_id, product_id, stock_date)""",
    "m_daily_stock": """
        SELECT (branch_id * 10 + product_id) * 100000 + (stock_date - DATE '1970-01-01') AS id,
               branch_id, product_id, stock_date,
               CAST(CASE WHEN h = 19 THEN 0 ELSE 20 END AS DECIMAL(28,2)) AS opening_kg,
               CAST(CASE WHEN h = 19 THEN 0 ELSE coalesce(sold, 0) + 30 END AS DECIMAL(28,2)) AS received_kg,
               CAST(CASE WHEN h = 19 THEN 0 WHEN h < 10 THEN 50 WHEN h < 14 THEN 45 WHEN h < 17 THEN 20
                         ELSE 58 END AS DECIMAL(28,2)) AS closing_kg,
               CAST(stock_date + 1 AS TIMESTAMP) AS created_at
        FROM m_stock_keys""",
    "m_daily_stock_unfilled": """
        SELECT id, branch_id, product_id, stock_date,
               CASE WHEN (branch_id * 31 + product_id * 7 + day(stock_date)) % 20 % 2 = 0 THEN NULL
                    ELSE opening_kg END AS opening_kg, received_kg, closing_kg
        FROM m_daily_stock""",
    "m_counted_days": """
        SELECT id, branch_id, product_id, stock_date, closing_kg,
               (branch_id * 31 + product_id * 7 + day(stock_date)) % 20 AS h
        FROM (SELECT id, branch_id, product_id, stock_date, closing_kg FROM m_daily_stock
              UNION ALL
              SELECT (branch_id * 10 + product_id) * 100000 + (stock_date - DATE '1970-01-01'), branch_id, product_id, stock_date,
                     CAST(12.5 AS DECIMAL(28,2))
              FROM m_sold_days s
              WHERE NOT EXISTS (SELECT 1 FROM m_stock_keys k WHERE k.branch_id = s.branch_id AND k.product_id = s.product_id
                                                             AND k.stock_date = s.stock_date))""",
    "m_closing_counts": """
        SELECT id * 10 + 1 AS id, branch_id, product_id, stock_date, closing_kg,
               CAST(stock_date + CAST(h % 3 AS INTEGER) AS TIMESTAMP) + INTERVAL 23 HOUR AS created_at
        FROM m_counted_days
        UNION ALL
        SELECT id * 10 + 2, branch_id, product_id, stock_date, CAST(closing_kg + 1.5 AS DECIMAL(28,2)),
               CAST(stock_date + CAST(h % 3 AS INTEGER) AS TIMESTAMP) + INTERVAL 47 HOUR
        FROM m_counted_days WHERE h % 7 = 0""",
    "m_sale_drafts": """
        SELECT * REPLACE (CASE WHEN id % 7 = 6 THEN NULL ELSE price_charged END AS price_charged)
        FROM m_sales""",
    "m_raw_sales": """
        SELECT id, branch_id,
               CASE WHEN _t = 'product99' THEN 99 ELSE product_id END AS product_id,
               CASE WHEN _t = 'credit_nocust' THEN NULL ELSE customer_id END AS customer_id,
               sale_date,
               CAST(CASE WHEN _t = 'weight0' THEN 0 ELSE weight_kg END AS DECIMAL(8,2)) AS weight_kg,
               CAST(CASE WHEN _t = 'price_neg' THEN -1 WHEN _t = 'price0' THEN 0 ELSE price_charged END
                    AS DECIMAL(10,2)) AS price_charged,
               CASE WHEN _t = 'card' THEN 'card' WHEN _t = 'credit_nocust' THEN 'credit' ELSE payment_type END
                   AS payment_type,
               CASE WHEN _t = 'reason_other' THEN 'other' WHEN _t = 'reason_null' THEN NULL
                    ELSE discount_reason END AS discount_reason
        FROM (SELECT *, CASE WHEN id % 97 = 0 THEN 'weight0' WHEN id % 89 = 0 THEN 'card' WHEN id % 83 = 0 THEN 'credit_nocust' WHEN id % 79 = 0 THEN 'product99' WHEN id % 73 = 0 THEN 'price_neg' WHEN id % 71 = 0 THEN 'price0' WHEN id % 67 = 0 THEN 'reason_other' WHEN id % 61 = 0 THEN 'reason_null' ELSE 'clean' END AS _t FROM m_sales)""",
    "m_raw_closing_counts": """
        SELECT id, branch_id, product_id, stock_date,
               CASE WHEN _t = 'null' THEN NULL WHEN _t = 'neg' THEN '-1' WHEN _t = 'abc' THEN 'abc'
                    WHEN _t = 'zero' THEN '0' ELSE CAST(closing_kg AS VARCHAR) END AS closing_kg
        FROM (SELECT *, CASE WHEN id % 31 = 0 THEN 'null' WHEN id % 29 = 0 THEN 'neg' WHEN id % 23 = 0 THEN 'abc' WHEN id % 19 = 0 THEN 'zero' ELSE 'clean' END AS _t FROM m_daily_stock)""",
    "m_raw_carcass_purchases": """
        SELECT id, branch_id, CASE WHEN _t = 'goat' THEN 'goat' ELSE animal_type END AS animal_type,
               invoice_weight_kg,
               CAST(CASE WHEN _t = 'received0' THEN 0 ELSE received_weight_kg END AS DECIMAL(8,2))
                   AS received_weight_kg,
               CAST(CASE WHEN _t = 'cost0' THEN 0 WHEN _t = 'cost_null' THEN NULL ELSE cost END AS DECIMAL(12,2))
                   AS cost,
               purchase_date
        FROM (SELECT *, CASE WHEN id % 70 = 0 THEN 'goat' WHEN id % 90 = 0 THEN 'received0' WHEN id % 110 = 0 THEN 'cost0' WHEN id % 130 = 0 THEN 'cost_null' ELSE 'clean' END AS _t
              FROM m_carcass_purchases)""",
    "m_raw_breakdown_items": """
        SELECT carcass_purchase_id, pos, product_id,
               CASE WHEN carcass_purchase_id % 90 = 0 AND pos = 0 THEN CAST(-1 AS DECIMAL(8,2))
                    ELSE output_weight_kg END AS output_weight_kg, expected_yield_pct
        FROM (SELECT carcass_purchase_id, product_id, output_weight_kg, expected_yield_pct,
                     row_number() OVER (PARTITION BY carcass_purchase_id
                                        ORDER BY product_id, output_weight_kg, expected_yield_pct) - 1 AS pos
              FROM m_breakdown_records)
        WHERE carcass_purchase_id % 70 <> 0
        UNION ALL
        SELECT carcass_purchase_id, n AS pos, product_id, output_weight_kg, expected_yield_pct
        FROM (SELECT carcass_purchase_id, count(*) OVER (PARTITION BY carcass_purchase_id) AS n,
                     product_id, output_weight_kg, expected_yield_pct,
                     row_number() OVER (PARTITION BY carcass_purchase_id
                                        ORDER BY product_id, output_weight_kg, expected_yield_pct) AS rn
              FROM m_breakdown_records)
        WHERE rn = 1 AND carcass_purchase_id % 110 = 0 AND carcass_purchase_id % 70 <> 0
              AND carcass_purchase_id % 90 <> 0""",
    "m_raw_breakdown_posts": """
        SELECT carcass_purchase_id * 2 AS post_id, CASE WHEN carcass_purchase_id % 130 = 0 THEN NULL ELSE carcass_purchase_id END
                 AS carcass_purchase_id, pos, product_id, output_weight_kg, expected_yield_pct FROM m_raw_breakdown_items
        UNION ALL
        SELECT DISTINCT carcass_purchase_id * 2, CASE WHEN carcass_purchase_id % 130 = 0 THEN NULL ELSE carcass_purchase_id END,
               NULL, NULL, NULL, NULL
        FROM m_breakdown_records WHERE carcass_purchase_id % 70 = 0
        UNION ALL
        SELECT carcass_purchase_id * 2 + 1, carcass_purchase_id, 0, product_id, output_weight_kg, expected_yield_pct
        FROM m_breakdown_records WHERE carcass_purchase_id % 60 = 0
        QUALIFY row_number() OVER (PARTITION BY carcass_purchase_id ORDER BY product_id, output_weight_kg, expected_yield_pct) = 1""",
    "m_stored_breakdown_pairs": """
        SELECT carcass_purchase_id, min(product_id) AS product_id FROM m_breakdown_records
        WHERE carcass_purchase_id % 50 = 0 GROUP BY carcass_purchase_id""",
    "m_raw_branch_transfers": """
        SELECT id, CASE WHEN _t = 'record_null' THEN NULL ELSE breakdown_record_id END AS breakdown_record_id,
               CASE WHEN _t = 'branch99' THEN 99 ELSE to_branch_id END AS to_branch_id,
               CAST(CASE WHEN _t = 'weight0' THEN 0 ELSE weight_sent_kg END AS DECIMAL(8,2)) AS weight_sent_kg,
               transfer_date
        FROM (SELECT *, CASE WHEN id % 37 = 0 THEN 'weight0' WHEN id % 41 = 0 THEN 'branch99' WHEN id % 43 = 0 THEN 'record_null' ELSE 'clean' END AS _t FROM m_branch_transfers)""",
    "m_raw_payments": """
        SELECT id, customer_id, branch_id, payment_date,
               CAST(CASE WHEN _t = 'zero' THEN 0 WHEN _t = 'neg' THEN -5 ELSE amount END AS DECIMAL(12,2)) AS amount
        FROM (SELECT *, CASE WHEN id % 37 = 0 THEN 'zero' WHEN id % 41 = 0 THEN 'neg' ELSE 'clean' END AS _t FROM m_payments)""",
    "m_raw_expenses": """
        SELECT id, branch_id, expense_date, CASE WHEN _t = 'blank' THEN '' ELSE description END AS description,
               CAST(CASE WHEN _t = 'zero' THEN 0 WHEN _t = 'neg' THEN -5 ELSE amount END AS DECIMAL(12,2)) AS amount
        FROM (SELECT *, CASE WHEN id % 37 = 0 THEN 'zero' WHEN id % 41 = 0 THEN 'neg' WHEN id % 43 = 0 THEN 'blank' ELSE 'clean' END AS _t FROM m_expenses)""",
    "m_raw_customers": """
        SELECT id,
               CASE WHEN _t = 'name_null' THEN NULL WHEN _t = 'name_blank' THEN '   ' ELSE ' ' || name || ' ' END
                   AS name,
               CASE WHEN _t = 'company' THEN 'company' WHEN _t = 'type_null' THEN NULL ELSE customer_type END
                   AS customer_type,
               phone,
               CAST(CASE WHEN _t = 'limit0' THEN 0 WHEN _t = 'limit_null' THEN NULL ELSE credit_limit END
                    AS DECIMAL(12,2)) AS credit_limit
        FROM (SELECT *, CASE WHEN id % 37 = 0 THEN 'name_null' WHEN id % 41 = 0 THEN 'name_blank' WHEN id % 43 = 0 THEN 'company' WHEN id % 47 = 0 THEN 'limit0' WHEN id % 53 = 0 THEN 'limit_null' WHEN id % 59 = 0 THEN 'type_null' ELSE 'clean' END AS _t
              FROM m_customers)""",
    "m_notifications": """
        SELECT event_id AS id,
               CASE WHEN t = 'high_credit_balance' THEN NULL ELSE CAST(user_id % 25 + 1 AS BIGINT) END AS branch_id,
               CASE WHEN t = 'high_credit_balance' THEN CAST(user_id + 1 AS BIGINT) END AS customer_id,
               t AS alert_type, 'earlier alert ' || CAST(event_id AS VARCHAR) AS message, 'info' AS severity,
               event_id % 2 = 0 AS is_read,
               CAST(DATE '1995-01-01' + CAST(event_id % 2404 AS INTEGER) AS DATE) AS alert_date, ts AS created_at
        FROM (SELECT *, CASE WHEN event_type IN ('view', 'error') THEN 'high_variance'
                             WHEN event_type = 'click' THEN 'negative_profit'
                             WHEN event_type = 'purchase' THEN 'target_performance'
                             ELSE 'high_credit_balance' END AS t FROM events)""",
    "m_read_acks": """
        SELECT event_id AS id FROM events WHERE event_type = 'click'
        UNION ALL
        SELECT event_id + 1000000000 FROM events WHERE event_type = 'signup'""",
    "m_profit_targets": """
        SELECT CAST(branch_id * 1000 + (year(period_start) - 1995) * 12 + month(period_start) - 1 AS BIGINT) AS id,
               branch_id,
               CASE WHEN month(period_start) = 1 THEN 'daily' WHEN month(period_start) % 2 = 0 THEN 'weekly'
                    ELSE 'monthly' END AS period_type,
               period_start,
               CAST(CASE WHEN month(period_start) = 12 THEN 0 ELSE 150000 END AS DECIMAL(12,2)) AS target_amount
        FROM (SELECT branch_id, CAST(date_trunc('month', sale_date) AS DATE) AS period_start FROM m_sales
              UNION
              SELECT branch_id, CAST(date_trunc('month', expense_date) AS DATE) FROM m_expenses)""",
}


def with_fixtures(body: str, *ctes: tuple[str, str]) -> str:
    """Prefix a query body with every fixture CTE (DuckDB skips unused ones),
    then the query's own CTEs in order."""
    parts = [*FIXTURE_CTES.items(), *ctes]
    return "WITH " + ",\n".join(f"{name} AS ({sql}\n)" for name, sql in parts) + "\n" + body
