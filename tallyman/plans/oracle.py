"""Oracle SQL (DuckDB) for each registered query.

Written independently of the Spark operators, from the meaning of each report
(targets over a table of days, correlated lookups for the ledger), over the
stand-in tables of ``fixture_sql``. Decimals are computed exactly and cast to
DOUBLE at the very end; DuckDB divides decimals in DOUBLE, so ratios go
through ``CAST(… AS DECIMAL(26,10))`` before rounding.
"""

from __future__ import annotations

from tallyman.plans.fixture_sql import with_fixtures
from tallyman.sources.schemas import SCHEMAS

# Shared oracle views, from the meaning of each report: a day's takings and costs, a
# target's days, a stock day's sales.
V_TAKINGS = ("o_revenue", """
    SELECT branch_id, sale_date, sum(paid) AS revenue, sum(given) AS discount_given
    FROM (SELECT s.branch_id, s.sale_date, s.weight_kg * s.price_charged AS paid,
                 if(coalesce(s.discount_reason, 'none') = 'none', 0, s.weight_kg * (p.price_per_kg - s.price_charged)) AS given
          FROM m_products p, m_sales s WHERE s.product_id = p.id)
    GROUP BY ALL""")
V_COSTS = ("o_expense", """
    SELECT branch_id, expense_date AS sale_date, sum(amount) AS total_expenses FROM m_expenses GROUP BY ALL""")
V_DAY_PROFIT = ("o_profit", """
    WITH days AS (SELECT r.*, coalesce(e.total_expenses, 0) AS expenses FROM o_revenue r LEFT JOIN o_expense e USING (branch_id, sale_date))
    SELECT d.branch_id, b.name AS branch_name, d.sale_date AS report_date, d.revenue, d.discount_given, d.expenses,
           d.revenue - d.expenses AS gross_profit
    FROM days d INNER JOIN m_branches b ON d.branch_id = b.id""")
V_TARGET_DAYS = ("o_target_days", """
    SELECT id, unnest(generate_series(period_start, CASE period_type
             WHEN 'weekly' THEN period_start + INTERVAL 6 DAYS
             WHEN 'monthly' THEN last_day(period_start) + (day(period_start) - 1) * INTERVAL 1 DAY
             ELSE period_start END, INTERVAL 1 DAY))::DATE AS day
    FROM m_profit_targets""")
V_TARGETS = ("o_targets", """
    WITH reached AS (
      SELECT td.id, max(td.day) AS period_end, coalesce(sum(p.gross_profit), 0) AS actual_profit
      FROM o_target_days td JOIN m_profit_targets t USING (id)
      LEFT JOIN o_profit p ON p.branch_id = t.branch_id AND p.report_date = td.day
      GROUP BY td.id)
    SELECT t.id AS profit_target_id, t.branch_id, b.name AS branch_name, t.period_type, t.period_start, r.period_end,
           t.target_amount, r.actual_profit,
           CASE WHEN t.target_amount <> 0
                THEN round(CAST(r.actual_profit / t.target_amount * 100 AS DECIMAL(26,10)), 1) END AS pct_of_target
    FROM reached r JOIN m_profit_targets t USING (id) JOIN m_branches b ON b.id = t.branch_id""")
V_STOCK_DAY = ("o_variance", """
    WITH booked AS (
      SELECT d.*, d.opening_kg + d.received_kg AS available, coalesce(s.sold, 0) AS sold_kg
      FROM m_daily_stock d LEFT JOIN m_sold_days s USING (branch_id, product_id, stock_date)),
    missing AS (SELECT *, available - sold_kg - closing_kg AS variance_kg FROM booked)
    SELECT m.id AS daily_stock_id, m.branch_id, m.product_id, b.name AS branch_name, p.name AS product_name, m.stock_date,
           m.opening_kg, m.received_kg, m.sold_kg, m.closing_kg, m.variance_kg,
           CASE WHEN available <> 0 THEN round(CAST(CAST(variance_kg AS DOUBLE) / CAST(available AS DOUBLE) * 100 AS DECIMAL(26,10)), 2) END AS variance_pct
    FROM missing m JOIN m_products p ON p.id = m.product_id JOIN m_branches b ON b.id = m.branch_id""")
REPORT_VIEWS = (V_TAKINGS, V_COSTS, V_DAY_PROFIT, V_TARGET_DAYS, V_TARGETS, V_STOCK_DAY)

ORACLE: dict[str, str] = {}


def oracle(name: str, body: str, *ctes: tuple[str, str]) -> None:
    ORACLE[name] = with_fixtures(body, *REPORT_VIEWS, *ctes)


# 2.4 report views ---------------------------------------------------------
oracle("daily_stock_variance", """
    SELECT daily_stock_id, branch_id, product_id, branch_name, product_name, stock_date,
           opening_kg::DOUBLE AS opening_kg, received_kg::DOUBLE AS received_kg, sold_kg::DOUBLE AS sold_kg,
           closing_kg::DOUBLE AS closing_kg, variance_kg::DOUBLE AS variance_kg,
           variance_pct::DOUBLE AS variance_pct
    FROM o_variance""")
oracle("daily_revenue", """
    SELECT branch_id, sale_date, revenue::DOUBLE AS revenue, discount_given::DOUBLE AS discount_given
    FROM o_revenue""")
oracle("daily_expenses", """
    SELECT branch_id, sale_date, total_expenses::DOUBLE AS total_expenses FROM o_expense""")
oracle("daily_branch_profit", """
    SELECT branch_id, branch_name, report_date, revenue::DOUBLE AS revenue,
           discount_given::DOUBLE AS discount_given, expenses::DOUBLE AS expenses,
           gross_profit::DOUBLE AS gross_profit
    FROM o_profit""")
oracle("daily_branch_profit_full", """
    SELECT b.id AS branch_id, b.name AS branch_name, coalesce(r.sale_date, e.sale_date) AS report_date,
           coalesce(r.revenue, 0)::DOUBLE AS revenue, coalesce(r.discount_given, 0)::DOUBLE AS discount_given,
           coalesce(e.total_expenses, 0)::DOUBLE AS expenses,
           (coalesce(r.revenue, 0) - coalesce(e.total_expenses, 0))::DOUBLE AS gross_profit
    FROM o_revenue r FULL OUTER JOIN o_expense e ON e.branch_id = r.branch_id AND e.sale_date = r.sale_date
    JOIN m_branches b ON b.id = coalesce(r.branch_id, e.branch_id)""")
oracle("branch_target_progress", """
    SELECT profit_target_id, branch_id, branch_name, period_type, period_start, period_end,
           target_amount::DOUBLE AS target_amount, actual_profit::DOUBLE AS actual_profit,
           pct_of_target::DOUBLE AS pct_of_target
    FROM o_targets""")


# 2.6 customer credit ------------------------------------------------------
V_EVENTS = ("o_events", """
    SELECT customer_id, 0 AS kind, id AS event_id, sale_date AS event_date, created_at,
           round(weight_kg * price_charged, 2) AS delta
    FROM m_sales WHERE payment_type = 'credit' AND customer_id IS NOT NULL
    UNION ALL
    SELECT customer_id, 1, id, payment_date, created_at, -amount FROM m_payments""")
V_HISTORY = ("o_history", """
    SELECT e.*, c.name, c.credit_limit,
           sum(e.delta) OVER (PARTITION BY e.customer_id ORDER BY e.created_at, e.kind, e.event_id
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance_after
    FROM o_events e JOIN m_customers c ON c.id = e.customer_id""")
CREDIT_VIEWS = (V_EVENTS, V_HISTORY)
CREDIT_ALERT_COLS = """CAST(NULL AS BIGINT) AS branch_id, customer_id, 'high_credit_balance' AS alert_type,
           {msg} AS message, 'warning' AS severity, false AS is_read,
           CAST(created_at AS DATE) AS alert_date, kind AS event_kind, event_id,
           balance_after::DOUBLE AS balance_after"""

oracle("credit_charges", """
    SELECT id AS sale_id, customer_id, branch_id, product_id, sale_date, weight_kg::DOUBLE AS weight_kg,
           price_charged::DOUBLE AS price_charged, (weight_kg * price_charged)::DOUBLE AS amount, created_at
    FROM m_sales WHERE payment_type = 'credit' AND customer_id IS NOT NULL""")
oracle("payment_credits", """
    SELECT id AS payment_id, customer_id, branch_id, payment_date, (-amount)::DOUBLE AS amount, created_at
    FROM m_payments""")
oracle("customer_balances", """
    SELECT c.id AS customer_id, c.name, c.customer_type, c.credit_limit::DOUBLE AS credit_limit,
           coalesce((SELECT sum(e.delta) FROM o_events e WHERE e.customer_id = c.id), 0)::DOUBLE AS balance_owed
    FROM m_customers c""", *CREDIT_VIEWS)
oracle("credit_limit_crossings", "SELECT " + CREDIT_ALERT_COLS.format(
    msg="name || ' crossed their credit limit of ' || CAST(credit_limit AS VARCHAR) || ', now owes ' "
        "|| CAST(CAST(balance_after AS DECIMAL(38,2)) AS VARCHAR)") + """
    FROM o_history WHERE balance_after - delta <= credit_limit AND balance_after > credit_limit""",
       *CREDIT_VIEWS)
oracle("credit_over_limit_updates", "SELECT " + CREDIT_ALERT_COLS.format(
    msg="name || ' owes ' || CAST(CAST(balance_after AS DECIMAL(38,2)) AS VARCHAR) "
        "|| ', above their limit of ' || CAST(credit_limit AS VARCHAR)") + """
    FROM o_history WHERE balance_after > credit_limit""", *CREDIT_VIEWS)
oracle("customer_statement", """
    SELECT customer_id, entry_type, entry_id, entry_date, created_at, description, amount::DOUBLE AS amount,
           sum(amount) OVER (PARTITION BY customer_id ORDER BY entry_date, kind, created_at, entry_id
                             ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::DOUBLE AS running_balance
    FROM (
      SELECT s.customer_id, 'charge' AS entry_type, 0 AS kind, s.id AS entry_id, s.sale_date AS entry_date,
             s.created_at,
             p.name || ' — ' || CAST(s.weight_kg AS VARCHAR) || 'kg @ ' || CAST(s.price_charged AS VARCHAR)
               || ' (' || b.name || ')' AS description,
             s.weight_kg * s.price_charged AS amount
      FROM m_sales s JOIN m_branches b ON b.id = s.branch_id JOIN m_products p ON p.id = s.product_id
      WHERE s.payment_type = 'credit' AND s.customer_id IS NOT NULL
      UNION ALL
      SELECT customer_id, 'payment', 1, id, payment_date, created_at, 'Payment received', -amount
      FROM m_payments) l
    WHERE customer_id IN (SELECT id FROM m_customers)""")


# 2.5 stock ledger -----------------------------------------------------------
V_RECEIVED = ("o_received", """
    SELECT t.to_branch_id AS branch_id, br.product_id, t.transfer_date AS stock_date,
           sum(t.weight_sent_kg) AS received_in
    FROM m_branch_transfers t JOIN m_breakdown_records br ON br.id = t.breakdown_record_id
    GROUP BY 1, 2, 3""")
V_LASTCOUNT = ("o_lastcount", """
    SELECT branch_id, product_id, stock_date, arg_max(closing_kg, (created_at, id)) AS counted
    FROM m_closing_counts GROUP BY 1, 2, 3""")
STOCK_VIEWS = (V_RECEIVED, V_LASTCOUNT)
PREV_CLOSING = """(SELECT p.closing_kg FROM {tbl} p
        WHERE p.branch_id = d.branch_id AND p.product_id = d.product_id AND p.stock_date < d.stock_date
        ORDER BY p.stock_date DESC LIMIT 1)"""

oracle("opening_stock_fill", f"""
    SELECT d.id, d.branch_id, d.product_id, d.stock_date,
           coalesce(d.opening_kg, {PREV_CLOSING.format(tbl='m_daily_stock_unfilled')}, 0)::DOUBLE AS opening_kg,
           d.received_kg::DOUBLE AS received_kg, d.closing_kg::DOUBLE AS closing_kg,
           d.opening_kg IS NULL AS opening_filled
    FROM m_daily_stock_unfilled d""")
oracle("transfers_to_stock", f"""
    SELECT d.branch_id, d.product_id, d.stock_date,
           (CASE WHEN d.created THEN coalesce({PREV_CLOSING.format(tbl='o_merged')}, 0)
                 ELSE d.opening_kg END)::DOUBLE AS opening_kg,
           d.received_kg::DOUBLE AS received_kg, d.closing_kg::DOUBLE AS closing_kg, d.created
    FROM o_merged d""", *STOCK_VIEWS, ("o_merged", """
    SELECT coalesce(ds.branch_id, r.branch_id) AS branch_id, coalesce(ds.product_id, r.product_id) AS product_id,
           coalesce(ds.stock_date, r.stock_date) AS stock_date, ds.opening_kg,
           coalesce(ds.received_kg, 0) + coalesce(r.received_in, 0) AS received_kg,
           coalesce(ds.closing_kg, 0) AS closing_kg, ds.id IS NULL AS created
    FROM m_daily_stock ds FULL OUTER JOIN o_received r
      ON r.branch_id = ds.branch_id AND r.product_id = ds.product_id AND r.stock_date = ds.stock_date"""))
oracle("closing_count_upsert", f"""
    SELECT d.branch_id, d.product_id, d.stock_date,
           (CASE WHEN d.created THEN coalesce({PREV_CLOSING.format(tbl='o_merged')}, 0)
                 ELSE d.opening_kg END)::DOUBLE AS opening_kg,
           d.received_kg::DOUBLE AS received_kg, d.closing_kg::DOUBLE AS closing_kg, d.created
    FROM o_merged d""", *STOCK_VIEWS, ("o_merged", """
    SELECT coalesce(ds.branch_id, c.branch_id) AS branch_id, coalesce(ds.product_id, c.product_id) AS product_id,
           coalesce(ds.stock_date, c.stock_date) AS stock_date, ds.opening_kg,
           coalesce(ds.received_kg, 0) AS received_kg, coalesce(c.counted, ds.closing_kg) AS closing_kg,
           ds.id IS NULL AS created
    FROM m_daily_stock ds FULL OUTER JOIN o_lastcount c
      ON c.branch_id = ds.branch_id AND c.product_id = ds.product_id AND c.stock_date = ds.stock_date"""))
oracle("stock_ledger_build", f"""
    SELECT d.branch_id, d.product_id, d.stock_date,
           coalesce({PREV_CLOSING.format(tbl='o_ledger')}, 0)::DOUBLE AS opening_kg,
           d.received_kg::DOUBLE AS received_kg, d.closing_kg::DOUBLE AS closing_kg
    FROM o_ledger d""", *STOCK_VIEWS, ("o_ledger", """
    SELECT coalesce(r.branch_id, c.branch_id) AS branch_id, coalesce(r.product_id, c.product_id) AS product_id,
           coalesce(r.stock_date, c.stock_date) AS stock_date, coalesce(r.received_in, 0) AS received_kg,
           coalesce(c.counted, 0) AS closing_kg
    FROM o_received r FULL OUTER JOIN o_lastcount c
      ON c.branch_id = r.branch_id AND c.product_id = r.product_id AND c.stock_date = r.stock_date"""))
oracle("stock_ledger_replay", """
    SELECT k.branch_id, k.product_id, k.stock_date,
           coalesce((SELECT arg_max(e.closing_kg, e.seq) FROM o_ev e
                     WHERE e.kind = 1 AND e.branch_id = k.branch_id AND e.product_id = k.product_id
                       AND e.stock_date = k.prev_date AND e.seq < k.cseq), 0)::DOUBLE AS opening_kg,
           coalesce(r.received_in, 0)::DOUBLE AS received_kg,
           coalesce((SELECT arg_max(e.closing_kg, e.seq) FROM o_ev e
                     WHERE e.kind = 1 AND e.branch_id = k.branch_id AND e.product_id = k.product_id
                       AND e.stock_date = k.stock_date), 0)::DOUBLE AS closing_kg,
           k.created_at
    FROM o_keys k LEFT JOIN o_received r
      ON r.branch_id = k.branch_id AND r.product_id = k.product_id AND r.stock_date = k.stock_date""",
       *STOCK_VIEWS,
       ("o_ev", """
    SELECT *, row_number() OVER (PARTITION BY branch_id, product_id ORDER BY ts, kind, eid) AS seq FROM (
      SELECT t.to_branch_id AS branch_id, br.product_id, t.transfer_date AS stock_date, t.created_at AS ts,
             0 AS kind, t.id AS eid, CAST(NULL AS DECIMAL(8,2)) AS closing_kg
      FROM m_branch_transfers t JOIN m_breakdown_records br ON br.id = t.breakdown_record_id
      UNION ALL
      SELECT branch_id, product_id, stock_date, created_at, 1, id, closing_kg FROM m_closing_counts)"""),
       ("o_keys0", """
    SELECT branch_id, product_id, stock_date, min(seq) AS cseq, arg_min(ts, seq) AS created_at
    FROM o_ev GROUP BY 1, 2, 3"""),
       ("o_keys", """
    SELECT k.*, (SELECT max(k2.stock_date) FROM o_keys0 k2
                 WHERE k2.branch_id = k.branch_id AND k2.product_id = k.product_id
                   AND k2.stock_date < k.stock_date AND k2.cseq < k.cseq) AS prev_date
    FROM o_keys0 k"""))


# 2.7 alerts -------------------------------------------------------------------
RUN_DATE = "DATE '2001-08-01'"
A1 = """SELECT branch_id, CAST(NULL AS BIGINT) AS customer_id, 'high_variance' AS alert_type,
           branch_name || ': ' || product_name || ' variance is ' || CAST(variance_kg AS VARCHAR) || 'kg ('
             || CAST(CAST(variance_pct AS DECIMAL(18,2)) AS VARCHAR) || '%), above normal' AS message,
           CASE WHEN variance_pct > 15 THEN 'critical' ELSE 'warning' END AS severity, false AS is_read,
           stock_date AS alert_date
    FROM o_variance WHERE variance_pct > 5"""
A2 = """SELECT branch_id, CAST(NULL AS BIGINT) AS customer_id, 'negative_profit' AS alert_type,
           branch_name || ' made a loss of ' || CAST(abs(gross_profit) AS VARCHAR) || ' today' AS message,
           'critical' AS severity, false AS is_read, report_date AS alert_date
    FROM o_profit WHERE gross_profit < 0"""
A3 = f"""SELECT branch_id, CAST(NULL AS BIGINT) AS customer_id, 'target_performance' AS alert_type,
           branch_name || ' is at ' || CAST(CAST(pct_of_target AS DECIMAL(18,1)) AS VARCHAR) || '% of its '
             || period_type || ' target' AS message,
           'warning' AS severity, false AS is_read, {RUN_DATE} AS alert_date
    FROM o_targets WHERE pct_of_target < 80"""
C5 = """SELECT CAST(NULL AS BIGINT) AS branch_id, customer_id, 'high_credit_balance' AS alert_type,
           name || ' crossed their credit limit of ' || CAST(credit_limit AS VARCHAR) || ', now owes '
             || CAST(CAST(balance_after AS DECIMAL(38,2)) AS VARCHAR) AS message,
           'warning' AS severity, false AS is_read, CAST(created_at AS DATE) AS alert_date
    FROM o_history WHERE balance_after - delta <= credit_limit AND balance_after > credit_limit"""

oracle("variance_alerts", A1)
oracle("profit_alerts", A2)
oracle("target_alerts", A3)
oracle("alert_feed", f"{A1}\n UNION ALL {A2}\n UNION ALL {A3}\n UNION ALL {C5}", *CREDIT_VIEWS)
oracle("regenerate_alerts", f"""
    SELECT branch_id, customer_id, alert_type, message, severity, is_read, alert_date
    FROM m_notifications n ANTI JOIN (
      SELECT DISTINCT 'high_variance' AS alert_type, stock_date AS alert_date FROM m_daily_stock
      UNION ALL SELECT DISTINCT 'negative_profit', report_date FROM o_profit
      UNION ALL SELECT 'target_performance', {RUN_DATE}) checked USING (alert_type, alert_date)
    UNION ALL {A1}
    UNION ALL {A2}
    UNION ALL {A3}""")
oracle("mark_read", """
    SELECT id, branch_id, customer_id, alert_type, message, severity, alert_date,
           is_read OR id IN (SELECT id FROM m_read_acks) AS is_read
    FROM m_notifications""")
oracle("mark_read_not_found", """
    SELECT DISTINCT id FROM m_read_acks WHERE id NOT IN (SELECT id FROM m_notifications)""")


# 2.8 yield and allocation -------------------------------------------------------
oracle("breakdown_yield", """
    SELECT breakdown_record_id, carcass_purchase_id, product_id, product_name, output_weight_kg::DOUBLE AS output_weight_kg,
           expected_yield_pct::DOUBLE AS expected_yield_pct, actual_pct,
           output_weight_kg <> 0 AND abs(actual_pct - CAST(expected_yield_pct AS DOUBLE)) > 3 AS flagged
    FROM (
      SELECT br.id AS breakdown_record_id, br.carcass_purchase_id, br.product_id, p.name AS product_name,
             br.output_weight_kg, br.expected_yield_pct,
             CASE WHEN cp.received_weight_kg <> 0
                  THEN CAST(br.output_weight_kg AS DOUBLE) / CAST(cp.received_weight_kg AS DOUBLE) * 100
                  ELSE 0.0 END AS actual_pct
      FROM m_breakdown_records br JOIN m_carcass_purchases cp ON cp.id = br.carcass_purchase_id
      JOIN m_products p ON p.id = br.product_id)""")
oracle("breakdown_loss", """
    SELECT cp.id AS carcass_purchase_id, cp.received_weight_kg::DOUBLE AS received_weight_kg,
           coalesce(sum(br.output_weight_kg), 0)::DOUBLE AS total_output_kg,
           (cp.received_weight_kg - coalesce(sum(br.output_weight_kg), 0))::DOUBLE AS loss_kg,
           CASE WHEN cp.received_weight_kg > 0
                THEN CAST(cp.received_weight_kg - coalesce(sum(br.output_weight_kg), 0) AS DOUBLE)
                     / CAST(cp.received_weight_kg AS DOUBLE) * 100 END AS loss_pct
    FROM m_carcass_purchases cp LEFT JOIN m_breakdown_records br ON br.carcass_purchase_id = cp.id
    GROUP BY cp.id, cp.received_weight_kg""")
oracle("allocation_matrix", """
    SELECT br.id AS breakdown_record_id, br.product_id, br.output_weight_kg::DOUBLE AS output_weight_kg,
           s.to_branch_id, s.sent_kg::DOUBLE AS sent_kg,
           coalesce(sum(s.sent_kg) OVER (PARTITION BY br.id), 0)::DOUBLE AS total_sent_kg,
           coalesce(sum(s.sent_kg) OVER (PARTITION BY br.id), 0) > br.output_weight_kg AS over_allocated
    FROM m_breakdown_records br
    LEFT JOIN (SELECT breakdown_record_id, to_branch_id, sum(weight_sent_kg) AS sent_kg
               FROM m_branch_transfers GROUP BY 1, 2) s ON s.breakdown_record_id = br.id""")
oracle("allocation_requests", """
    SELECT c.l_orderkey AS carcass_purchase_id, c.record_id AS breakdown_record_id, c.branch_id AS to_branch_id,
           c.weight::DOUBLE AS weight_sent_kg, cp.purchase_date AS transfer_date
    FROM (SELECT l_orderkey, l_orderkey * 10 + (l_partkey % 6 + 1) AS record_id,
                 CAST(l_suppkey % 25 + 1 AS BIGINT) AS branch_id,
                 CASE WHEN min(l_discount) = 0 THEN 0 ELSE CAST(sum(l_quantity) AS DECIMAL(8,2)) END AS weight
          FROM lineitem GROUP BY 1, 2, 3) c
    JOIN m_carcass_purchases cp ON cp.id = c.l_orderkey
    WHERE c.weight > 0""")
oracle("breakdown_item_requests", """
    SELECT l_orderkey AS carcass_purchase_id, product_id, CAST(q AS DECIMAL(8,2))::DOUBLE AS output_weight_kg,
           (CASE WHEN tax = 0 THEN 0 ELSE CAST(tax * 100 AS DECIMAL(5,1)) END)::DOUBLE AS expected_yield_pct
    FROM (SELECT l_orderkey, CAST(l_partkey % 6 + 1 AS BIGINT) AS product_id, sum(l_quantity) AS q,
                 min(l_tax) AS tax
          FROM lineitem GROUP BY 1, 2)
    WHERE l_orderkey % 97 <> 0""")
oracle("breakdown_form_rejects", """
    SELECT DISTINCT l_orderkey AS carcass_purchase_id, 'no_items' AS reject_reason
    FROM lineitem WHERE l_orderkey % 97 = 0""")


# 2.3 listings -------------------------------------------------------------------
oracle("list_branches", """
    SELECT id, name, is_main, row_number() OVER (ORDER BY is_main DESC, name, id) AS position FROM m_branches""")
oracle("list_products", """
    SELECT id, name, price_per_kg::DOUBLE AS price_per_kg, is_byproduct,
           row_number() OVER (ORDER BY is_byproduct, name, id) AS position FROM m_products""")
oracle("list_daily_stock", """
    SELECT ds.* REPLACE (ds.opening_kg::DOUBLE AS opening_kg, ds.received_kg::DOUBLE AS received_kg,
                         ds.closing_kg::DOUBLE AS closing_kg),
           b.name AS branch_name, p.name AS product_name
    FROM m_daily_stock ds JOIN m_branches b ON b.id = ds.branch_id JOIN m_products p ON p.id = ds.product_id""")
oracle("list_sales", """
    SELECT s.* REPLACE (s.weight_kg::DOUBLE AS weight_kg, s.price_charged::DOUBLE AS price_charged),
           b.name AS branch_name, p.name AS product_name, c.name AS customer_name, c.customer_type
    FROM m_sales s JOIN m_branches b ON b.id = s.branch_id JOIN m_products p ON p.id = s.product_id
    LEFT JOIN m_customers c ON c.id = s.customer_id""")
oracle("list_carcass_purchases", """
    SELECT cp.* REPLACE (cp.invoice_weight_kg::DOUBLE AS invoice_weight_kg,
                         cp.received_weight_kg::DOUBLE AS received_weight_kg, cp.cost::DOUBLE AS cost),
           b.name AS branch_name
    FROM m_carcass_purchases cp JOIN m_branches b ON b.id = cp.branch_id""")
oracle("list_breakdown_records", """
    SELECT br.* REPLACE (br.output_weight_kg::DOUBLE AS output_weight_kg,
                         br.expected_yield_pct::DOUBLE AS expected_yield_pct),
           p.name AS product_name
    FROM m_breakdown_records br JOIN m_products p ON p.id = br.product_id""")
oracle("list_branch_transfers", """
    SELECT bt.* REPLACE (bt.weight_sent_kg::DOUBLE AS weight_sent_kg), b.name AS to_branch_name
    FROM m_branch_transfers bt JOIN m_branches b ON b.id = bt.to_branch_id""")
oracle("list_payments", """
    SELECT p.* REPLACE (p.amount::DOUBLE AS amount), c.name AS customer_name
    FROM m_payments p JOIN m_customers c ON c.id = p.customer_id""")
oracle("list_expenses", """
    SELECT e.* REPLACE (e.amount::DOUBLE AS amount), b.name AS branch_name
    FROM m_expenses e JOIN m_branches b ON b.id = e.branch_id""")
oracle("list_customers", """
    SELECT c.id AS customer_id, c.name, c.customer_type, c.credit_limit::DOUBLE AS credit_limit,
           coalesce(x.total, 0)::DOUBLE AS balance_owed, coalesce(x.total, 0) > c.credit_limit AS over_limit
    FROM m_customers c LEFT JOIN (SELECT customer_id, sum(delta) AS total FROM o_events GROUP BY 1) x
      ON x.customer_id = c.id""", *CREDIT_VIEWS)
oracle("list_notifications", """
    SELECT n.*, b.name AS branch_name, c.name AS customer_name
    FROM m_notifications n LEFT JOIN m_branches b ON b.id = n.branch_id
    LEFT JOIN m_customers c ON c.id = n.customer_id""")

# 2.4 reports (R4–R6) ----------------------------------------------------------
oracle("branch_report", """
    SELECT s.branch_id, b.name AS branch_name, s.report_date, p.revenue::DOUBLE AS revenue,
           p.discount_given::DOUBLE AS discount_given, p.expenses::DOUBLE AS expenses,
           p.gross_profit::DOUBLE AS gross_profit,
           coalesce(v.n, 0) AS n_variance, coalesce(v.items, '') AS variance_items,
           coalesce(tg.n, 0) AS n_targets, coalesce(tg.items, '') AS target_items
    FROM (SELECT branch_id, report_date FROM o_profit UNION SELECT branch_id, stock_date FROM o_variance) s
    JOIN m_branches b ON b.id = s.branch_id
    LEFT JOIN o_profit p ON p.branch_id = s.branch_id AND p.report_date = s.report_date
    LEFT JOIN (SELECT branch_id, stock_date, count(*) AS n,
                      string_agg(product_name || '=' || CAST(variance_kg AS VARCHAR) || '/'
                                 || coalesce(CAST(variance_pct AS VARCHAR), 'null'), '; '
                                 ORDER BY product_name, daily_stock_id) AS items
               FROM o_variance GROUP BY 1, 2) v ON v.branch_id = s.branch_id AND v.stock_date = s.report_date
    LEFT JOIN (SELECT branch_id, count(*) AS n,
                      string_agg(period_type || '@' || CAST(period_start AS VARCHAR) || '='
                                 || coalesce(CAST(pct_of_target AS VARCHAR), 'null'), '; '
                                 ORDER BY period_start DESC, period_type DESC, profit_target_id DESC) AS items
               FROM o_targets GROUP BY 1) tg ON tg.branch_id = s.branch_id""")
oracle("branch_comparison", """
    SELECT branch_id, branch_name, period_type, period_start, target_amount::DOUBLE AS target_amount,
           actual_profit::DOUBLE AS actual_profit, pct_of_target::DOUBLE AS pct_of_target,
           row_number() OVER (ORDER BY period_start DESC, pct_of_target DESC NULLS FIRST, branch_id, period_type)
             AS position
    FROM o_targets""")
oracle("latest_target_comparison", """
    SELECT profit_target_id, branch_id, branch_name, period_type, period_start, period_end,
           target_amount::DOUBLE AS target_amount, actual_profit::DOUBLE AS actual_profit,
           pct_of_target::DOUBLE AS pct_of_target
    FROM o_targets
    QUALIFY row_number() OVER (PARTITION BY branch_id, period_type ORDER BY period_start DESC) = 1""")

# 2.9 dashboard ----------------------------------------------------------------
oracle("sales_day_total", """
    SELECT id, branch_id, sale_date, product_id, weight_kg::DOUBLE AS weight_kg,
           price_charged::DOUBLE AS price_charged, (weight_kg * price_charged)::DOUBLE AS amount,
           (sum(weight_kg * price_charged) OVER (PARTITION BY branch_id, sale_date))::DOUBLE AS day_total
    FROM m_sales""")
oracle("expense_day_total", """
    SELECT id, branch_id, expense_date, description, amount::DOUBLE AS amount,
           (sum(amount) OVER (PARTITION BY branch_id, expense_date))::DOUBLE AS day_total
    FROM m_expenses""")
oracle("target_progress_bar", """
    SELECT profit_target_id, branch_id, period_type, period_start, pct_of_target::DOUBLE AS pct_of_target,
           least(coalesce(pct_of_target, 0), 100)::DOUBLE AS bar_pct, coalesce(pct_of_target, 0) >= 100 AS over_target
    FROM o_targets""")
oracle("variance_flags", """
    SELECT daily_stock_id, branch_id, product_id, stock_date, variance_kg::DOUBLE AS variance_kg,
           variance_pct::DOUBLE AS variance_pct, abs(coalesce(variance_pct, 0)) > 5 AS flagged
    FROM o_variance""")
oracle("closing_sheet", """
    SELECT s.branch_id, s.stock_date, p.id AS product_id, p.name AS product_name,
           ds.closing_kg::DOUBLE AS closing_kg, ds.closing_kg IS NOT NULL AS entered
    FROM (SELECT DISTINCT branch_id, stock_date FROM m_daily_stock) s CROSS JOIN m_products p
    LEFT JOIN m_daily_stock ds ON ds.branch_id = s.branch_id AND ds.stock_date = s.stock_date
                              AND ds.product_id = p.id""")
oracle("default_branch", """
    SELECT id, name, is_main FROM m_branches ORDER BY is_main DESC, name, id LIMIT 1""")
oracle("default_price_fill", """
    SELECT s.id, s.branch_id, s.product_id, s.sale_date, s.weight_kg::DOUBLE AS weight_kg,
           coalesce(s.price_charged, p.price_per_kg)::DOUBLE AS price_charged, s.price_charged IS NULL AS price_filled
    FROM m_sale_drafts s LEFT JOIN m_products p ON p.id = s.product_id""")

# 2.10 row scope -----------------------------------------------------------------
oracle("branch_scope", """
    SELECT s.id AS row_id, s.branch_id,
           (SELECT count(*) FROM m_users u WHERE u.role = 'attendant' AND u.branch_id = s.branch_id) AS n_attendants,
           (SELECT min(u.id) FROM m_users u WHERE u.role = 'attendant' AND u.branch_id = s.branch_id) AS first_attendant_id,
           EXISTS (SELECT 1 FROM m_users u WHERE u.role = 'admin') AS admin_sees
    FROM m_sales s""")


# 2.2 ingest validation --------------------------------------------------------------
oracle("validate_sales", """
    SELECT id, branch_id, product_id, cust AS customer_id, sale_date, weight_kg::DOUBLE AS weight_kg,
           price_charged::DOUBLE AS price_charged, payment_type, reason AS discount_reason,
           CASE WHEN coalesce(branch_id, 0) = 0 OR coalesce(product_id, 0) = 0 OR sale_date IS NULL
                     OR coalesce(weight_kg, 0) = 0 OR price_charged IS NULL OR coalesce(payment_type, '') = ''
                  THEN 'missing_required'
                WHEN payment_type NOT IN ('cash', 'credit') THEN 'bad_payment_type'
                WHEN payment_type = 'credit' AND cust IS NULL THEN 'credit_needs_customer'
                WHEN weight_kg <= 0 OR price_charged < 0 THEN 'bad_weight_or_price'
                WHEN reason NOT IN ('none', 'regular_customer', 'school_hotel', 'weekly_promo_day')
                  THEN 'bad_discount_reason'
                WHEN branch_id NOT IN (SELECT id FROM m_branches) THEN 'unknown_branch'
                WHEN product_id NOT IN (SELECT id FROM m_products) THEN 'unknown_product'
                WHEN cust IS NOT NULL AND cust NOT IN (SELECT id FROM m_customers) THEN 'unknown_customer'
           END AS reject_reason
    FROM (SELECT *, CASE WHEN customer_id = 0 THEN NULL ELSE customer_id END AS cust,
                 CASE WHEN coalesce(discount_reason, '') = '' THEN 'none' ELSE discount_reason END AS reason
          FROM m_raw_sales)""")
oracle("validate_closing_counts", """
    SELECT id, branch_id, product_id, stock_date, num::DOUBLE AS closing_kg,
           CASE WHEN coalesce(branch_id, 0) = 0 OR coalesce(product_id, 0) = 0 OR stock_date IS NULL
                  THEN 'missing_required'
                WHEN closing_kg IS NOT NULL AND (num IS NULL OR num < 0) THEN 'bad_closing'
                WHEN closing_kg IS NULL THEN 'closing_null'
                WHEN branch_id NOT IN (SELECT id FROM m_branches) THEN 'unknown_branch'
                WHEN product_id NOT IN (SELECT id FROM m_products) THEN 'unknown_product'
           END AS reject_reason
    FROM (SELECT *, TRY_CAST(trim(closing_kg) AS DECIMAL(8,2)) AS num FROM m_raw_closing_counts)""")
oracle("validate_carcass_purchases", """
    SELECT id, branch_id, animal_type, invoice_weight_kg::DOUBLE AS invoice_weight_kg,
           received_weight_kg::DOUBLE AS received_weight_kg, cost::DOUBLE AS cost, purchase_date,
           CASE WHEN coalesce(branch_id, 0) = 0 OR coalesce(animal_type, '') = '' OR coalesce(invoice_weight_kg, 0) = 0
                     OR coalesce(received_weight_kg, 0) = 0 OR cost IS NULL OR purchase_date IS NULL
                  THEN 'missing_required'
                WHEN animal_type NOT IN ('beef', 'mutton') THEN 'bad_animal_type'
                WHEN invoice_weight_kg <= 0 OR received_weight_kg <= 0 OR cost < 0 THEN 'bad_weight_or_cost'
                WHEN branch_id NOT IN (SELECT id FROM m_branches) THEN 'unknown_branch'
           END AS reject_reason
    FROM m_raw_carcass_purchases""")
oracle("validate_breakdown_batches", """
    SELECT i.post_id, i.carcass_purchase_id, i.pos, i.product_id, i.output_weight_kg::DOUBLE AS output_weight_kg,
           i.expected_yield_pct::DOUBLE AS expected_yield_pct,
           coalesce(p.alone, CASE WHEN EXISTS (
             SELECT 1 FROM o_posts e JOIN o_items x ON x.post_id = e.post_id
             JOIN o_items y ON y.post_id = p.post_id AND y.product_id = x.product_id
             WHERE e.alone IS NULL AND e.carcass_purchase_id = p.carcass_purchase_id AND e.post_id < p.post_id)
             THEN 'duplicate_product' END) AS reject_reason
    FROM o_items i JOIN o_posts p ON p.post_id = i.post_id""",
       ("o_items", """
    SELECT *,
           CASE WHEN pos IS NULL THEN NULL
                WHEN coalesce(product_id, 0) = 0 OR output_weight_kg IS NULL OR expected_yield_pct IS NULL
                  THEN 'bad_item'
                WHEN output_weight_kg < 0 THEN 'negative_output' END AS api,
           CASE WHEN pos IS NULL THEN NULL
                WHEN expected_yield_pct < 0 THEN 'negative_expected'
                WHEN carcass_purchase_id NOT IN (SELECT id FROM m_carcass_purchases) THEN 'unknown_carcass'
                WHEN product_id NOT IN (SELECT id FROM m_products) THEN 'unknown_product'
                WHEN row_number() OVER (PARTITION BY post_id, product_id ORDER BY pos) > 1 THEN 'duplicate_product'
                WHEN EXISTS (SELECT 1 FROM m_stored_breakdown_pairs s
                             WHERE s.carcass_purchase_id = i.carcass_purchase_id AND s.product_id = i.product_id)
                  THEN 'duplicate_product' END AS db
    FROM m_raw_breakdown_posts i"""), ("o_posts", """
    SELECT post_id, any_value(carcass_purchase_id) AS carcass_purchase_id,
           coalesce(max(CASE WHEN pos IS NULL OR coalesce(carcass_purchase_id, 0) = 0 THEN 'missing_required' END),
                    arg_min(api, pos) FILTER (WHERE api IS NOT NULL),
                    arg_min(db, pos) FILTER (WHERE db IS NOT NULL)) AS alone
    FROM o_items GROUP BY post_id"""))
oracle("validate_branch_transfers", """
    SELECT id, breakdown_record_id, to_branch_id, weight_sent_kg::DOUBLE AS weight_sent_kg, transfer_date,
           CASE WHEN coalesce(breakdown_record_id, 0) = 0 OR coalesce(to_branch_id, 0) = 0
                     OR coalesce(weight_sent_kg, 0) = 0 OR transfer_date IS NULL THEN 'missing_required'
                WHEN weight_sent_kg <= 0 THEN 'bad_weight'
                WHEN breakdown_record_id NOT IN (SELECT id FROM m_breakdown_records) THEN 'unknown_breakdown_record'
                WHEN to_branch_id NOT IN (SELECT id FROM m_branches) THEN 'unknown_branch'
           END AS reject_reason
    FROM m_raw_branch_transfers""")
oracle("validate_payments", """
    SELECT id, customer_id, branch_id, payment_date, amount::DOUBLE AS amount,
           CASE WHEN coalesce(customer_id, 0) = 0 OR coalesce(branch_id, 0) = 0 OR payment_date IS NULL
                     OR coalesce(amount, 0) = 0 THEN 'missing_required'
                WHEN amount <= 0 THEN 'bad_amount'
                WHEN customer_id NOT IN (SELECT id FROM m_customers) THEN 'unknown_customer'
                WHEN branch_id NOT IN (SELECT id FROM m_branches) THEN 'unknown_branch'
           END AS reject_reason
    FROM m_raw_payments""")
oracle("validate_expenses", """
    SELECT id, branch_id, expense_date, description, amount::DOUBLE AS amount,
           CASE WHEN coalesce(branch_id, 0) = 0 OR expense_date IS NULL OR coalesce(description, '') = ''
                     OR amount IS NULL THEN 'missing_required'
                WHEN amount < 0 THEN 'bad_amount'
                WHEN branch_id NOT IN (SELECT id FROM m_branches) THEN 'unknown_branch'
           END AS reject_reason
    FROM m_raw_expenses""")
oracle("validate_customers", """
    SELECT id, trim(name) AS name, ctype AS customer_type, CASE WHEN phone = '' THEN NULL ELSE phone END AS phone,
           CAST(coalesce(nullif(credit_limit, 0), 3000) AS DECIMAL(12,2))::DOUBLE AS credit_limit,
           CASE WHEN coalesce(trim(name), '') = '' THEN 'missing_name'
                WHEN ctype NOT IN ('individual', 'school', 'hotel') THEN 'bad_customer_type' END AS reject_reason
    FROM (SELECT *, CASE WHEN coalesce(customer_type, '') = '' THEN 'individual' ELSE customer_type END AS ctype
          FROM m_raw_customers)""")

def _key_rules() -> str:
    """Uniqueness of usernames, NOT NULL columns and primary keys of every stored table."""
    unique = ("    UNION ALL SELECT '{0}', 'unique({1})', CAST(coalesce(sum(n), 0) AS BIGINT) "
              "FROM (SELECT count(*) AS n FROM m_{0} GROUP BY {1} HAVING count(*) > 1)")
    out = [unique.format("users", "username")]
    for table, schema in SCHEMAS.items():
        if table == "closing_counts":
            continue
        needed = [f.name for f in schema.fields if not f.nullable]
        out += [f"    UNION ALL SELECT '{table}', '{c} not null', CAST(count(*) - count({c}) AS BIGINT) FROM m_{table}" for c in needed]
        if "id" in needed:
            out.append(unique.format(table, "id"))
    return "\n".join(out)


oracle("constraint_report", """
    SELECT * FROM (
    SELECT 'branches', 'unique(name)', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM m_branches GROUP BY name HAVING count(*) > 1)
    UNION ALL SELECT 'branches', 'at most one main branch', CAST(CASE WHEN count(*) FILTER (WHERE is_main) <= 1 THEN 0 ELSE count(*) FILTER (WHERE is_main) END AS BIGINT) FROM m_branches
    UNION ALL SELECT 'products', 'unique(name)', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM m_products GROUP BY name HAVING count(*) > 1)
    UNION ALL SELECT 'products' AS table_name, 'price_per_kg >= 0' AS rule, CAST(count(*) FILTER (WHERE NOT (price_per_kg >= 0)) AS BIGINT) AS bad_rows FROM m_products
    UNION ALL SELECT 'customers' AS table_name, 'customer_type in domain' AS rule, CAST(count(*) FILTER (WHERE NOT (customer_type IN ('individual','school','hotel'))) AS BIGINT) AS bad_rows FROM m_customers
    UNION ALL SELECT 'carcass_purchases' AS table_name, 'animal_type in domain' AS rule, CAST(count(*) FILTER (WHERE NOT (animal_type IN ('beef','mutton'))) AS BIGINT) AS bad_rows FROM m_carcass_purchases
    UNION ALL SELECT 'carcass_purchases' AS table_name, 'invoice_weight_kg > 0' AS rule, CAST(count(*) FILTER (WHERE NOT (invoice_weight_kg > 0)) AS BIGINT) AS bad_rows FROM m_carcass_purchases
    UNION ALL SELECT 'carcass_purchases' AS table_name, 'received_weight_kg > 0' AS rule, CAST(count(*) FILTER (WHERE NOT (received_weight_kg > 0)) AS BIGINT) AS bad_rows FROM m_carcass_purchases
    UNION ALL SELECT 'carcass_purchases' AS table_name, 'cost >= 0' AS rule, CAST(count(*) FILTER (WHERE NOT (cost >= 0)) AS BIGINT) AS bad_rows FROM m_carcass_purchases
    UNION ALL SELECT 'carcass_purchases', 'branch_id -> branches', CAST(count(*) AS BIGINT) FROM m_carcass_purchases WHERE branch_id IS NOT NULL AND branch_id NOT IN (SELECT id FROM m_branches)
    UNION ALL SELECT 'breakdown_records', 'unique(carcass_purchase_id, product_id)', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM m_breakdown_records GROUP BY carcass_purchase_id, product_id HAVING count(*) > 1)
    UNION ALL SELECT 'breakdown_records' AS table_name, 'output_weight_kg >= 0' AS rule, CAST(count(*) FILTER (WHERE NOT (output_weight_kg >= 0)) AS BIGINT) AS bad_rows FROM m_breakdown_records
    UNION ALL SELECT 'breakdown_records' AS table_name, 'expected_yield_pct >= 0' AS rule, CAST(count(*) FILTER (WHERE NOT (expected_yield_pct >= 0)) AS BIGINT) AS bad_rows FROM m_breakdown_records
    UNION ALL SELECT 'breakdown_records', 'carcass_purchase_id -> carcass_purchases', CAST(count(*) AS BIGINT) FROM m_breakdown_records WHERE carcass_purchase_id IS NOT NULL AND carcass_purchase_id NOT IN (SELECT id FROM m_carcass_purchases)
    UNION ALL SELECT 'breakdown_records', 'product_id -> products', CAST(count(*) AS BIGINT) FROM m_breakdown_records WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM m_products)
    UNION ALL SELECT 'branch_transfers' AS table_name, 'weight_sent_kg >= 0' AS rule, CAST(count(*) FILTER (WHERE NOT (weight_sent_kg >= 0)) AS BIGINT) AS bad_rows FROM m_branch_transfers
    UNION ALL SELECT 'branch_transfers', 'breakdown_record_id -> breakdown_records', CAST(count(*) AS BIGINT) FROM m_branch_transfers WHERE breakdown_record_id IS NOT NULL AND breakdown_record_id NOT IN (SELECT id FROM m_breakdown_records)
    UNION ALL SELECT 'branch_transfers', 'to_branch_id -> branches', CAST(count(*) AS BIGINT) FROM m_branch_transfers WHERE to_branch_id IS NOT NULL AND to_branch_id NOT IN (SELECT id FROM m_branches)
    UNION ALL SELECT 'daily_stock', 'unique(branch_id, product_id, stock_date)', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM m_daily_stock GROUP BY branch_id, product_id, stock_date HAVING count(*) > 1)
    UNION ALL SELECT 'daily_stock', 'branch_id -> branches', CAST(count(*) AS BIGINT) FROM m_daily_stock WHERE branch_id IS NOT NULL AND branch_id NOT IN (SELECT id FROM m_branches)
    UNION ALL SELECT 'daily_stock', 'product_id -> products', CAST(count(*) AS BIGINT) FROM m_daily_stock WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM m_products)
    UNION ALL SELECT 'sales' AS table_name, 'weight_kg > 0' AS rule, CAST(count(*) FILTER (WHERE NOT (weight_kg > 0)) AS BIGINT) AS bad_rows FROM m_sales
    UNION ALL SELECT 'sales' AS table_name, 'price_charged >= 0' AS rule, CAST(count(*) FILTER (WHERE NOT (price_charged >= 0)) AS BIGINT) AS bad_rows FROM m_sales
    UNION ALL SELECT 'sales' AS table_name, 'payment_type in domain' AS rule, CAST(count(*) FILTER (WHERE NOT (payment_type IN ('cash','credit'))) AS BIGINT) AS bad_rows FROM m_sales
    UNION ALL SELECT 'sales' AS table_name, 'discount_reason in domain' AS rule, CAST(count(*) FILTER (WHERE NOT (discount_reason IN ('none','regular_customer','school_hotel','weekly_promo_day'))) AS BIGINT) AS bad_rows FROM m_sales
    UNION ALL SELECT 'sales', 'branch_id -> branches', CAST(count(*) AS BIGINT) FROM m_sales WHERE branch_id IS NOT NULL AND branch_id NOT IN (SELECT id FROM m_branches)
    UNION ALL SELECT 'sales', 'product_id -> products', CAST(count(*) AS BIGINT) FROM m_sales WHERE product_id IS NOT NULL AND product_id NOT IN (SELECT id FROM m_products)
    UNION ALL SELECT 'sales', 'customer_id -> customers', CAST(count(*) AS BIGINT) FROM m_sales WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT id FROM m_customers)
    UNION ALL SELECT 'payments' AS table_name, 'amount > 0' AS rule, CAST(count(*) FILTER (WHERE NOT (amount > 0)) AS BIGINT) AS bad_rows FROM m_payments
    UNION ALL SELECT 'payments', 'customer_id -> customers', CAST(count(*) AS BIGINT) FROM m_payments WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT id FROM m_customers)
    UNION ALL SELECT 'payments', 'branch_id -> branches', CAST(count(*) AS BIGINT) FROM m_payments WHERE branch_id IS NOT NULL AND branch_id NOT IN (SELECT id FROM m_branches)
    UNION ALL SELECT 'expenses' AS table_name, 'amount >= 0' AS rule, CAST(count(*) FILTER (WHERE NOT (amount >= 0)) AS BIGINT) AS bad_rows FROM m_expenses
    UNION ALL SELECT 'expenses', 'branch_id -> branches', CAST(count(*) AS BIGINT) FROM m_expenses WHERE branch_id IS NOT NULL AND branch_id NOT IN (SELECT id FROM m_branches)
    UNION ALL SELECT 'profit_targets', 'unique(branch_id, period_type, period_start)', CAST(coalesce(sum(n), 0) AS BIGINT) FROM (SELECT count(*) AS n FROM m_profit_targets GROUP BY branch_id, period_type, period_start HAVING count(*) > 1)
    UNION ALL SELECT 'profit_targets' AS table_name, 'period_type in domain' AS rule, CAST(count(*) FILTER (WHERE NOT (period_type IN ('daily','weekly','monthly'))) AS BIGINT) AS bad_rows FROM m_profit_targets
    UNION ALL SELECT 'profit_targets' AS table_name, 'target_amount >= 0' AS rule, CAST(count(*) FILTER (WHERE NOT (target_amount >= 0)) AS BIGINT) AS bad_rows FROM m_profit_targets
    UNION ALL SELECT 'profit_targets', 'branch_id -> branches', CAST(count(*) AS BIGINT) FROM m_profit_targets WHERE branch_id IS NOT NULL AND branch_id NOT IN (SELECT id FROM m_branches)
    UNION ALL SELECT 'notifications' AS table_name, 'alert_type in domain' AS rule, CAST(count(*) FILTER (WHERE NOT (alert_type IN ('high_variance','negative_profit','high_credit_balance','target_performance'))) AS BIGINT) AS bad_rows FROM m_notifications
    UNION ALL SELECT 'notifications' AS table_name, 'severity in domain' AS rule, CAST(count(*) FILTER (WHERE NOT (severity IN ('info','warning','critical'))) AS BIGINT) AS bad_rows FROM m_notifications
    UNION ALL SELECT 'notifications', 'branch_id -> branches', CAST(count(*) AS BIGINT) FROM m_notifications WHERE branch_id IS NOT NULL AND branch_id NOT IN (SELECT id FROM m_branches)
    UNION ALL SELECT 'notifications', 'customer_id -> customers', CAST(count(*) AS BIGINT) FROM m_notifications WHERE customer_id IS NOT NULL AND customer_id NOT IN (SELECT id FROM m_customers)
    UNION ALL SELECT 'users' AS table_name, 'role in domain' AS rule, CAST(count(*) FILTER (WHERE NOT (role IN ('admin','attendant'))) AS BIGINT) AS bad_rows FROM m_users
    UNION ALL SELECT 'users' AS table_name, 'admin has no branch, attendant has one' AS rule, CAST(count(*) FILTER (WHERE NOT ((role = 'admin' AND branch_id IS NULL) OR (role = 'attendant' AND branch_id IS NOT NULL))) AS BIGINT) AS bad_rows FROM m_users
    UNION ALL SELECT 'users', 'branch_id -> branches', CAST(count(*) AS BIGINT) FROM m_users WHERE branch_id IS NOT NULL AND branch_id NOT IN (SELECT id FROM m_branches)
""" + _key_rules() + """
    ) AS audit(table_name, rule, bad_rows)""")


# 2.1 sources --------------------------------------------------------------------------
def _column_checks() -> str:
    """Per column of every stored table: rows, values and a sum that all values enter."""
    number = {"bigint": "CAST({c} AS DECIMAL(38,0))", "boolean": "CAST({c} AS INTEGER)", "string": "length({c})",
              "date": "({c} - DATE '1970-01-01')", "timestamp_ntz": "CAST(floor(epoch({c})) AS BIGINT)"}
    parts = []
    for table, schema in SCHEMAS.items():
        for f in schema.fields:
            value = number.get(f.dataType.simpleString(), "CAST({c} AS DECIMAL(38,2))").format(c=f.name)
            parts.append(f"SELECT '{table}' AS table_name, '{f.name}' AS column_name, count(*) AS n_rows, count({f.name}) AS n_values, "
                         f"CAST(coalesce(sum({value}), 0) AS DOUBLE) AS checksum FROM m_{table}")
    return "\n    UNION ALL ".join(parts)


oracle("load_tables", _column_checks())


# 2.11 streaming forms: the stream equals its batch twin ---------------------------
ORACLE["stream_credit_alerts"] = ORACLE["credit_limit_crossings"]
ORACLE["stream_redelivered_alerts"] = ORACLE["credit_limit_crossings"]
ORACLE["stream_stock_ledger"] = ORACLE["stock_ledger_replay"]
ORACLE["stream_validated_ingest"] = ORACLE["validate_sales"]
oracle("stream_branch_totals", """
    SELECT coalesce(r.branch_id, e.branch_id) AS branch_id, coalesce(r.sale_date, e.sale_date) AS report_date,
           coalesce(r.revenue, 0)::DOUBLE AS revenue, coalesce(r.discount_given, 0)::DOUBLE AS discount_given,
           coalesce(e.total_expenses, 0)::DOUBLE AS expenses,
           (coalesce(r.revenue, 0) - coalesce(e.total_expenses, 0))::DOUBLE AS gross_profit
    FROM o_revenue r FULL OUTER JOIN o_expense e ON e.branch_id = r.branch_id AND e.sale_date = r.sale_date""")


# 2.1 and 2.11: write paths and streams added to their batch twins -------------------
ORACLE["append_events"] = ORACLE["validate_payments"]
oracle("stream_credit_balances", """
    SELECT customer_id, sum(delta)::DOUBLE AS balance_owed FROM o_events GROUP BY customer_id""", *CREDIT_VIEWS)
oracle("replace_alerts", f"""
    SELECT * FROM ({A1}
 UNION ALL {A2}) WHERE NOT (alert_type = 'negative_profit' AND year(alert_date) = 1997)""")
oracle("stream_alert_regeneration", f"""
    SELECT * EXCLUDE (customer_id) FROM ({A1}
 UNION ALL {A2}) WHERE alert_date IN (SELECT expense_date FROM m_expenses)""")
