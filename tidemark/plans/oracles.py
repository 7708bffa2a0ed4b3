"""The registered queries in SQL, written apart from the plans they check."""

from __future__ import annotations

import re

from tidemark.plans import adapters

#: Relations that statements may name; each may name others.
RELATIONS = {name: adapters.plain_sql(name) for name in adapters.VIEWS} | {
    "stg_orders": """SELECT order_id, customer_id, lower(order_status) AS order_status, order_ts, CAST(order_ts AS DATE) AS order_date, upper(currency) AS currency,
  order_total, updated_at, source_lsn, applied_at, ingested_at, record_hash FROM core_orders WHERE NOT coalesce(is_deleted, false)""",
    "stg_customers": """SELECT customer_id, customer_name, email, upper(customer_status) AS customer_status, created_at, updated_at, source_lsn, applied_at, ingested_at, record_hash
  FROM core_customers WHERE NOT coalesce(is_deleted, false)""",
    "stg_products": """SELECT product_id, product_name, category_code, unit_price, upper(currency) AS currency, updated_at, source_lsn, applied_at, ingested_at, record_hash
  FROM core_products WHERE NOT coalesce(is_deleted, false)""",
    "stg_payments": """SELECT payment_id, order_id, lower(payment_status) AS payment_status, payment_ts, CAST(payment_ts AS DATE) AS payment_date, amount, upper(currency) AS currency,
  authorization_code, updated_at, source_lsn, applied_at, ingested_at, record_hash FROM core_payments WHERE NOT coalesce(is_deleted, false)""",
    "stg_rates": "SELECT * REPLACE (upper(base_currency) AS base_currency, upper(quote_currency) AS quote_currency) FROM silver_rates",
    "stg_locations": "SELECT location_id, location_name, upper(country_code) AS country_code, timezone, region, updated_at, location_type, source_extract_ts, ingested_at, record_hash, manifest_key FROM silver_locations",
    "int_orders_enriched": """SELECT o.*, r.rate AS dkk_rate, r.retrieved_at AS fx_retrieved_at, r.source_extract_ts AS fx_source_extract_ts, r.ingested_at AS fx_ingested_at, r.record_hash AS fx_record_hash,
  CASE WHEN o.currency = 'DKK' THEN o.order_total WHEN r.rate > 0 THEN CAST(round(o.order_total * r.rate, 2) AS DECIMAL(18,2)) END AS order_total_dkk,
  coalesce(o.currency <> 'DKK' AND r.rate IS NULL, false) AS missing_dkk_rate, c.customer_id IS NULL AS orphan_customer
  FROM stg_orders o LEFT JOIN (SELECT * FROM stg_rates WHERE quote_currency = 'DKK' AND rate > 0) r ON o.order_date = r.rate_date AND o.currency = r.base_currency
  LEFT JOIN stg_customers c ON o.customer_id = c.customer_id""",
    "int_payments_enriched": """SELECT p.*, o.customer_id, o.order_date, o.order_id IS NULL AS orphan_order FROM stg_payments p LEFT JOIN stg_orders o ON p.order_id = o.order_id""",
    "dim_customers": "SELECT md5(coalesce(customer_id, '__null__')) AS customer_sk, * FROM stg_customers",
    "dim_products": "SELECT md5(coalesce(product_id, '__null__')) AS product_sk, * FROM stg_products",
    "dim_locations": "SELECT md5(coalesce(location_id, '__null__')) AS location_sk, * FROM stg_locations",
    "observed_dates": "SELECT order_date AS date_day FROM stg_orders WHERE order_date IS NOT NULL UNION SELECT payment_date FROM stg_payments WHERE payment_date IS NOT NULL",
    "dim_date": "SELECT md5(CAST(date_day AS VARCHAR)) AS date_sk, date_day, year(date_day)::INTEGER AS calendar_year, month(date_day)::INTEGER AS calendar_month, day(date_day)::INTEGER AS day_of_month FROM observed_dates",
    "fct_orders": """SELECT o.order_id, c.customer_sk, d.date_sk, o.customer_id, o.order_date, o.order_ts, o.order_status, o.currency AS source_currency, o.order_total AS source_order_total,
  o.dkk_rate, o.order_total_dkk, o.missing_dkk_rate, o.orphan_customer, o.fx_retrieved_at, o.fx_source_extract_ts, o.fx_ingested_at, o.fx_record_hash,
  o.updated_at AS source_updated_at, o.source_lsn, o.applied_at AS source_applied_at, o.ingested_at AS source_ingested_at, o.record_hash AS source_record_hash
  FROM int_orders_enriched o LEFT JOIN dim_customers c ON o.customer_id = c.customer_id LEFT JOIN dim_date d ON o.order_date = d.date_day""",
    "fct_payments": """SELECT p.payment_id, o.order_id AS matched_order_id, p.order_id AS source_order_id, o.customer_sk, d.date_sk, p.payment_date, p.payment_ts, p.payment_status, p.currency AS source_currency,
  p.amount AS source_amount, p.authorization_code, p.orphan_order, p.updated_at AS source_updated_at, p.source_lsn, p.applied_at AS source_applied_at, p.ingested_at AS source_ingested_at, p.record_hash AS source_record_hash
  FROM int_payments_enriched p LEFT JOIN fct_orders o ON p.order_id = o.order_id LEFT JOIN dim_date d ON p.payment_date = d.date_day""",
    "mart_daily_sales": """SELECT order_date, source_currency, count(*) AS order_count, count(DISTINCT customer_id) AS source_customer_count, sum(source_order_total)::DECIMAL(18,2) AS source_gross_sales,
  sum(order_total_dkk)::DECIMAL(18,2) AS converted_sales_dkk, count(*) FILTER (missing_dkk_rate) AS missing_rate_order_count, count(*) FILTER (orphan_customer) AS orphan_customer_order_count
  FROM fct_orders GROUP BY ALL""",
    "prior_orders": """SELECT * REPLACE (CASE CAST(order_id AS BIGINT) % 4 WHEN 0 THEN source_updated_at - INTERVAL '1' DAY WHEN 1 THEN source_updated_at + INTERVAL '1' DAY ELSE source_updated_at END AS source_updated_at,
  CASE WHEN CAST(order_id AS BIGINT) % 8 = 2 THEN NULL ELSE fx_record_hash END AS fx_record_hash) FROM fct_orders WHERE CAST(order_id AS BIGINT) % 3 <> 0""",
    "fresh_orders": """SELECT s.* FROM fct_orders s LEFT JOIN prior_orders t ON s.order_id = t.order_id WHERE t.order_id IS NULL OR
  (s.source_updated_at, s.source_applied_at, coalesce(s.fx_retrieved_at, TIMESTAMP '1900-01-01'), coalesce(s.fx_source_extract_ts, TIMESTAMP '1900-01-01'), coalesce(s.fx_ingested_at, TIMESTAMP '1900-01-01'), coalesce(s.fx_record_hash, '')) >
  (t.source_updated_at, t.source_applied_at, coalesce(t.fx_retrieved_at, TIMESTAMP '1900-01-01'), coalesce(t.fx_source_extract_ts, TIMESTAMP '1900-01-01'), coalesce(t.fx_ingested_at, TIMESTAMP '1900-01-01'), coalesce(t.fx_record_hash, ''))""",
    "rates_typed": """SELECT CAST(try_cast(rate_date AS DATE) AS DATE) AS rate_date, upper(trim(base_currency)) AS base_currency, upper(trim(quote_currency)) AS quote_currency, try_cast(rate AS DECIMAL(20,10)) AS rate,
  try_cast(retrieved_at AS TIMESTAMP) AS retrieved_at, try_cast(source_extract_ts AS TIMESTAMP) AS source_extract_ts, try_cast(ingested_at AS TIMESTAMP) AS ingested_at, record_hash, source_locator FROM bronze_rates""",
    "rates_checked": """SELECT *, nullif(concat_ws(';', CASE WHEN rate_date IS NULL THEN 'invalid_or_missing_rate_date' END, CASE WHEN base_currency IS NULL OR quote_currency IS NULL THEN 'missing_currency' END,
  CASE WHEN length(base_currency) <> 3 OR length(quote_currency) <> 3 THEN 'invalid_currency_code' END, CASE WHEN base_currency = quote_currency THEN 'base_currency_equals_quote_currency' END,
  CASE WHEN rate IS NULL THEN 'invalid_or_missing_rate' END, CASE WHEN rate <= 0 THEN 'non_positive_rate' END, CASE WHEN retrieved_at IS NULL THEN 'invalid_or_missing_retrieved_at' END), '') AS rejection_reason FROM rates_typed""",
    "locations_typed": """SELECT l.*, r.region FROM (SELECT trim(location_id) AS location_id, trim(location_name) AS location_name, upper(trim(country_code)) AS country_code, trim(timezone) AS timezone,
  try_cast(updated_at AS TIMESTAMP) AS updated_at, record_hash, source_locator FROM bronze_locations) l LEFT JOIN (VALUES ('DK', 'nordics'), ('NO', 'nordics')) r(code, region) ON l.country_code = r.code""",
    "locations_checked": """SELECT *, nullif(concat_ws(';', CASE WHEN coalesce(location_id, '') = '' THEN 'missing_location_id' END, CASE WHEN coalesce(location_name, '') = '' THEN 'missing_location_name' END,
  CASE WHEN coalesce(timezone, '') = '' THEN 'missing_timezone' END, CASE WHEN updated_at IS NULL THEN 'invalid_or_missing_updated_at' END, CASE WHEN region IS NULL THEN 'unknown_country_reference' END), '') AS rejection_reason FROM locations_typed""",
    "rates_ranked": """SELECT *, row_number() OVER (PARTITION BY rate_date, base_currency, quote_currency ORDER BY retrieved_at DESC NULLS LAST, source_extract_ts DESC NULLS LAST, ingested_at DESC NULLS LAST, record_hash DESC, source_locator ASC NULLS LAST) AS n
  FROM rates_checked WHERE rejection_reason IS NULL""",
    "winners": "SELECT * EXCLUDE (n, rejection_reason) FROM rates_ranked WHERE n = 1",
    "silver_target": """SELECT rate_date, base_currency, quote_currency, CAST(1.5 AS DECIMAL(20,10)) AS rate,
  CASE day(rate_date) % 3 WHEN 0 THEN retrieved_at - INTERVAL '1' DAY WHEN 1 THEN retrieved_at + INTERVAL '1' DAY ELSE retrieved_at END AS retrieved_at,
  CASE WHEN day(rate_date) % 5 = 0 THEN NULL ELSE source_extract_ts END AS source_extract_ts, ingested_at, record_hash, source_locator FROM winners WHERE day(rate_date) % 4 <> 0""",
    "newer_winners": """SELECT s.*, t.rate_date IS NULL AS fresh FROM winners s LEFT JOIN silver_target t ON s.rate_date = t.rate_date AND s.base_currency = t.base_currency AND s.quote_currency = t.quote_currency
  WHERE t.rate_date IS NULL OR (s.retrieved_at, coalesce(s.source_extract_ts, TIMESTAMP '1900-01-01'), s.ingested_at, s.record_hash) > (t.retrieved_at, coalesce(t.source_extract_ts, TIMESTAMP '1900-01-01'), t.ingested_at, t.record_hash)""",
    "outcomes": """SELECT w.rate_date, w.base_currency, w.quote_currency, CASE WHEN n.fresh THEN 'insert' WHEN n.rate_date IS NOT NULL THEN 'update' ELSE 'unchanged' END AS outcome
  FROM winners w LEFT JOIN newer_winners n ON w.rate_date = n.rate_date AND w.base_currency = n.base_currency AND w.quote_currency = n.quote_currency""",
    "fold_positions": """WITH RECURSIVE ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity, pk ORDER BY seq) AS n FROM cdc_positions),
  f AS (SELECT entity, pk, seq, n, op, lsn, rec, hash, CASE WHEN op = 'delete' THEN 'applied_delete' ELSE 'applied_insert' END AS decision, phase AS p, lsn AS l, tx AS t, rec AS r, hash AS h FROM ev WHERE n = 1
  UNION ALL SELECT entity, pk, seq, n, op, lsn, rec, hash, d, CASE WHEN d LIKE 'applied%' THEN phase ELSE p END, CASE WHEN d LIKE 'applied%' THEN lsn ELSE l END, CASE WHEN d LIKE 'applied%' THEN tx ELSE t END, CASE WHEN d LIKE 'applied%' THEN rec ELSE r END, CASE WHEN d LIKE 'applied%' THEN hash ELSE h END
  FROM (SELECT e.*, f.p, f.l, f.t, f.r, f.h, CASE
    WHEN e.phase > f.p OR (e.phase = 1 AND f.p = 1 AND (e.lsn > f.l OR (e.lsn = f.l AND e.tx = f.t AND e.rec > f.r))) THEN CASE WHEN e.op = 'delete' THEN 'applied_delete' ELSE 'applied_update' END
    WHEN e.phase < f.p OR (e.phase = 1 AND e.lsn < f.l) THEN 'stale'
    WHEN e.phase = 0 THEN CASE WHEN e.hash = f.h THEN 'duplicate' ELSE 'conflict' END
    WHEN e.tx IS DISTINCT FROM f.t OR e.rec IS NULL OR f.r IS NULL THEN 'incomparable'
    WHEN e.rec < f.r THEN 'stale' WHEN e.hash = f.h THEN 'duplicate' ELSE 'conflict' END AS d FROM f JOIN ev e ON e.entity = f.entity AND e.pk = f.pk AND e.n = f.n + 1))
  SELECT * FROM f""",
    "fold_log": """WITH RECURSIVE ev AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY entity, pk ORDER BY seq) AS n FROM cdc_log),
  f AS (SELECT entity, pk, seq, n, 'newer' AS decision, lsn AS l, tx AS t, ord AS o, part AS a, off AS b FROM ev WHERE n = 1
  UNION ALL SELECT entity, pk, seq, n, d, CASE d WHEN 'newer' THEN lsn ELSE l END, CASE d WHEN 'newer' THEN tx ELSE t END, CASE d WHEN 'newer' THEN ord ELSE o END, CASE d WHEN 'newer' THEN part ELSE a END, CASE d WHEN 'newer' THEN off ELSE b END
  FROM (SELECT e.*, f.l, f.t, f.o, f.a, f.b, CASE WHEN e.lsn > f.l THEN 'newer' WHEN e.lsn < f.l THEN 'lower_lsn' WHEN e.tx = f.t AND e.ord > f.o THEN 'newer' WHEN e.tx = f.t AND e.ord < f.o THEN 'lower_transaction_order'
    WHEN e.part = f.a AND e.off = f.b THEN 'exact_replay' ELSE 'equal_position_conflict' END AS d FROM f JOIN ev e ON e.entity = f.entity AND e.pk = f.pk AND e.n = f.n + 1))
  SELECT * FROM f""",
}


def statement(sql: str) -> str:
    """``sql`` with every relation it needs before it."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in RELATIONS:
            if name not in needed and re.search(rf"\b{name}\b", text) and text is not RELATIONS[name]:
                visit(RELATIONS[name])
                if name not in needed:
                    needed.append(name)

    visit(sql)
    if not needed:
        return sql
    return "WITH " + ",\n".join(f"{n} AS (\n{RELATIONS[n]})" for n in needed) + "\n" + sql
