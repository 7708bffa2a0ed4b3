"""The test tables in the shape of the commerce sources, with gaps, repeats and dirt put in by modulus.

Each adapter is a SELECT that any engine reads the same way; tables stand in braces.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "core_orders": """
SELECT CAST(o_orderkey AS STRING) AS order_id, CAST(o_custkey AS STRING) AS customer_id,
  CASE o_orderstatus WHEN 'O' THEN 'Created' WHEN 'F' THEN 'COMPLETED' ELSE 'cancelled' END AS order_status,
  o_orderdate AS order_ts, CASE o_custkey % 3 WHEN 0 THEN 'dkk' WHEN 1 THEN 'EUR' ELSE 'usd' END AS currency,
  CAST(o_totalprice AS DECIMAL(18,2)) AS order_total,
  CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL '1' DAY ELSE o_orderdate END AS updated_at,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE '0/' || CAST(o_orderkey % 1000 AS STRING) END AS source_lsn,
  o_orderdate + INTERVAL '2' DAY AS applied_at, o_orderdate + INTERVAL '2' DAY AS ingested_at,
  md5(CAST(o_orderkey AS STRING)) AS record_hash,
  CASE WHEN o_orderkey % 23 = 0 THEN true WHEN o_orderkey % 5 = 0 THEN NULL ELSE false END AS is_deleted,
  CASE WHEN o_orderkey % 46 = 0 THEN 'DELETE' WHEN o_orderkey % 23 = 0 THEN 'delete' ELSE 'update' END AS dms_operation
FROM {orders}""",
    "core_customers": """
SELECT CAST(c_custkey AS STRING) AS customer_id, c_name AS customer_name, lower(c_name) || '@example.com' AS email,
  CASE WHEN c_acctbal < 0 THEN 'suspended' WHEN c_custkey % 4 = 0 THEN 'Inactive' WHEN c_custkey % 41 = 0 THEN 'unknown' ELSE 'active' END AS customer_status,
  CAST('2020-01-01 00:00:00' AS TIMESTAMP) AS created_at, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at,
  '0/' || CAST(c_custkey AS STRING) AS source_lsn, CAST('2024-01-02 00:00:00' AS TIMESTAMP) AS applied_at,
  CAST('2024-01-02 00:00:00' AS TIMESTAMP) AS ingested_at, md5(c_name) AS record_hash,
  CASE WHEN c_custkey % 37 = 0 THEN true WHEN c_custkey % 5 = 0 THEN NULL ELSE false END AS is_deleted
FROM {customer} WHERE c_custkey % 10 <> 0""",
    "core_products": """
SELECT CAST(p_partkey AS STRING) AS product_id, p_name AS product_name, p_brand AS category_code,
  CAST(p_retailprice AS DECIMAL(18,2)) AS unit_price, CASE WHEN p_partkey % 2 = 0 THEN 'eur' ELSE 'DKK' END AS currency,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at, '0/' || CAST(p_partkey AS STRING) AS source_lsn,
  CAST('2024-01-02 00:00:00' AS TIMESTAMP) AS applied_at, CAST('2024-01-02 00:00:00' AS TIMESTAMP) AS ingested_at,
  md5(p_name) AS record_hash, p_partkey % 31 = 0 AS is_deleted
FROM {part}""",
    "core_payments": """
SELECT CAST(l_orderkey * 10 + l_linenumber AS STRING) AS payment_id,
  CAST(CASE WHEN l_linenumber = 7 THEN l_orderkey + 1000000000 ELSE l_orderkey END AS STRING) AS order_id,
  CASE l_linenumber % 4 WHEN 0 THEN 'AUTHORIZED' WHEN 1 THEN 'completed' WHEN 2 THEN 'Failed' ELSE 'refunded' END AS payment_status,
  max(l_shipdate) AS payment_ts, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS amount,
  CASE WHEN l_orderkey % 2 = 0 THEN 'eur' ELSE 'DKK' END AS currency,
  CASE WHEN l_linenumber % 2 = 0 THEN NULL ELSE 'auth-' || CAST(l_orderkey AS STRING) END AS authorization_code,
  max(l_shipdate) AS updated_at, '0/' || CAST(l_linenumber AS STRING) AS source_lsn,
  max(l_shipdate) + INTERVAL '1' DAY AS applied_at, max(l_shipdate) + INTERVAL '1' DAY AS ingested_at,
  md5(CAST(l_orderkey * 10 + l_linenumber AS STRING)) AS record_hash, (l_orderkey + l_linenumber) % 53 = 0 AS is_deleted
FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "silver_rates": """
SELECT d AS rate_date, CASE WHEN day(d) % 2 = 0 THEN lower(c) ELSE c END AS base_currency, 'dkk' AS quote_currency,
  CAST(CAST(6 AS DECIMAL(20,10)) + CAST((day(d) * 37 + month(d) * 11) % 100 AS DECIMAL(20,10)) * CAST(0.01 AS DECIMAL(20,10)) AS DECIMAL(20,10)) AS rate,
  CAST(d AS TIMESTAMP) AS retrieved_at, 'central-bank' AS provider_name,
  CASE WHEN day(d) % 5 = 0 THEN NULL ELSE CAST(d AS TIMESTAMP) END AS source_extract_ts,
  CAST(d AS TIMESTAMP) AS ingested_at, md5(c || CAST(d AS STRING)) AS record_hash, 'manifest-' || c AS manifest_key
FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM {orders}) AS days CROSS JOIN (SELECT 'EUR' AS c UNION ALL SELECT 'USD') AS currencies
WHERE day(d) % 7 <> 0""",
    "silver_locations": """
SELECT CAST(s_suppkey AS STRING) AS location_id, s_name AS location_name, lower(substr(n_name, 1, 2)) AS country_code,
  'Europe/Copenhagen' AS timezone, r_name AS region, CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS updated_at,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE 'warehouse' END AS location_type,
  CAST('2024-01-01 00:00:00' AS TIMESTAMP) AS source_extract_ts, CAST('2024-01-02 00:00:00' AS TIMESTAMP) AS ingested_at,
  md5(s_name) AS record_hash, 'manifest-locations' AS manifest_key
FROM {supplier} JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey""",
    "bronze_rates": """
SELECT CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'not-a-date' ELSE '2024-01-' || lpad(CAST(1 + event_id % 28 AS STRING), 2, '0') END AS rate_date,
  CASE event_id % 13 WHEN 0 THEN NULL WHEN 1 THEN 'EURO' WHEN 2 THEN '' ELSE ' eur ' END AS base_currency,
  CASE event_id % 7 WHEN 0 THEN 'DKK' WHEN 1 THEN 'EUR' ELSE 'usd' END AS quote_currency,
  CASE event_id % 17 WHEN 0 THEN NULL WHEN 1 THEN 'abc' WHEN 2 THEN '-1.5' WHEN 3 THEN '0' ELSE CAST(event_id % 500 AS STRING) || '.25' END AS rate,
  CASE event_id % 19 WHEN 0 THEN NULL WHEN 1 THEN 'yesterday' ELSE '2024-02-' || lpad(CAST(1 + event_id % 20 AS STRING), 2, '0') || 'T00:00:00Z' END AS retrieved_at,
  CASE WHEN event_id % 6 = 0 THEN NULL ELSE '2024-02-01T0' || CAST(event_id % 9 AS STRING) || ':00:00Z' END AS source_extract_ts,
  '2024-03-01T0' || CAST(event_id % 5 AS STRING) || ':00:00Z' AS ingested_at, 'run-1' AS ingestion_id, 'rest_api' AS source_name,
  'exchange_rates' AS source_entity, md5(CAST(event_id % 3 AS STRING)) AS record_hash, 'row=' || lpad(CAST(event_id AS STRING), 9, '0') AS source_locator
FROM {events}""",
    "bronze_locations": """
SELECT CASE WHEN s_suppkey % 9 = 0 THEN ' ' ELSE ' ' || CAST(s_suppkey % 40 AS STRING) END AS location_id,
  CASE s_suppkey % 8 WHEN 0 THEN NULL WHEN 1 THEN '' ELSE s_name END AS location_name,
  CASE s_suppkey % 3 WHEN 0 THEN ' dk' WHEN 1 THEN 'NO' ELSE 'de' END AS country_code,
  CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE 'Europe/Oslo ' END AS timezone,
  CASE s_suppkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'soon' ELSE '2024-01-0' || CAST(1 + s_suppkey % 9 AS STRING) || 'T12:00:00Z' END AS updated_at,
  '2024-02-01T00:00:00Z' AS source_extract_ts, '2024-03-01T00:00:00Z' AS ingested_at, 'run-2' AS ingestion_id, 'rest_api' AS source_name,
  'locations' AS source_entity, md5(s_name) AS record_hash, 'row=' || lpad(CAST(s_suppkey AS STRING), 9, '0') AS source_locator
FROM {supplier}""",
    "cdc_positions": """
SELECT event_type AS entity, user_id % 20 AS pk, event_id AS seq, CASE WHEN event_id % 17 = 0 THEN 0 ELSE 1 END AS phase,
  CASE WHEN event_id % 17 = 0 THEN 0 ELSE (event_id * 13) % 9 + CAST((event_id - event_id % 400) / 400 AS BIGINT) END AS lsn,
  CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'x' ELSE 'y' END AS tx,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE event_id % 4 END AS rec, event_id % 5 AS hash,
  CASE WHEN event_id % 17 = 0 THEN 'load' WHEN event_id % 6 = 0 THEN 'delete' ELSE 'update' END AS op
FROM {events}""",
    "cdc_log": """
SELECT event_type AS entity, user_id % 20 AS pk, event_id AS seq,
  (event_id * 13) % 9 + CAST((event_id - event_id % 400) / 400 AS BIGINT) AS lsn,
  CASE event_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'x' ELSE 'y' END AS tx,
  CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 4 END AS ord, 'topic' AS topic,
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE 0 END AS part, event_id % 2 AS off,
  CASE WHEN event_id % 6 = 0 THEN 'delete' ELSE 'update' END AS op
FROM {events}""",
    "messages": """
SELECT 'shop.commerce.' || CASE event_id % 5 WHEN 0 THEN 'customers' WHEN 1 THEN 'products' WHEN 2 THEN 'orders' WHEN 3 THEN 'payments' ELSE 'invoices' END AS topic,
  0 AS part, event_id AS off,
  CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN '{{broken' ELSE
    '{{"op":' || CASE event_id % 6 WHEN 0 THEN '"r"' WHEN 1 THEN '"c"' WHEN 2 THEN '"u"' WHEN 3 THEN '"d"' WHEN 4 THEN '"x"' ELSE 'null' END ||
    ',"before":null,"after":' || CASE WHEN event_id % 6 = 3 AND event_id % 4 <> 0 THEN 'null' ELSE '{{"customer_id":"c' || CAST(user_id AS STRING) || '","order_id":"o1","product_id":"p1"}}' END ||
    ',"source":{{"lsn":' || CASE event_id % 10 WHEN 0 THEN 'null' ELSE '"' || CAST(event_id AS STRING) || '"' END || ',"ts_ms":"' || CAST(1700000000000 + event_id AS STRING) || '"}}' ||
    ',"transaction":{{"id":"t1","total_order":' || CASE event_id % 14 WHEN 0 THEN '"z"' ELSE '"3"' END || '}}}}' END AS value
FROM {events}""",
}


def tables_in(text: str) -> list[str]:
    return sorted(set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text)))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter over the Parquet tables of ``sf_dir``, as part of the plan that uses it."""
    text = VIEWS[name]
    frames = {t: table(spark, sf_dir, t) for t in tables_in(text)}
    with_ntz = text.replace("AS TIMESTAMP)", "AS TIMESTAMP_NTZ)")
    return spark.sql(with_ntz, **frames)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def plain_sql(name: str) -> str:
    """The adapter for an engine that has the tables by name."""
    text = VIEWS[name]
    return text.format(**{t: t for t in tables_in(text)}).strip()
