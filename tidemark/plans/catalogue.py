"""All registered queries by name, each with the statement that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark import schemas as S
from tidemark.functions import exprs as X
from tidemark.functions import rules as R
from tidemark.operators import backfill, cdc, quality, silver
from tidemark.plans import adapters, gold, oracles
from tidemark.sources import landing
from tidemark.streaming import cdc as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
RATE_KEYS = S.ENTITIES["exchange_rates"].key
DAY = "timestamp_ntz"


class Source:
    """The relations of one run: tables, adapters, and models over them, each as a plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in adapters.VIEWS:
            return adapters.view(self.spark, self.sf_dir, name)
        if name in MODELS:
            return MODELS[name](self)
        return adapters.table(self.spark, self.sf_dir, name)


def _typed_rates(s: Source) -> DataFrame:
    raw = s.bronze_rates
    stamps = [F.try_to_timestamp(c).cast(DAY).alias(c) for c in ("source_extract_ts", "ingested_at")]
    typed = silver.normalize_rates(raw, [*stamps, F.col("record_hash"), F.col("source_locator")])
    return typed.withColumn("retrieved_at", F.col("retrieved_at").cast(DAY))


def _typed_locations(s: Source) -> DataFrame:
    typed = silver.normalize_locations(s.bronze_locations, [F.col("record_hash"), F.col("source_locator")])
    return typed.withColumn("updated_at", F.col("updated_at").cast(DAY))


def _silver_target(s: Source) -> DataFrame:
    day = F.dayofmonth("rate_date")
    moved = F.when(day % 3 == 0, F.col("retrieved_at") - F.expr("INTERVAL '1' DAY")).when(day % 3 == 1, F.col("retrieved_at") + F.expr("INTERVAL '1' DAY")).otherwise(F.col("retrieved_at"))
    return s.winners.where(day % 4 != 0).select(
        *RATE_KEYS, F.lit(1.5).cast("decimal(20,10)").alias("rate"), moved.alias("retrieved_at"),
        F.when(day % 5 != 0, F.col("source_extract_ts")).alias("source_extract_ts"), "ingested_at", "record_hash", "source_locator",
    )


def _prior_orders(s: Source) -> DataFrame:
    number = F.col("order_id").cast("bigint")
    facts = s.fct_orders.where(number % 3 != 0)
    at = F.col("source_updated_at")
    moved = F.when(number % 4 == 0, at - F.expr("INTERVAL '1' DAY")).when(number % 4 == 1, at + F.expr("INTERVAL '1' DAY")).otherwise(at)
    return facts.withColumns({"source_updated_at": moved, "fx_record_hash": F.when(number % 8 != 2, F.col("fx_record_hash"))})


MODELS: dict[str, Callable[[Source], DataFrame]] = {
    "stg_orders": lambda s: gold.stg_orders(s.core_orders),
    "stg_customers": lambda s: gold.stg_customers(s.core_customers),
    "stg_products": lambda s: gold.stg_products(s.core_products),
    "stg_payments": lambda s: gold.stg_payments(s.core_payments),
    "stg_rates": lambda s: gold.stg_rates(s.silver_rates),
    "stg_locations": lambda s: gold.stg_locations(s.silver_locations),
    "int_orders_enriched": lambda s: gold.int_orders_enriched(s.stg_orders, s.stg_rates, s.stg_customers),
    "int_payments_enriched": lambda s: gold.int_payments_enriched(s.stg_payments, s.stg_orders),
    "dim_customers": lambda s: gold.dim_customers(s.stg_customers),
    "dim_products": lambda s: gold.dim_products(s.stg_products),
    "dim_locations": lambda s: gold.dim_locations(s.stg_locations),
    "dim_date": lambda s: gold.dim_date(s.stg_orders, s.stg_payments),
    "fct_orders": lambda s: gold.fct_orders(s.stg_orders, s.stg_rates, s.stg_customers),
    "fct_payments": lambda s: gold.fct_payments(s.int_payments_enriched, gold.order_keys(s.stg_orders, s.dim_customers)),
    "mart_daily_sales": lambda s: gold.mart_daily_sales(s.fct_orders),
    "rates_checked": lambda s: silver.with_reason(_typed_rates(s), "exchange_rates"),
    "locations_checked": lambda s: silver.with_reason(_typed_locations(s), "locations"),
    "winners": lambda s: silver.deduplicate(s.rates_checked, "exchange_rates")[0],
    "silver_target": _silver_target,
    "prior_orders": _prior_orders,
}
BATCH = silver.Batch("bronze/rest_api/exchange_rates/m1", "exchange_rates", "2024-03-01", "2024-03-01", "2024-03-02", "run-1")


def newer_rate(left: str = "s", right: str = "t"):
    extract = lambda side: F.coalesce(F.col(f"{side}.source_extract_ts"), F.lit(X.NO_TIME).cast(DAY))
    plain = lambda c: (F.col(f"{left}.{c}"), F.col(f"{right}.{c}"))
    return X.lexicographic([plain("retrieved_at"), (extract(left), extract(right)), plain("ingested_at"), plain("record_hash")])


def query(name: str, sql: str | None, plan: Callable[[Source], DataFrame]) -> None:
    QUERIES[name] = lambda spark, sf_dir: plan(Source(spark, sf_dir))
    if sql:
        ORACLES[name] = oracles.statement(sql)


n = lambda c=None: F.count(F.lit(1)) if c is None else F.count(c)

# Scans, order, pages.
query("scan_snapshot", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders",
      lambda s: s.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate"))
query("scan_incremental_half_open", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'",
      lambda s: s.orders.where(X.half_open(F.col("o_orderdate"), *(F.lit(x).cast(DAY) for x in ("1995-01-01", "1996-01-01")))).select("o_orderkey", "o_orderdate"))
query("offset_pagination", "SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 25 OFFSET 50",
      lambda s: s.customer.select("c_custkey", "c_name").orderBy("c_custkey").offset(50).limit(25))
query("ordered_scan", "SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey)::INTEGER AS place FROM supplier ORDER BY s_suppkey",
      lambda s: silver.numbered(s.supplier, "s_suppkey", "place").select("s_suppkey", "s_name", "place").orderBy("s_suppkey"))
query("topk_latest", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10",
      lambda s: s.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10))
query("source_freshness", """SELECT 'orders' AS source, max(ingested_at) AS loaded_at, CASE WHEN date_diff('hour', max(ingested_at), TIMESTAMP '1998-08-05') > 72 THEN 'error'
  WHEN date_diff('hour', max(ingested_at), TIMESTAMP '1998-08-05') > 24 THEN 'warn' ELSE 'pass' END AS status FROM core_orders""",
      lambda s: s.core_orders.agg(F.max("ingested_at").alias("loaded_at")).select(F.lit("orders").alias("source"), "loaded_at",
          F.when(F.timestamp_diff("HOUR", F.col("loaded_at"), F.lit("1998-08-05").cast(DAY)) > 72, "error").when(F.timestamp_diff("HOUR", F.col("loaded_at"), F.lit("1998-08-05").cast(DAY)) > 24, "warn").otherwise("pass").alias("status")))

# Normalisation and functions.
query("normalize_rates", "SELECT * FROM rates_typed", _typed_rates)
query("normalize_locations", "SELECT * FROM locations_typed", _typed_locations)
query("optional_column_null", "SELECT location_id, location_type, NULL::VARCHAR AS opened_by FROM silver_locations",
      lambda s: (lambda f: f.select("location_id", X.optional(f, "location_type").alias("location_type"), X.optional(f, "opened_by").alias("opened_by")))(s.silver_locations))
query("landing_envelope", """SELECT n_nationkey, n_name, n_regionkey, 'run-7' AS ingestion_id, 'postgres' AS source_name, 'nation' AS source_entity, CAST(n_nationkey AS VARCHAR) AS source_record_key, NULL::VARCHAR AS source_extract_ts,
  '2024-01-01T00:00:00Z' AS ingested_at, 'v1' AS source_version, 'nation#' || n_nationkey AS source_locator, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || ',"n_regionkey":' || n_regionkey || '}') AS record_hash FROM nation""",
      lambda s: landing.envelope(s.nation, ingestion_id="run-7", source_name="postgres", source_entity="nation",
          key=("n_nationkey",), ingested_at="2024-01-01T00:00:00Z", source_version="v1", locator=F.concat(F.lit("nation#"), "n_nationkey")))
_CUSTOMER = """'{"c_acctbal":"' || printf('%.2f', c_acctbal) || '","c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","c_nationkey":' || c_nationkey || '}'"""
_customers = lambda s: s.customer.withColumn("c_acctbal", F.format_string("%.2f", "c_acctbal"))
query("payload_to_json", f"SELECT c_custkey, {_CUSTOMER} AS payload FROM customer",
      lambda s: (lambda f: f.select("c_custkey", X.canonical_json(f.columns).alias("payload")))(_customers(s)))
query("safe_casts", "SELECT source_locator, try_cast(rate_date AS DATE) AS as_date, try_cast(rate AS DECIMAL(20,10)) AS as_rate, try_cast(retrieved_at AS TIMESTAMP) AS as_time FROM bronze_rates",
      lambda s: s.bronze_rates.select("source_locator", X.to_date(F.col("rate_date")).alias("as_date"), X.to_decimal(F.col("rate")).alias("as_rate"), F.try_to_timestamp("retrieved_at").cast(DAY).alias("as_time")))
query("string_functions", "SELECT source_locator, trim(base_currency) AS trimmed, upper(quote_currency) AS uppered, lower(source_entity) AS lowered, length(rate)::INTEGER AS rate_length FROM bronze_rates",
      lambda s: s.bronze_rates.select("source_locator", F.trim("base_currency").alias("trimmed"), F.upper("quote_currency").alias("uppered"), F.lower("source_entity").alias("lowered"), F.length("rate").alias("rate_length")))
query("regex_validate", "SELECT c_custkey, regexp_matches(c_name, '^Customer#[0-9]+$') AS good_name, regexp_matches('sha256:' || md5(c_name), '^sha256:[0-9a-f]{64}$') AS good_hash FROM customer",
      lambda s: s.customer.select("c_custkey", F.col("c_name").rlike("^Customer#[0-9]+$").alias("good_name"), F.concat(F.lit("sha256:"), F.md5("c_name")).rlike("^sha256:[0-9a-f]{64}$").alias("good_hash")))
query("record_hash", """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS record_hash FROM nation""",
      lambda s: s.nation.select("n_nationkey", X.record_hash(["n_regionkey", "n_name"]).alias("record_hash")))
query("event_hash", """SELECT seq, sha256('{"entity":"' || entity || '","hash":' || hash || ',"lsn":' || lsn || ',"op":"' || op || '","pk":' || pk || '}') AS event_hash FROM cdc_positions""",
      lambda s: s.cdc_positions.select("seq", X.record_hash(["entity", "pk", "op", "lsn", "hash"]).alias("event_hash")))
query("ingestion_id_sha", "SELECT n_nationkey, substr(sha256('rest_api|' || n_name || '|2024-01-01|a|b'), 1, 24) AS ingestion_id FROM nation",
      lambda s: s.nation.select("n_nationkey", X.batch_id(F.lit("rest_api"), F.col("n_name"), F.lit("2024-01-01"), F.lit("a"), F.lit("b")).alias("ingestion_id")))
query("bronze_object_key", "SELECT n_nationkey, 'bronze/rest_api/' || n_name || '/ingest_date=2024-01-01/ingestion_id=run-' || n_nationkey || '/data.parquet' AS object_key FROM nation",
      lambda s: s.nation.select("n_nationkey", X.object_key(F.lit("rest_api"), F.col("n_name"), F.lit("2024-01-01"), F.concat(F.lit("run-"), "n_nationkey")).alias("object_key")))
query("composite_key", "SELECT source_locator, coalesce(upper(trim(rate_date)), '') || '|' || coalesce(upper(trim(base_currency)), '') || '|' || coalesce(upper(trim(quote_currency)), '') AS silver_key FROM bronze_rates",
      lambda s: s.bronze_rates.select("source_locator", X.composite_key(*map(F.col, RATE_KEYS)).alias("silver_key")))
query("surrogate_key", "SELECT c_custkey, md5(CAST(c_custkey AS VARCHAR) || '|' || coalesce(c_mktsegment, '__null__')) AS sk FROM customer",
      lambda s: s.customer.select("c_custkey", X.surrogate_key(F.col("c_custkey"), F.col("c_mktsegment")).alias("sk")))
query("lsn_parse", """SELECT event_id, printf('%X/%X', user_id, event_id * 65537) AS lsn_text, CAST(user_id * 4294967296 + event_id * 65537 AS DECIMAL(20,0)) AS lsn FROM events""",
      lambda s: s.events.select("event_id", F.concat(F.hex("user_id"), F.lit("/"), F.hex(F.col("event_id") * 65537)).alias("lsn_text")).select("event_id", "lsn_text", X.lsn(F.col("lsn_text")).alias("lsn")))
query("topic_entity", "SELECT part, off, split_part(topic, '.', 3) AS entity, split_part(topic, '.', 3) || ':' || off AS key_identity FROM messages",
      lambda s: s.messages.select("part", "off", X.topic_entity(F.col("topic")).alias("entity"), F.concat(X.topic_entity(F.col("topic")), F.lit(":"), "off").alias("key_identity")))
query("event_time_parse", """SELECT event_id, CASE WHEN event_id % 2 = 0 THEN make_timestamp((1700000000000 + event_id * 1000) * 1000) ELSE TIMESTAMP '2024-05-01 10:00:00' END AS event_time FROM events""",
      lambda s: s.events.select("event_id", X.event_time(F.when(F.col("event_id") % 2 == 0, (F.lit(1700000000000) + F.col("event_id") * 1000).cast("string")).otherwise("2024-05-01T10:00:00Z")).cast(DAY).alias("event_time")))
query("event_date_partition", "SELECT event_id, strftime(ts, '%Y-%m-%d') AS event_date FROM events",
      lambda s: s.events.select("event_id", F.substring(F.col("ts").cast("string"), 1, 10).alias("event_date")))
query("json_extract", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events",
      lambda s: s.events.select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k")))
query("required_fields_missing", """SELECT s_suppkey, concat_ws(',', CASE WHEN s_suppkey % 2 = 0 THEN 'country_code' END, CASE WHEN s_suppkey % 3 = 0 THEN 'updated_at' END) AS missing FROM supplier""",
      lambda s: s.supplier.select("s_suppkey", F.concat_ws(",", F.array_except(F.array(F.lit("country_code"), F.lit("location_id"), F.lit("updated_at")),
          F.map_keys(F.map_filter(F.create_map(F.lit("country_code"), F.col("s_suppkey") % 2 != 0, F.lit("location_id"), F.lit(True), F.lit("updated_at"), F.col("s_suppkey") % 3 != 0), lambda k, v: v)))).alias("missing")))
query("fx_convert", "SELECT order_id, currency, CASE WHEN currency = 'DKK' THEN order_total WHEN dkk_rate > 0 THEN CAST(round(order_total * dkk_rate, 2) AS DECIMAL(18,2)) END AS dkk FROM int_orders_enriched",
      lambda s: s.int_orders_enriched.select("order_id", "currency", X.in_home_currency(F.col("order_total"), F.col("currency"), F.col("dkk_rate")).alias("dkk")))

# Validation, deduplication, merge.
query("validate_rates", "SELECT source_locator, rejection_reason FROM rates_checked", lambda s: s.rates_checked.select("source_locator", "rejection_reason"))
query("validate_locations", "SELECT source_locator, rejection_reason FROM locations_checked", lambda s: s.locations_checked.select("source_locator", "rejection_reason"))
query("validate_first_reason", """SELECT source_locator, CASE WHEN coalesce(rate_date, '') = '' OR coalesce(base_currency, '') = '' OR coalesce(quote_currency, '') = '' OR coalesce(rate, '') = '' OR coalesce(retrieved_at, '') = ''
    THEN 'missing_required:' || concat_ws(',', CASE WHEN coalesce(rate_date, '') = '' THEN 'rate_date' END, CASE WHEN coalesce(base_currency, '') = '' THEN 'base_currency' END, CASE WHEN coalesce(quote_currency, '') = '' THEN 'quote_currency' END, CASE WHEN coalesce(rate, '') = '' THEN 'rate' END, CASE WHEN coalesce(retrieved_at, '') = '' THEN 'retrieved_at' END)
    WHEN try_cast(rate_date AS DATE) IS NULL OR try_cast(rate AS DECIMAL(20,10)) IS NULL OR try_cast(retrieved_at AS TIMESTAMP) IS NULL THEN 'invalid_type:rate_date_or_rate_or_retrieved_at'
    WHEN length(trim(base_currency)) <> 3 OR length(trim(quote_currency)) <> 3 THEN 'invalid_currency_code' WHEN upper(trim(base_currency)) = upper(trim(quote_currency)) THEN 'base_currency_equals_quote_currency'
    WHEN try_cast(rate AS DECIMAL(20,10)) <= 0 THEN 'non_positive_rate' END AS reason FROM bronze_rates""",
      lambda s: s.bronze_rates.select("source_locator", R.raw_rate_reason().alias("reason")))
query("validate_first_reason_locations", """SELECT source_locator, CASE WHEN coalesce(location_id, '') = '' OR coalesce(location_name, '') = '' OR coalesce(country_code, '') = '' OR coalesce(timezone, '') = '' OR coalesce(updated_at, '') = ''
    THEN 'missing_required:' || concat_ws(',', CASE WHEN coalesce(location_id, '') = '' THEN 'location_id' END, CASE WHEN coalesce(location_name, '') = '' THEN 'location_name' END, CASE WHEN coalesce(country_code, '') = '' THEN 'country_code' END, CASE WHEN coalesce(timezone, '') = '' THEN 'timezone' END, CASE WHEN coalesce(updated_at, '') = '' THEN 'updated_at' END)
    WHEN try_cast(updated_at AS TIMESTAMP) IS NULL THEN 'invalid_type:updated_at' WHEN upper(trim(country_code)) NOT IN ('DK', 'NO') THEN 'unknown_country_reference' END AS reason FROM bronze_locations""",
      lambda s: s.bronze_locations.select("source_locator", R.raw_location_reason().alias("reason")))
query("contract_violations", """SELECT source_locator, CASE WHEN coalesce(rate_date, '') = '' OR coalesce(base_currency, '') = '' OR coalesce(quote_currency, '') = '' OR coalesce(rate, '') = '' OR coalesce(retrieved_at, '') = ''
    THEN 'missing:' || concat_ws(',', CASE WHEN coalesce(rate_date, '') = '' THEN 'rate_date' END, CASE WHEN coalesce(base_currency, '') = '' THEN 'base_currency' END, CASE WHEN coalesce(quote_currency, '') = '' THEN 'quote_currency' END, CASE WHEN coalesce(rate, '') = '' THEN 'rate' END, CASE WHEN coalesce(retrieved_at, '') = '' THEN 'retrieved_at' END)
    WHEN coalesce(try_cast(rate AS DECIMAL(38,10)), -1) < 0 THEN 'invalid:rate' WHEN try_cast(retrieved_at AS TIMESTAMP) IS NULL THEN 'invalid:retrieved_at' END AS violation FROM bronze_rates""",
      lambda s: s.bronze_rates.select("source_locator", R.contract_reason("exchange_rates", s.bronze_rates.columns).alias("violation")))
query("split_valid_invalid", "SELECT rejection_reason IS NULL AS is_valid, count(*) AS row_count FROM rates_checked GROUP BY ALL",
      lambda s: s.rates_checked.groupBy(F.col("rejection_reason").isNull().alias("is_valid")).agg(n().alias("row_count")))
query("dedup_latest", "SELECT rate_date, base_currency, quote_currency, rate, retrieved_at FROM (SELECT *, row_number() OVER (PARTITION BY rate_date, base_currency, quote_currency ORDER BY retrieved_at DESC NULLS LAST, source_extract_ts DESC NULLS LAST, ingested_at DESC, record_hash DESC, source_locator) AS k FROM rates_checked WHERE rejection_reason IS NULL) WHERE k = 1",
      lambda s: s.winners.select(*RATE_KEYS, "rate", "retrieved_at"))
query("dedup_latest_total_order", "SELECT * FROM winners", lambda s: s.winners)
query("dedup_losers", "SELECT source_locator, 'duplicate_business_key_non_winner' AS rejection_reason FROM rates_ranked WHERE n > 1",
      lambda s: silver.deduplicate(s.rates_checked, "exchange_rates")[1].where(F.col("rejection_reason") == silver.LOSER).select("source_locator", "rejection_reason"))
query("freshness_compare", "SELECT w.rate_date, w.base_currency, w.quote_currency, n.rate_date IS NOT NULL AS is_newer FROM winners w JOIN silver_target t USING (rate_date, base_currency, quote_currency) LEFT JOIN newer_winners n USING (rate_date, base_currency, quote_currency)",
      lambda s: s.winners.alias("s").join(s.silver_target.alias("t"), [F.col(f"s.{k}") == F.col(f"t.{k}") for k in RATE_KEYS]).select(*(F.col(f"s.{k}").alias(k) for k in RATE_KEYS), newer_rate().alias("is_newer")))
query("merge_classify", "SELECT outcome, count(*) AS row_count FROM outcomes GROUP BY ALL",
      lambda s: silver.classify(s.winners, s.silver_target, RATE_KEYS, newer_rate()).groupBy("outcome").agg(n().alias("row_count")))
query("merge_upsert", "SELECT * EXCLUDE (fresh) FROM newer_winners UNION ALL BY NAME SELECT t.* FROM silver_target t WHERE NOT EXISTS (SELECT 1 FROM newer_winners n WHERE n.rate_date = t.rate_date AND n.base_currency = t.base_currency AND n.quote_currency = t.quote_currency)",
      lambda s: silver.upsert(s.silver_target, s.winners, RATE_KEYS, newer_rate()))
query("quarantine_evidence", """SELECT sha256('{"manifest_key":"bronze/rest_api/exchange_rates/m1","source_locator":"' || source_locator || '","record_hash":"' || record_hash || '","rejection_reason":"' || rejection_reason || '"}') AS quarantine_id, source_locator, rejection_reason
  FROM (SELECT source_locator, record_hash, rejection_reason FROM rates_checked WHERE rejection_reason IS NOT NULL UNION ALL SELECT source_locator, record_hash, 'duplicate_business_key_non_winner' FROM rates_ranked WHERE n > 1)""",
      lambda s: silver.evidence(silver.deduplicate(s.rates_checked, "exchange_rates")[1].withColumns({"source_name": F.lit("rest_api"), "source_entity": F.lit("exchange_rates"), "source_payload_json": F.lit("{}")}), BATCH, F.lit(None)).select("quarantine_id", "source_locator", "rejection_reason"))
query("batch_reconciliation", """SELECT count(*) AS input_count, count(*) FILTER (rejection_reason IS NULL) AS accepted_count, count(*) FILTER (rejection_reason IS NOT NULL) AS rejected_count,
  (SELECT count(*) FROM rates_ranked WHERE n > 1) AS duplicate_count, (SELECT count(*) FROM winners) AS unique_winner_count, (SELECT count(*) FROM outcomes WHERE outcome = 'insert') AS inserted_count,
  (SELECT count(*) FROM outcomes WHERE outcome = 'update') AS updated_count, (SELECT count(*) FROM outcomes WHERE outcome = 'unchanged') AS unchanged_count FROM rates_checked""",
      lambda s: silver.counters(s.rates_checked, "exchange_rates", silver.classify(s.winners, s.silver_target, RATE_KEYS, newer_rate())))
query("content_checksum", "SELECT sha256(concat_ws('|', count(*)::VARCHAR, " + ", ".join(f"sum(('0x' || substr(h, {8 * k + 1}, 8))::UBIGINT)::VARCHAR" for k in range(8)) + f")) AS checksum FROM (SELECT sha256({_CUSTOMER}) AS h FROM customer)",
      lambda s: landing.content_checksum(_customers(s)))
query("run_summary", "SELECT count(*) AS outcomes, sum(n_chars)::BIGINT AS record_count, list_sort(list_distinct(list(lang))) AS statuses FROM documents",
      lambda s: s.documents.agg(n().alias("outcomes"), F.sum("n_chars").alias("record_count"), F.array_sort(F.collect_set("lang")).alias("statuses")))
query("schema_evolution_union", "SELECT r_regionkey AS id, r_name AS name, NULL::VARCHAR AS source_note FROM region UNION ALL SELECT n_nationkey, n_name, 'added' FROM nation",
      lambda s: s.region.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name")).unionByName(s.nation.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.lit("added").alias("source_note")), allowMissingColumns=True))
query("skew_group_count", "SELECT base_currency, 2 * count(*) AS row_count FROM rates_typed GROUP BY ALL",
      lambda s: (lambda f: f.unionByName(f).groupBy("base_currency").agg(n().alias("row_count")))(_typed_rates(s).select("base_currency")))
query("broadcast_lookup_left", "SELECT country_code, region, count(*) AS row_count FROM locations_typed GROUP BY ALL",
      lambda s: _typed_locations(s).groupBy("country_code", "region").agg(n().alias("row_count")))
query("isin_filter", "SELECT rate_date, base_currency, manifest_key FROM silver_rates WHERE manifest_key IN ('manifest-EUR', 'manifest-none')",
      lambda s: s.silver_rates.where(F.col("manifest_key").isin("manifest-EUR", "manifest-none")).select("rate_date", "base_currency", "manifest_key"))
query("any_null_or_invalid", "SELECT source_locator FROM rates_typed WHERE rate_date IS NULL OR rate IS NULL OR retrieved_at IS NULL OR rate <= 0",
      lambda s: _typed_rates(s).where(quality.any_null(["rate_date", "rate", "retrieved_at"]) | (F.col("rate") <= 0)).select("source_locator"))
query("route_by_type", "SELECT entity, count(*) AS row_count FROM cdc_positions GROUP BY ALL",
      lambda s: s.cdc_positions.groupBy("entity").agg(n().alias("row_count")))
query("live_rows", "SELECT order_id FROM core_orders WHERE NOT coalesce(is_deleted, false)", lambda s: gold.live(s.core_orders).select("order_id"))

# Dimensional models.
for _name in ("stg_orders", "stg_customers", "stg_payments", "stg_products", "stg_rates", "stg_locations", "int_orders_enriched", "int_payments_enriched",
              "dim_customers", "dim_products", "dim_locations", "dim_date", "fct_orders", "fct_payments", "mart_daily_sales"):
    query(_name, f"SELECT * FROM {_name}", MODELS[_name])
query("stg_orders_v1", "SELECT order_id, customer_id, order_status, CAST(order_ts AS DATE) AS order_date, currency, order_total, updated_at, source_lsn, applied_at FROM core_orders", lambda s: gold.stg_orders_v1(s.core_orders))
query("stg_payments_v1", "SELECT payment_id, order_id, payment_status, CAST(payment_ts AS DATE) AS payment_date, amount, currency, authorization_code, updated_at, source_lsn, applied_at FROM core_payments",
      lambda s: gold.stg_payments_v1(s.core_payments))
query("dim_date_v1", "SELECT date_day, year(date_day)::INTEGER AS calendar_year, month(date_day)::INTEGER AS calendar_month, dayofweek(date_day)::INTEGER AS day_of_week FROM observed_dates",
      lambda s: gold.dim_date_v1(s.stg_orders, s.stg_payments))
query("fct_orders_incremental_candidates", "SELECT * FROM fresh_orders", lambda s: gold.order_candidates(s.fct_orders, s.prior_orders))
query("fct_orders_merge", "SELECT * FROM fresh_orders UNION ALL SELECT t.* FROM prior_orders t WHERE t.order_id NOT IN (SELECT order_id FROM fresh_orders)",
      lambda s: gold.merge_orders(s.fct_orders, s.prior_orders))
query("incremental_watermark_filter", """SELECT order_id FROM fct_orders WHERE source_applied_at >= (SELECT coalesce(max(source_applied_at), TIMESTAMP '1900-01-01') FROM prior_orders WHERE order_date < DATE '1996-01-01')
  OR source_updated_at >= (SELECT coalesce(max(source_updated_at), TIMESTAMP '1900-01-01') FROM prior_orders WHERE order_date < DATE '1996-01-01')""",
      lambda s: gold.watermark_candidates(s.fct_orders, s.prior_orders.where("order_date < DATE '1996-01-01'")).select("order_id"))
query("delete_absent_semi", "SELECT order_id FROM prior_orders WHERE order_id IN (SELECT order_id FROM stg_orders WHERE order_status <> 'cancelled')",
      lambda s: gold.delete_absent(s.prior_orders, s.stg_orders.where("order_status <> 'cancelled'")).select("order_id"))
query("delete_fraction", "SELECT count(*) AS target_count, count(*) FILTER (gone) AS delete_count, round(count(*) FILTER (gone) / count(*)::DOUBLE, 6) AS delete_fraction FROM (SELECT order_id NOT IN (SELECT order_id FROM stg_orders WHERE order_status <> 'cancelled') AS gone FROM prior_orders)",
      lambda s: gold.delete_fraction(s.prior_orders, s.stg_orders.where("order_status <> 'cancelled'")))
query("apply_tombstones", "SELECT CAST(o_orderkey AS VARCHAR) AS order_id FROM orders WHERE NOT (o_orderkey % 23 = 0 AND o_orderkey % 29 <> 0)",
      lambda s: gold.apply_tombstones(s.core_orders, s.core_orders).select("order_id"))
query("mart_daily_sales_v1", "SELECT order_date, source_currency AS currency, order_count, source_customer_count AS customer_count, source_gross_sales AS gross_sales, converted_sales_dkk, missing_rate_order_count FROM mart_daily_sales",
      lambda s: gold.mart_daily_sales_v1(s.fct_orders))
query("mart_customer_value", """SELECT customer_id, max(customer_sk) AS customer_sk, count(*) AS order_count, sum(order_total_dkk)::DECIMAL(18,2) AS known_value_dkk, count(*) FILTER (missing_dkk_rate) AS missing_rate_order_count,
  max(order_date) AS last_order_date, max(orphan_customer::INTEGER) AS orphan_customer_flag FROM fct_orders GROUP BY customer_id""",
      lambda s: gold.mart_customer_value(s.fct_orders))
query("mart_customer_value_v1", """SELECT customer_sk, customer_id, count(*) AS order_count, sum(source_order_total)::DECIMAL(18,2) AS total_spend, ((CAST(sum(source_order_total) * 100 AS BIGINT) * 200 + count(*)) // (2 * count(*))) / 10000.0::DOUBLE AS avg_order_value, max(order_date) AS last_order_date
  FROM fct_orders WHERE customer_sk IS NOT NULL GROUP BY customer_sk, customer_id""",
      lambda s: gold.mart_customer_value_v1(s.fct_orders))
query("reconciliation_orders", """SELECT a.*, b.*, source_key_count - source_distinct_key_count AS source_duplicate_count, gold_key_count - gold_distinct_key_count AS gold_duplicate_count FROM
  (SELECT count(*) AS source_key_count, count(DISTINCT order_id) AS source_distinct_key_count, sum(CASE currency WHEN 'DKK' THEN order_total ELSE 0 END)::DECIMAL(18,2) AS source_dkk_total, sum(CASE currency WHEN 'EUR' THEN order_total ELSE 0 END)::DECIMAL(18,2) AS source_eur_total FROM stg_orders) a,
  (SELECT count(*) AS gold_key_count, count(DISTINCT order_id) AS gold_distinct_key_count, count(*) FILTER (orphan_customer) AS orphan_customer_count, count(*) FILTER (missing_dkk_rate) AS missing_fx_count, sum(order_total_dkk)::DECIMAL(18,2) AS known_converted_total_dkk FROM fct_orders) b""",
      lambda s: gold.reconciliation_orders(s.stg_orders, s.fct_orders))

# Change capture.
query("cdc_op_classify", "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'snapshot_read' WHEN 1 THEN 'create' WHEN 2 THEN 'update' WHEN 3 THEN 'delete' END AS operation FROM events",
      lambda s: s.events.select("event_id", F.try_element_at(F.create_map(*[F.lit(x) for p in cdc.OPERATIONS.items() for x in p]), F.element_at(F.array(*map(F.lit, "rcudx")), (F.col("event_id") % 5 + 1).cast("int"))).alias("operation")))
_MESSAGE_REASON = """CASE WHEN event_id % 23 = 0 THEN NULL WHEN event_id % 29 = 0 THEN 'invalid_json' WHEN event_id % 5 = 4 THEN 'unowned_entity' WHEN event_id % 6 IN (4, 5) THEN 'unsupported_operation'
    WHEN event_id % 6 = 3 AND event_id % 4 = 0 THEN 'delete_with_after' WHEN event_id % 10 = 0 THEN 'missing_lsn' WHEN event_id % 6 = 3 THEN 'missing_primary_key'
    WHEN event_id % 5 = 3 THEN 'missing_primary_key' WHEN event_id % 14 = 0 THEN 'invalid_transaction_order' END"""
query("cdc_envelope_validate", f"SELECT event_id AS off, {_MESSAGE_REASON} AS reason FROM events", lambda s: cdc.parse_debezium(s.messages).select("off", "reason"))
query("cdc_bronze_archive", f"""SELECT event_id AS off, split_part(m.topic, '.', 3) AS entity, CASE WHEN ({_MESSAGE_REASON}) IS NOT NULL THEN 'unparsed' WHEN event_id % 23 = 0 THEN 'tombstone' ELSE substr('rcud', 1 + (event_id % 6)::INTEGER, 1) END AS op,
  m.value AS envelope, '2024-01-01' AS event_date FROM events JOIN messages m ON m.off = event_id""",
      lambda s: cdc.archive(cdc.parse_debezium(s.messages), F.lit("2024-01-01T00:00:00Z")).select("off", "entity", "op", "envelope", "event_date"))
_GOOD = f"SELECT event_id, split_part(m.topic, '.', 3) AS entity, m.topic, m.value FROM events JOIN messages m ON m.off = event_id WHERE m.value IS NOT NULL AND ({_MESSAGE_REASON}) IS NULL"
_AT = "2024-01-01 00:00:00"
_TEXT = lambda c: f"json_extract_string(value, '$.after.{c}')"
_KEYS = {f"{e[:-1]}_id": f"coalesce({_TEXT(f'{e[:-1]}_id')}, CASE WHEN entity = '{e}' THEN NULL END)" for e in S.CDC_ENTITIES}
_POSITION = {"source_lsn": "CAST(event_id AS VARCHAR)", "source_tx_id": "NULL::VARCHAR", "transaction_id": "'t1'", "transaction_total_order": "3::BIGINT", "transaction_data_collection_order": "NULL::BIGINT",
             "source_event_ts": "CAST(1700000000000 + event_id AS VARCHAR)", "kafka_topic": "topic", "kafka_partition": "0", "kafka_offset": "event_id", "applied_at": f"TIMESTAMP '{_AT}'"}
_WIDE = "SELECT " + ", ".join(f"{({'entity': 'entity'} | _KEYS | _POSITION).get(c, _TEXT(c))} AS {c}" for c in S.WIDE) + f" FROM ({_GOOD})"
_wide = lambda s: cdc.wide(cdc.parse_debezium(s.messages).where("reason IS NULL AND value IS NOT NULL"), F.lit(_AT).cast(DAY))
query("cdc_wide_rows", _WIDE, _wide)
query("cdc_core_orders", f"SELECT order_id, customer_id, order_status, order_ts, currency, CAST(order_total AS DECIMAL(12,2)) AS order_total, NULL::VARCHAR AS updated_at, {', '.join(_POSITION)} FROM ({_WIDE}) WHERE entity = 'orders'",
      lambda s: cdc.narrow(_wide(s), "orders"))
query("cdc_event_json", "SELECT seq, entity, pk, op, lsn FROM cdc_positions", lambda s: cdc.from_event(cdc.to_event(s.cdc_positions), s.cdc_positions.schema.simpleString()).select("seq", "entity", "pk", "op", "lsn"))
query("cdc_decisions_dms", "SELECT entity, pk, seq, decision FROM fold_positions", lambda s: cdc.position_decisions(s.cdc_positions).select("entity", "pk", "seq", "decision"))
query("cdc_decisions_debezium", "SELECT entity, pk, seq, decision FROM fold_log", lambda s: cdc.log_decisions(s.cdc_log).select("entity", "pk", "seq", "decision"))
query("cdc_decision_histogram", "SELECT decision, count(*) AS row_count FROM fold_positions GROUP BY ALL",
      lambda s: cdc.position_decisions(s.cdc_positions).groupBy("decision").agg(n().alias("row_count")))
query("cdc_current_state", "SELECT entity, pk, seq, lsn, hash, op = 'delete' AS is_deleted FROM fold_positions WHERE decision LIKE 'applied%' QUALIFY row_number() OVER (PARTITION BY entity, pk ORDER BY seq DESC) = 1",
      lambda s: cdc.current_state(cdc.position_decisions(s.cdc_positions)).select("entity", "pk", "seq", "lsn", "hash", "is_deleted"))
query("cdc_quarantine", """SELECT seq, CASE decision WHEN 'stale' THEN 'stale_source_position' WHEN 'conflict' THEN 'same_position_different_content' ELSE 'incomparable_source_position' END AS rejection_reason FROM fold_positions WHERE decision IN ('stale', 'conflict', 'incomparable')""",
      lambda s: cdc.quarantine_reasons(cdc.position_decisions(s.cdc_positions)).select("seq", "rejection_reason"))
query("cdc_changelog", """SELECT entity, pk, seq, CASE WHEN op = 'delete' THEN 'delete' WHEN there THEN 'update_after' ELSE 'insert' END AS change_type FROM
  (SELECT *, coalesce(lag(op <> 'delete') OVER (PARTITION BY entity, pk ORDER BY seq), false) AS there FROM fold_positions WHERE decision LIKE 'applied%') WHERE op <> 'delete' OR there""",
      lambda s: cdc.changelog(cdc.position_decisions(s.cdc_positions)).select("entity", "pk", "seq", "change_type"))
query("event_dedup_by_id", "SELECT * FROM (SELECT * FROM events UNION ALL SELECT * FROM events) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1",
      lambda s: stream.once_by_id(s.events.unionByName(s.events)))

# Reconciliation and quality.
query("anti_join_keys", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')",
      lambda s: s.customer.join(s.orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti").select("c_custkey"))
_SOURCE = "SELECT order_id FROM stg_orders WHERE CAST(order_id AS BIGINT) % 7 <> 0"
query("recon_bidirectional_anti", f"""SELECT 'source_not_silver' AS exception_type, order_id FROM ({_SOURCE}) WHERE order_id NOT IN (SELECT order_id FROM prior_orders)
  UNION ALL SELECT 'silver_not_source', order_id FROM prior_orders WHERE order_id NOT IN ({_SOURCE})""",
      lambda s: quality.missing_both_ways(s.stg_orders.where(F.col("order_id").cast("bigint") % 7 != 0), s.prior_orders, "order_id", ("source_not_silver", "silver_not_source")))
query("recon_left_is_null", "SELECT 'silver_not_gold' AS exception_type, c.order_id FROM core_orders c LEFT JOIN stg_orders s ON c.order_id = s.order_id WHERE s.order_id IS NULL",
      lambda s: s.core_orders.alias("c").join(s.stg_orders.alias("s"), F.col("c.order_id") == F.col("s.order_id"), "left").where("s.order_id IS NULL").select(F.lit("silver_not_gold").alias("exception_type"), F.col("c.order_id").alias("order_id")))
#: By day of the month, a mart with one value off, one after the other, and days that are not there.
_OFF = {"order_count": (3, "order_count + 1"), "source_customer_count": (4, "source_customer_count - 1"), "converted_sales_dkk": (5, "NULL"), "source_gross_sales": (6, "CAST(source_gross_sales + 1 AS DECIMAL(18,2))"),
        "missing_rate_order_count": (7, "missing_rate_order_count + 2"), "orphan_customer_order_count": (8, "NULL")}
_OFF = {c: f"CASE WHEN day(order_date) = {day} THEN {value} ELSE {c} END" for c, (day, value) in _OFF.items()}
_ALTERED = "SELECT order_date, source_currency, " + ", ".join(f"{case} AS {c}" for c, case in _OFF.items()) + " FROM mart_daily_sales WHERE day(order_date) <> 9"
query("recon_full_outer", f"SELECT coalesce(e.order_date, a.order_date) AS order_date, coalesce(e.source_currency, a.source_currency) AS source_currency FROM mart_daily_sales e FULL JOIN ({_ALTERED}) a ON e.order_date = a.order_date AND e.source_currency = a.source_currency WHERE "
      + " OR ".join(f"e.{c} IS DISTINCT FROM a.{c}" for c in _OFF),
      lambda s: quality.mismatches(s.mart_daily_sales, s.mart_daily_sales.where("day(order_date) <> 9").selectExpr("order_date", "source_currency", *(f"{case} AS {c}" for c, case in _OFF.items())), ["order_date", "source_currency"], list(_OFF)))
query("orphan_payments", "SELECT payment_id, source_order_id FROM fct_payments WHERE matched_order_id IS NULL",
      lambda s: quality.orphans(s.fct_payments, "source_order_id", s.fct_orders, "order_id").select("payment_id", "source_order_id"))
query("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS row_count FROM lineitem GROUP BY ALL HAVING count(*) > 1",
      lambda s: quality.duplicate_keys(s.lineitem, ["l_orderkey", "l_linenumber"]))
query("null_required_count", "SELECT count(*) FILTER (rate_date IS NULL) AS null_rate_date, count(*) FILTER (rate IS NULL) AS null_rate FROM bronze_rates",
      lambda s: s.bronze_rates.agg(F.count_if(F.col("rate_date").isNull()).alias("null_rate_date"), F.count_if(F.col("rate").isNull()).alias("null_rate")))
query("distinct_key_count", "SELECT count(*) AS key_count FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)",
      lambda s: s.lineitem.select("l_orderkey", "l_linenumber").distinct().agg(n().alias("key_count")))
query("exists_evidence", "SELECT count(*) FILTER (orphan_customer AND customer_sk IS NULL) = 0 AS customer_orphan_lost, (SELECT count(*) = 0 FROM fct_payments WHERE matched_order_id IS NULL AND orphan_order) AS payment_orphan_lost FROM fct_orders",
      lambda s: s.fct_orders.agg((F.count_if(F.col("orphan_customer") & F.col("customer_sk").isNull()) == 0).alias("customer_orphan_lost")).crossJoin(s.fct_payments.agg((F.count_if(F.col("matched_order_id").isNull() & F.col("orphan_order")) == 0).alias("payment_orphan_lost"))))
query("test_not_null", "SELECT order_id FROM fct_orders WHERE dkk_rate IS NULL", lambda s: quality.not_null(s.fct_orders, "dkk_rate").select("order_id"))
query("test_accepted_values", "SELECT customer_id, customer_status FROM stg_customers WHERE customer_status NOT IN ('ACTIVE', 'INACTIVE', 'SUSPENDED')",
      lambda s: quality.accepted_values(s.stg_customers, "customer_status", S.ACCEPTED["customer_status"]).select("customer_id", "customer_status"))
query("test_relationships", "SELECT order_id FROM stg_orders WHERE customer_id NOT IN (SELECT customer_id FROM dim_customers)",
      lambda s: quality.orphans(s.stg_orders, "customer_id", s.dim_customers, "customer_id").select("order_id"))
query("test_nonnegative", "SELECT order_id AS business_key FROM fct_orders WHERE source_order_total - 50000 < 0 UNION ALL SELECT payment_id FROM fct_payments WHERE source_amount - 5000 < 0",
      lambda s: s.fct_orders.where("source_order_total - 50000 < 0").select(F.col("order_id").alias("business_key")).union(s.fct_payments.where("source_amount - 5000 < 0").select("payment_id")))
_CONTRACT = """(source_currency = 'DKK' AND order_total_dkk <> source_order_total) OR (source_currency <> 'DKK' AND dkk_rate > 0 AND order_total_dkk <> CAST(round(source_order_total * dkk_rate, 2) AS DECIMAL(18,2)))
  OR (source_currency <> 'DKK' AND dkk_rate IS NULL AND (order_total_dkk IS NOT NULL OR NOT missing_dkk_rate))"""
#: Some facts are broken on purpose, in each of the three ways; the check has to find these and no others.
_BROKEN = {"order_total_dkk": "CASE WHEN CAST(order_id AS BIGINT) % 11 = 0 THEN CAST(coalesce(order_total_dkk, 0) + 0.01 AS DECIMAL(18,2)) ELSE order_total_dkk END",
           "missing_dkk_rate": "CASE WHEN CAST(order_id AS BIGINT) % 13 = 0 THEN false ELSE missing_dkk_rate END"}
query("test_conversion_contract", f"SELECT order_id FROM (SELECT * REPLACE ({', '.join(f'{case} AS {c}' for c, case in _BROKEN.items())}) FROM fct_orders) WHERE {_CONTRACT}",
      lambda s: s.fct_orders.withColumns({c: F.expr(case) for c, case in _BROKEN.items()}).where(_CONTRACT).select("order_id"))
query("test_valid_rates", "SELECT source_locator FROM rates_typed WHERE rate <= 0 OR base_currency = quote_currency OR rate_date IS NULL",
      lambda s: _typed_rates(s).where("rate <= 0 OR base_currency = quote_currency OR rate_date IS NULL").select("source_locator"))
_STALE = "SELECT seq, lsn, max(lsn) OVER (PARTITION BY entity, pk ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM fold_positions WHERE decision LIKE 'applied%' AND op <> 'load'"
query("quality_gate_summary", f"""SELECT gate_id, classification, failures::BIGINT AS failures, CASE WHEN classification = 'INFORMATIONAL' THEN 'recorded' WHEN failures = 0 THEN 'passed' WHEN classification = 'BLOCKING' THEN 'blocked' ELSE 'reported' END AS status FROM (
  SELECT 'Q01' AS gate_id, 'BLOCKING' AS classification, (SELECT count(*) FROM (SELECT order_id FROM stg_orders GROUP BY 1 HAVING count(*) > 1)) AS failures
  UNION ALL SELECT 'Q02', 'BLOCKING', (SELECT count(*) FROM ({_STALE}) WHERE lsn < top)
  UNION ALL SELECT 'Q03', 'BLOCKING', (SELECT count(*) FROM rates_checked WHERE rejection_reason IS NOT NULL)
  UNION ALL SELECT 'Q04', 'BLOCKING', (SELECT count(*) FROM (SELECT ingestion_id, source_locator FROM bronze_rates GROUP BY ALL HAVING count(*) > 1))
  UNION ALL SELECT 'Q05', 'BLOCKING', (SELECT count(*) FROM fct_orders WHERE order_id IS NULL OR source_order_total < 0 OR date_sk IS NULL)
  UNION ALL SELECT 'Q06', 'WARNING', (SELECT count(*) FROM fct_orders WHERE missing_dkk_rate)
  UNION ALL SELECT 'Q07', 'WARNING', (SELECT count(*) FROM fct_payments WHERE matched_order_id IS NULL)
  UNION ALL SELECT 'Q08', 'WARNING', (SELECT count(*) FROM rates_ranked WHERE n > 1) + (SELECT count(*) FROM rates_checked WHERE rejection_reason IS NOT NULL)
  UNION ALL SELECT 'Q09', 'INFORMATIONAL', (SELECT count(DISTINCT manifest_key) FROM silver_rates)
  UNION ALL SELECT 'Q10', 'INFORMATIONAL', (SELECT date_diff('hour', max(order_ts), max(ingested_at)) FROM core_orders))""",
      lambda s: quality.gate(_gates(s)))


def _gates(s: Source) -> list[DataFrame]:
    """Each model once: the gates that look at it are counts of one aggregate."""
    applied = cdc.position_decisions(s.cdc_positions).where(F.col("decision").isin(*cdc.APPLIED) & (F.col("op") != "load"))
    top = F.max("lsn").over(Window.partitionBy("entity", "pk").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    counters = silver.counters(s.rates_checked, "exchange_rates", s.rates_checked.limit(0).select(F.lit("none").alias("outcome")))
    facts = s.fct_orders.agg(
        F.count_if(F.col("order_id").isNull() | (F.col("source_order_total") < 0) | F.col("date_sk").isNull()).alias("Q05"), F.count_if("missing_dkk_rate").alias("Q06")
    )
    return [
        quality.key_excess(s.stg_orders, ["order_id"], "Q01"),
        applied.withColumn("_top", top).agg(F.count_if(F.col("lsn") < F.col("_top")).alias("Q02")),
        counters.select(F.col("rejected_count").alias("Q03"), (F.col("rejected_count") + F.col("duplicate_count")).alias("Q08")),
        quality.key_excess(s.bronze_rates, ["ingestion_id", "source_locator"], "Q04"),
        facts,
        s.int_payments_enriched.agg(F.count_if("orphan_order").alias("Q07")),
        s.silver_rates.agg(F.count_distinct("manifest_key").alias("Q09")),
        s.core_orders.agg(F.timestamp_diff("HOUR", F.max("order_ts"), F.max("ingested_at")).alias("Q10")),
    ]


#: What reconciles with what: (keys that only one side has, or whose values differ) or a count of exceptions.
_RECON = {
    "R01": "SELECT count(*) FROM (SELECT CAST(o_orderkey AS VARCHAR) AS k, CAST(o_totalprice AS DECIMAL(18,2)) AS v FROM orders) s FULL JOIN stg_orders c ON s.k = c.order_id WHERE s.k IS NULL OR c.order_id IS NULL OR s.v <> c.order_total",
    "R02": "SELECT count(*) FROM (SELECT DISTINCT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS k FROM lineitem) s FULL JOIN stg_payments c ON s.k = c.payment_id WHERE s.k IS NULL OR c.payment_id IS NULL",
    "R03": "SELECT count(*) FROM stg_orders s FULL JOIN fct_orders g ON s.order_id = g.order_id WHERE s.order_id IS NULL OR g.order_id IS NULL OR s.order_total <> g.source_order_total",
    "R04": "SELECT count(*) FROM stg_payments s FULL JOIN fct_payments g ON s.payment_id = g.payment_id WHERE s.payment_id IS NULL OR g.payment_id IS NULL OR s.amount <> g.source_amount",
    "R05": "SELECT count(*) FROM (SELECT order_date, source_currency, sum(source_order_total)::DECIMAL(18,2) AS v FROM fct_orders GROUP BY ALL) e FULL JOIN mart_daily_sales a ON e.order_date = a.order_date AND e.source_currency = a.source_currency WHERE e.v IS DISTINCT FROM a.source_gross_sales",
    "R06": "SELECT count(*) FROM fct_orders WHERE missing_dkk_rate",
    "R07": "SELECT count(*) FROM fct_payments p WHERE source_order_id NOT IN (SELECT order_id FROM fct_orders)",
    "R08": "SELECT count(*) FROM core_orders c JOIN fct_orders g ON c.order_id = g.order_id WHERE coalesce(c.is_deleted, false)",
    "R09": "SELECT count(*) FROM (SELECT order_id FROM core_orders GROUP BY 1 HAVING count(*) > 1)",
    "R10": "SELECT count(*) FROM core_orders WHERE order_id IS NULL OR customer_id IS NULL OR source_lsn IS NULL",
}


def _recon(s: Source) -> list[DataFrame]:
    total = lambda frame, name: frame.agg(n().alias(name))
    orders = s.orders.select(F.col("o_orderkey").cast("string").alias("order_id"), F.col("o_totalprice").cast("decimal(18,2)").alias("order_total"))
    payments = s.lineitem.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).cast("string").alias("payment_id")).distinct()
    staged, facts = s.stg_orders.select("order_id", "order_total"), s.fct_orders
    paid = s.fct_payments.select("payment_id", F.col("source_amount").alias("amount"), "source_order_id")
    sums = facts.groupBy("order_date", "source_currency").agg(F.sum("source_order_total").cast("decimal(18,2)").alias("source_gross_sales"))
    ledger = s.core_orders.agg(F.count_if(quality.any_null(["order_id", "customer_id", "source_lsn"])).alias("R10"))
    return [
        quality.one_sided(orders, staged, "order_id", "R01", ["order_total"]), quality.one_sided(payments, s.stg_payments.select("payment_id"), "payment_id", "R02"),
        quality.one_sided(staged, facts.select("order_id", F.col("source_order_total").alias("order_total")), "order_id", "R03", ["order_total"]),
        quality.one_sided(s.stg_payments.select("payment_id", "amount"), paid.drop("source_order_id"), "payment_id", "R04", ["amount"]),
        total(quality.mismatches(sums, s.mart_daily_sales, ["order_date", "source_currency"], ["source_gross_sales"]), "R05"),
        facts.agg(F.count_if("missing_dkk_rate").alias("R06")), total(quality.orphans(paid, "source_order_id", facts, "order_id"), "R07"),
        total(s.core_orders.where(F.coalesce("is_deleted", F.lit(False))).select("order_id").join(facts.select("order_id"), "order_id"), "R08"),
        quality.key_excess(s.core_orders, ["order_id"], "R09"), ledger,
    ]


query("reconciliation_catalog", " UNION ALL ".join(f"SELECT '{k}' AS check_id, ({sql})::BIGINT AS exceptions" for k, sql in _RECON.items()), lambda s: quality.counted(_recon(s), "check_id", "exceptions"))
_STATUS = """SELECT i.rate_date, i.base_currency, i.quote_currency, CASE WHEN c.record_hash IS NULL THEN 'missing' WHEN c.record_hash = i.record_hash AND day(i.rate_date) % 3 = 2 THEN 'exact'
  WHEN (c.retrieved_at, coalesce(c.source_extract_ts, TIMESTAMP '1900-01-01'), c.ingested_at, c.record_hash) > (i.retrieved_at, coalesce(i.source_extract_ts, TIMESTAMP '1900-01-01'), i.ingested_at, i.record_hash) THEN 'superseded' ELSE 'conflict' END AS status
  FROM winners i LEFT JOIN (SELECT * REPLACE (CASE WHEN day(rate_date) % 3 = 2 THEN record_hash ELSE 'other' END AS record_hash) FROM silver_target) c USING (rate_date, base_currency, quote_currency)"""


def _statuses(s: Source) -> DataFrame:
    current = s.silver_target.withColumn("record_hash", F.when(F.dayofmonth("rate_date") % 3 == 2, F.col("record_hash")).otherwise("other"))
    return backfill.statuses(s.winners, current, RATE_KEYS, newer_rate("c", "i"))


query("backfill_status", _STATUS, _statuses)
query("backfill_summary", f"SELECT status, count(*) AS row_count FROM ({_STATUS}) GROUP BY ALL", lambda s: _statuses(s).groupBy("status").agg(n().alias("row_count")))
