"""Entities as data: fields, keys, versions and value domains."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Entity:
    """required: fields a source record must fill; key: its natural key; extracted: its extract timestamp;
    amount: a number that may not be negative; whole: a field that must be an integer."""

    required: tuple[str, ...]
    key: tuple[str, ...]
    extracted: str | None
    amount: str | None = None
    whole: str | None = None


#: The sources' fields and keys.
ENTITIES = {
    "customers": Entity(("customer_id", "customer_name", "customer_status", "created_at", "updated_at"), ("customer_id",), "updated_at"),
    "products": Entity(("product_id", "product_name", "category_code", "unit_price", "currency", "updated_at"), ("product_id",), "updated_at", "unit_price"),
    "orders": Entity(("order_id", "customer_id", "order_status", "order_ts", "currency", "order_total", "updated_at"), ("order_id",), "updated_at", "order_total"),
    "payments": Entity(("payment_id", "order_id", "payment_status", "payment_ts", "amount", "currency", "updated_at"), ("payment_id",), "updated_at", "amount"),
    "exchange_rates": Entity(("rate_date", "base_currency", "quote_currency", "rate", "retrieved_at"), ("rate_date", "base_currency", "quote_currency"), "retrieved_at", "rate"),
    "locations": Entity(("location_id", "location_name", "country_code", "timezone", "updated_at"), ("location_id",), "updated_at"),
    "product_categories": Entity(("category_code", "category_name", "sort_order"), ("category_code",), None, whole="sort_order"),
    "devices": Entity(("device_id", "location_id", "device_type", "device_status", "updated_at"), ("device_id",), "updated_at"),
}
#: Fields that hold ISO timestamps wherever they occur.
TIMESTAMPS = ("created_at", "updated_at", "order_ts", "payment_ts", "retrieved_at")
#: Who may write what (reference entities come in batches, the others by change capture), versions, regions.
BATCH_ENTITIES = ("exchange_rates", "locations")
CDC_ENTITIES = ("customers", "products", "orders", "payments")
BUSINESS_VERSION = {"exchange_rates": "retrieved_at", "locations": "updated_at"}
COUNTRY_REGIONS = {"DK": "nordics", "NO": "nordics"}
#: The columns of landed, silver and ledger rows.
ENVELOPE = (
    "ingestion_id", "source_name", "source_entity", "source_record_key", "source_extract_ts",
    "ingested_at", "source_version", "source_locator", "record_hash",
)
PROVENANCE = (
    "source_payload_json string, ingestion_id string, source_name string, source_entity string, source_record_key string, "
    "source_extract_ts timestamp, ingested_at timestamp, source_version string, source_locator string, record_hash string, "
    "manifest_key string, logical_date date, interval_start timestamp, interval_end timestamp"
)
SILVER = {
    "exchange_rates": "rate_date date, base_currency string, quote_currency string, rate decimal(20,10), retrieved_at timestamp, provider_name string, " + PROVENANCE,
    "locations": "location_id string, location_name string, country_code string, timezone string, region string, updated_at timestamp, location_type string, " + PROVENANCE,
}
LEDGER = {
    "customers": "customer_id string, customer_name string, email string, customer_status string, created_at timestamp, updated_at timestamp",
    "products": "product_id string, product_name string, category_code string, unit_price decimal(18,2), currency string, updated_at timestamp",
    "orders": "order_id string, customer_id string, order_status string, order_ts timestamp, currency string, order_total decimal(18,2), updated_at timestamp",
    "payments": "payment_id string, order_id string, payment_status string, payment_ts timestamp, amount decimal(18,2), currency string, authorization_code string, updated_at timestamp",
}
LEDGER_COMMON = (
    "payload_json string, is_deleted boolean, source_schema string, source_table string, primary_key_value string, "
    "source_lsn string, source_lsn_int decimal(20,0), transaction_id string, transaction_record_id bigint, dms_operation string, "
    "source_event_at timestamp, applied_at timestamp, ingested_at timestamp, record_hash string, event_hash string, raw_event_json string"
)
#: One row shape for all change-captured entities, and each entity's part of it.
WIDE = (
    "entity", "customer_id", "customer_name", "email", "customer_status", "created_at", "preferred_language",
    "product_id", "product_name", "category_code", "unit_price", "order_id", "order_status", "order_ts", "order_total",
    "payment_id", "payment_status", "payment_ts", "amount", "currency", "authorization_code",
    "source_lsn", "source_tx_id", "transaction_id", "transaction_total_order", "transaction_data_collection_order",
    "source_event_ts", "kafka_topic", "kafka_partition", "kafka_offset", "applied_at",
)
NARROW = {
    "customers": ("customer_id", "customer_name", "email", "customer_status", "created_at", "preferred_language"),
    "products": ("product_id", "product_name", "category_code", "unit_price", "currency"),
    "orders": ("order_id", "customer_id", "order_status", "order_ts", "currency", "order_total"),
    "payments": ("payment_id", "order_id", "payment_status", "payment_ts", "amount", "currency", "authorization_code"),
}
#: Value domains.
ACCEPTED = {
    "customer_status": ("ACTIVE", "INACTIVE", "SUSPENDED"),
    "order_status": ("created", "completed", "cancelled"),
    "payment_status": ("authorized", "completed", "failed", "refunded"),
}
