"""Dimensional models: functions from frames to frames, so a chain of them is one plan."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import silver

MONEY = "decimal(18,2)"
Rows = Callable[[str], DataFrame]


def live(ledger: DataFrame) -> DataFrame:
    return ledger.where(~F.coalesce("is_deleted", F.lit(False)))


def stg_customers(ledger: DataFrame) -> DataFrame:
    return live(ledger).select(
        "customer_id", "customer_name", "email", F.upper("customer_status").alias("customer_status"),
        "created_at", "updated_at", "source_lsn", "applied_at", "ingested_at", "record_hash",
    )


def stg_products(ledger: DataFrame) -> DataFrame:
    return live(ledger).select(
        "product_id", "product_name", "category_code", F.col("unit_price").cast(MONEY).alias("unit_price"),
        F.upper("currency").alias("currency"), "updated_at", "source_lsn", "applied_at", "ingested_at", "record_hash",
    )


def stg_orders(ledger: DataFrame) -> DataFrame:
    return live(ledger).select(
        "order_id", "customer_id", F.lower("order_status").alias("order_status"), "order_ts",
        F.col("order_ts").cast("date").alias("order_date"), F.upper("currency").alias("currency"),
        F.col("order_total").cast(MONEY).alias("order_total"), "updated_at", "source_lsn", "applied_at", "ingested_at", "record_hash",
    )


def stg_payments(ledger: DataFrame) -> DataFrame:
    return live(ledger).select(
        "payment_id", "order_id", F.lower("payment_status").alias("payment_status"), "payment_ts",
        F.col("payment_ts").cast("date").alias("payment_date"), F.col("amount").cast(MONEY).alias("amount"),
        F.upper("currency").alias("currency"), "authorization_code", "updated_at", "source_lsn", "applied_at", "ingested_at", "record_hash",
    )


def stg_orders_v1(ledger: DataFrame) -> DataFrame:
    """The first version's staging: columns as they are, deleted rows too."""
    return ledger.select("order_id", "customer_id", "order_status", F.col("order_ts").cast("date").alias("order_date"), "currency", "order_total", "updated_at", "source_lsn", "applied_at")


def stg_payments_v1(ledger: DataFrame) -> DataFrame:
    return ledger.select(
        "payment_id", "order_id", "payment_status", F.col("payment_ts").cast("date").alias("payment_date"), "amount", "currency",
        "authorization_code", "updated_at", "source_lsn", "applied_at",
    )


def stg_rates(silver: DataFrame) -> DataFrame:
    return silver.select(
        F.col("rate_date").cast("date").alias("rate_date"), F.upper("base_currency").alias("base_currency"),
        F.upper("quote_currency").alias("quote_currency"), F.col("rate").cast("decimal(20,10)").alias("rate"), "retrieved_at",
        "provider_name", "source_extract_ts", "ingested_at", "record_hash", "manifest_key",
    )


def stg_locations(silver: DataFrame) -> DataFrame:
    return silver.select(
        "location_id", "location_name", F.upper("country_code").alias("country_code"), "timezone", "region", "updated_at",
        "location_type", "source_extract_ts", "ingested_at", "record_hash", "manifest_key",
    )


def _enriched(orders: DataFrame, rates: DataFrame, customers: DataFrame) -> DataFrame:
    """Orders with the rate of their day, the home amount, what is missing, and ``_customer_sk``; customers are looked up once."""
    usable = rates.where((F.col("quote_currency") == X.HOME) & (F.col("rate") > 0)).select(
        F.col("rate_date").alias("order_date"), F.col("base_currency").alias("currency"), F.col("rate").alias("dkk_rate"),
        F.col("retrieved_at").alias("fx_retrieved_at"), F.col("source_extract_ts").alias("fx_source_extract_ts"),
        F.col("ingested_at").alias("fx_ingested_at"), F.col("record_hash").alias("fx_record_hash"),
    )
    known = customers.select("customer_id", X.surrogate_key(F.col("customer_id")).alias("_customer_sk"))
    joined = orders.join(usable, ["order_date", "currency"], "left").join(known, "customer_id", "left")
    return joined.select(
        *(orders.columns), "dkk_rate", "fx_retrieved_at", "fx_source_extract_ts", "fx_ingested_at", "fx_record_hash",
        X.in_home_currency(F.col("order_total"), F.col("currency"), F.col("dkk_rate")).alias("order_total_dkk"),
        F.coalesce((F.col("currency") != X.HOME) & F.col("dkk_rate").isNull(), F.lit(False)).alias("missing_dkk_rate"),
        F.col("_customer_sk").isNull().alias("orphan_customer"), "_customer_sk",
    )


def int_orders_enriched(orders: DataFrame, rates: DataFrame, customers: DataFrame) -> DataFrame:
    return _enriched(orders, rates, customers).drop("_customer_sk")


def int_payments_enriched(payments: DataFrame, orders: DataFrame) -> DataFrame:
    of = orders.select("order_id", "customer_id", "order_date", F.lit(True).alias("_found"))
    joined = payments.join(of, "order_id", "left")
    return joined.select(*payments.columns, "customer_id", "order_date", F.col("_found").isNull().alias("orphan_order"))


def dim_customers(customers: DataFrame) -> DataFrame:
    return customers.select(X.surrogate_key(F.col("customer_id")).alias("customer_sk"), "*")


def dim_products(products: DataFrame) -> DataFrame:
    return products.select(X.surrogate_key(F.col("product_id")).alias("product_sk"), "*")


def dim_locations(locations: DataFrame) -> DataFrame:
    return locations.select(X.surrogate_key(F.col("location_id")).alias("location_sk"), "*")


def observed_dates(orders: DataFrame, payments: DataFrame) -> DataFrame:
    days = orders.select(F.col("order_date").alias("date_day")).union(payments.select("payment_date"))
    return days.where("date_day IS NOT NULL").distinct()


def dim_date(orders: DataFrame, payments: DataFrame) -> DataFrame:
    day = F.col("date_day")
    return observed_dates(orders, payments).select(
        X.surrogate_key(day).alias("date_sk"), "date_day", F.year(day).alias("calendar_year"),
        F.month(day).alias("calendar_month"), F.dayofmonth(day).alias("day_of_month"),
    )


def dim_date_v1(orders: DataFrame, payments: DataFrame) -> DataFrame:
    """Days of the week count from Sunday, 0."""
    day = F.col("date_day")
    return observed_dates(orders, payments).select(
        "date_day", F.year(day).alias("calendar_year"), F.month(day).alias("calendar_month"), (F.dayofweek(day) - 1).alias("day_of_week")
    )


def _dated(frame: DataFrame, column: str, dates: DataFrame | None) -> DataFrame:
    """``frame`` with the ``date_sk`` of a column: from ``dates``, or, as ``dim_date`` holds every observed day, from the day itself."""
    if dates is None:
        return frame.withColumn("date_sk", F.when(F.col(column).isNotNull(), X.surrogate_key(F.col(column))))
    return frame.join(dates.select(F.col("date_day").alias(column), "date_sk"), column, "left")


def fct_orders(orders: DataFrame, rates: DataFrame, customers: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    return _dated(_enriched(orders, rates, customers), "order_date", dates).select(
        "order_id", F.col("_customer_sk").alias("customer_sk"), "date_sk", "customer_id", "order_date", "order_ts", "order_status",
        F.col("currency").alias("source_currency"), F.col("order_total").cast(MONEY).alias("source_order_total"),
        F.col("dkk_rate").cast("decimal(20,10)").alias("dkk_rate"), F.col("order_total_dkk").cast(MONEY).alias("order_total_dkk"),
        "missing_dkk_rate", "orphan_customer", "fx_retrieved_at", "fx_source_extract_ts", "fx_ingested_at", "fx_record_hash",
        F.col("updated_at").alias("source_updated_at"), "source_lsn", F.col("applied_at").alias("source_applied_at"),
        F.col("ingested_at").alias("source_ingested_at"), F.col("record_hash").alias("source_record_hash"),
    )


def order_keys(orders: DataFrame, customers: DataFrame) -> DataFrame:
    """The two columns of ``fct_orders`` that payments need, without the rates and dates behind the others."""
    return orders.select("order_id", "customer_id").join(customers.select("customer_id", "customer_sk"), "customer_id", "left").select("order_id", "customer_sk")


def fct_payments(enriched: DataFrame, orders: DataFrame, dates: DataFrame | None = None) -> DataFrame:
    matched = orders.select(F.col("order_id"), F.col("order_id").alias("matched_order_id"), "customer_sk")
    return _dated(enriched.join(matched, "order_id", "left"), "payment_date", dates).select(
        "payment_id", "matched_order_id", F.col("order_id").alias("source_order_id"), "customer_sk", "date_sk", "payment_date",
        "payment_ts", "payment_status", F.col("currency").alias("source_currency"), F.col("amount").cast(MONEY).alias("source_amount"),
        "authorization_code", "orphan_order", F.col("updated_at").alias("source_updated_at"), "source_lsn",
        F.col("applied_at").alias("source_applied_at"), F.col("ingested_at").alias("source_ingested_at"),
        F.col("record_hash").alias("source_record_hash"),
    )


def mart_daily_sales(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_date", "source_currency").agg(
        F.count(F.lit(1)).alias("order_count"), F.countDistinct("customer_id").alias("source_customer_count"),
        F.sum("source_order_total").cast(MONEY).alias("source_gross_sales"), F.sum("order_total_dkk").cast(MONEY).alias("converted_sales_dkk"),
        F.count_if("missing_dkk_rate").alias("missing_rate_order_count"), F.count_if("orphan_customer").alias("orphan_customer_order_count"),
    )


def mart_daily_sales_v1(orders: DataFrame) -> DataFrame:
    return orders.groupBy("order_date", F.col("source_currency").alias("currency")).agg(
        F.count(F.lit(1)).alias("order_count"), F.countDistinct("customer_id").alias("customer_count"),
        F.sum("source_order_total").cast(MONEY).alias("gross_sales"), F.sum("order_total_dkk").cast(MONEY).alias("converted_sales_dkk"),
        F.count_if("missing_dkk_rate").alias("missing_rate_order_count"),
    )


def mart_customer_value(orders: DataFrame) -> DataFrame:
    return orders.groupBy("customer_id").agg(
        F.max("customer_sk").alias("customer_sk"), F.count(F.lit(1)).alias("order_count"),
        F.sum("order_total_dkk").cast(MONEY).alias("known_value_dkk"), F.count_if("missing_dkk_rate").alias("missing_rate_order_count"),
        F.max("order_date").alias("last_order_date"), F.max(F.col("orphan_customer").cast("int")).alias("orphan_customer_flag"),
    )


def mart_customer_value_v1(orders: DataFrame) -> DataFrame:
    """Known customers only; totals in source currencies, as they come. The mean is rounded half up, in integers."""
    return orders.where("customer_sk IS NOT NULL").groupBy("customer_sk", "customer_id").agg(
        F.count(F.lit(1)).alias("order_count"), F.sum("source_order_total").cast(MONEY).alias("total_spend"),
        F.expr("((CAST(sum(source_order_total) * 100 AS BIGINT) * 200 + count(1)) DIV (2 * count(1))) / 10000.0D").alias("avg_order_value"),
        F.max("order_date").alias("last_order_date"),
    )


def reconciliation_orders(staged: DataFrame, facts: DataFrame) -> DataFrame:
    in_currency = lambda c: F.sum(F.when(F.col("currency") == c, F.col("order_total")).otherwise(0)).cast(MONEY)
    source = staged.agg(
        F.count(F.lit(1)).alias("source_key_count"), F.countDistinct("order_id").alias("source_distinct_key_count"),
        in_currency("DKK").alias("source_dkk_total"), in_currency("EUR").alias("source_eur_total"),
    )
    gold = facts.agg(
        F.count(F.lit(1)).alias("gold_key_count"), F.countDistinct("order_id").alias("gold_distinct_key_count"),
        F.count_if("orphan_customer").alias("orphan_customer_count"), F.count_if("missing_dkk_rate").alias("missing_fx_count"),
        F.sum("order_total_dkk").cast(MONEY).alias("known_converted_total_dkk"),
    )
    both = source.crossJoin(gold)  # two one-row relations
    return both.select(
        "source_key_count", "source_distinct_key_count", "gold_key_count", "gold_distinct_key_count",
        (F.col("source_key_count") - F.col("source_distinct_key_count")).alias("source_duplicate_count"),
        (F.col("gold_key_count") - F.col("gold_distinct_key_count")).alias("gold_duplicate_count"),
        "orphan_customer_count", "missing_fx_count", "source_dkk_total", "source_eur_total", "known_converted_total_dkk",
    )


def order_is_newer(left: str = "s", right: str = "t"):
    """Order version first, then the version of its rate; a missing rate version is older than any."""
    time = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(X.NO_TIME).cast("timestamp_ntz"))
    text = lambda side, c: F.coalesce(F.col(f"{side}.{c}"), F.lit(""))
    return X.lexicographic([
        *((F.col(f"{left}.{c}"), F.col(f"{right}.{c}")) for c in ("source_updated_at", "source_applied_at")),
        *((time(left, c), time(right, c)) for c in ("fx_retrieved_at", "fx_source_extract_ts", "fx_ingested_at")),
        (text(left, "fx_record_hash"), text(right, "fx_record_hash")),
    ])


def order_candidates(incoming: DataFrame, target: DataFrame) -> DataFrame:
    """Incoming orders that are new or newer than the target's row."""
    blocked = (F.col("s.order_id") == F.col("t.order_id")) & ~F.coalesce(order_is_newer(), F.lit(False))
    return incoming.alias("s").join(target.alias("t"), blocked, "left_anti")


def merge_orders(incoming: DataFrame, target: DataFrame) -> DataFrame:
    """The target after the merge, by one full outer join. What the feed lacks stays."""
    return silver.upsert(target, incoming, ["order_id"], order_is_newer())


def watermark_candidates(incoming: DataFrame, target: DataFrame) -> DataFrame:
    """Incoming rows at or after the latest the target has seen."""
    latest = target.agg(
        *(F.coalesce(F.max(c), F.lit(X.NO_TIME).cast("timestamp_ntz")).alias(f"_{c}") for c in ("source_applied_at", "source_updated_at"))
    )
    joined = incoming.crossJoin(F.broadcast(latest))  # one row
    found = joined.where((F.col("source_applied_at") >= F.col("_source_applied_at")) | (F.col("source_updated_at") >= F.col("_source_updated_at")))
    return found.select(*incoming.columns)


def delete_absent(target: DataFrame, source: DataFrame, key: str = "order_id") -> DataFrame:
    """What a full snapshot leaves of the target."""
    return target.join(source.select(key), key, "left_semi")


def delete_fraction(target: DataFrame, source: DataFrame, key: str = "order_id") -> DataFrame:
    """One row: target_count, delete_count, delete_fraction."""
    there = source.select(key).distinct().withColumn("_there", F.lit(True))
    counts = target.join(there, key, "left").agg(F.count(F.lit(1)).alias("target_count"), F.count_if(F.col("_there").isNull()).alias("delete_count"))
    share = F.when(F.col("target_count") > 0, F.round(F.col("delete_count") / F.col("target_count"), 6)).otherwise(0.0)
    return counts.withColumn("delete_fraction", share)


def verified_deletes(target: DataFrame, source: DataFrame, verified: bool, most: float = 0.25, key: str = "order_id") -> DataFrame:
    """``delete_absent`` for a snapshot vouched for; refuses to delete more than ``most`` of the target."""
    if not verified:
        raise ValueError("full_snapshot_not_verified")
    if delete_fraction(target, source, key).first()["delete_fraction"] > most:
        raise ValueError("delete_fraction_exceeds_maximum")
    return delete_absent(target, source, key)


def tombstones(ledger: DataFrame) -> DataFrame:
    """Deletes the change stream vouches for."""
    return ledger.where(F.coalesce("is_deleted", F.lit(False)) & (F.lower("dms_operation") == "delete") & F.col("source_lsn").isNotNull())


def apply_tombstones(target: DataFrame, ledger: DataFrame, verified: bool = True, key: str = "order_id") -> DataFrame:
    if not verified:
        raise ValueError("cdc_tombstones_not_verified")
    return target.join(tombstones(ledger).select(key), key, "left_anti")
