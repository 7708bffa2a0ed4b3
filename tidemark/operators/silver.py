"""From landed rows to current-state reference tables: normalise, validate, split, deduplicate, merge."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.functions import rules as R
from tidemark.schemas import BUSINESS_VERSION, COUNTRY_REGIONS, ENTITIES

LOSER = "duplicate_business_key_non_winner"


@dataclass(frozen=True)
class Batch:
    """What a verified manifest says of its rows."""

    manifest_key: str
    entity: str
    logical_date: str
    interval_start: str
    interval_end: str
    run: str


def regions(frame: DataFrame) -> DataFrame:
    """The country lookup: a fixed list, so broadcasting it is safe at any size."""
    rows = ", ".join(f"('{c}', '{r}')" for c, r in COUNTRY_REGIONS.items())
    return frame.sparkSession.sql(f"SELECT * FROM VALUES {rows} AS t(country_code, region)")


def normalize_rates(frame: DataFrame, extra: Sequence[Column] = (), rate_type: str = "decimal(20,10)") -> DataFrame:
    return frame.select(
        X.to_date(F.col("rate_date")).alias("rate_date"),
        X.clean(F.col("base_currency")).alias("base_currency"),
        X.clean(F.col("quote_currency")).alias("quote_currency"),
        X.to_decimal(F.col("rate"), rate_type).alias("rate"),
        F.try_to_timestamp("retrieved_at").alias("retrieved_at"),
        *extra,
    )


def normalize_locations(frame: DataFrame, extra: Sequence[Column] = ()) -> DataFrame:
    trimmed = frame.select(
        F.trim("location_id").alias("location_id"),
        F.trim("location_name").alias("location_name"),
        X.clean(F.col("country_code")).alias("country_code"),
        F.trim("timezone").alias("timezone"),
        F.try_to_timestamp("updated_at").alias("updated_at"),
        *extra,
    )
    return trimmed.join(F.broadcast(regions(frame)), "country_code", "left")


def with_reason(normalized: DataFrame, entity: str) -> DataFrame:
    rules = R.rate_rules() if entity == "exchange_rates" else R.location_rules()
    return normalized.withColumn("rejection_reason", R.all_reasons(rules))


def provenance(frame: DataFrame, batch: Batch) -> list[Column]:
    lit = lambda value, kind, name: F.lit(value).cast(kind).alias(name)
    return [
        X.canonical_json(frame.columns).alias("source_payload_json"),
        *(F.col(c) for c in ("ingestion_id", "source_name", "source_entity")),
        X.optional(frame, "source_record_key").alias("source_record_key"),
        F.try_to_timestamp("source_extract_ts").alias("source_extract_ts"),
        F.try_to_timestamp("ingested_at").alias("ingested_at"),
        X.optional(frame, "source_version").alias("source_version"),
        *(F.col(c) for c in ("source_locator", "record_hash")),
        lit(batch.manifest_key, "string", "manifest_key"),
        lit(batch.logical_date, "date", "logical_date"),
        lit(batch.interval_start, "timestamp", "interval_start"),
        lit(batch.interval_end, "timestamp", "interval_end"),
    ]


def transform(frame: DataFrame, batch: Batch) -> DataFrame:
    """A landed batch, typed and checked, with its whole row and provenance kept."""
    if batch.entity == "exchange_rates":
        extra = [X.optional(frame, "provider_name").alias("provider_name"), *provenance(frame, batch)]
        return with_reason(normalize_rates(frame, extra), batch.entity)
    if batch.entity == "locations":
        extra = [X.optional(frame, "location_type").alias("location_type"), *provenance(frame, batch)]
        return with_reason(normalize_locations(frame, extra), batch.entity)
    raise ValueError(f"{batch.entity} is not a batch entity")


def split(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    reason = F.col("rejection_reason")
    return checked.where(reason.isNull()), checked.where(reason.isNotNull())


def ranked(frame: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str = "_rank") -> DataFrame:
    return frame.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def freshness(entity: str, total: bool = True) -> list[Column]:
    """Newest first; ``total`` breaks even exact repeats, by where they came from."""
    order = [
        F.col(BUSINESS_VERSION[entity]).desc_nulls_last(),
        F.col("source_extract_ts").desc_nulls_last(),
        F.col("ingested_at").desc_nulls_last(),
        F.col("record_hash").desc(),
    ]
    return [*order, F.col("source_locator").asc_nulls_last()] if total else order


def deduplicate(checked: DataFrame, entity: str, total: bool = True) -> tuple[DataFrame, DataFrame]:
    """(winners, rejected): one current row a key; losers and invalid rows with their reasons."""
    valid, invalid = split(checked)
    placed = ranked(valid, ENTITIES[entity].key, freshness(entity, total))
    winners = placed.where("_rank = 1").drop("_rank", "rejection_reason")
    losers = placed.where("_rank > 1").drop("_rank").withColumn("rejection_reason", F.lit(LOSER))
    return winners, invalid.unionByName(losers, allowMissingColumns=True)


def outcome(keys: Sequence[str], is_newer: Column) -> Column:
    """Of winners ``s`` left-joined to a target ``t``: insert, update or unchanged."""
    return (
        F.when(F.col(f"t.{keys[0]}").isNull(), "insert").when(is_newer, "update").otherwise("unchanged").alias("outcome")
    )


def classify(winners: DataFrame, target: DataFrame, keys: Sequence[str], is_newer: Column) -> DataFrame:
    same = [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys]
    joined = winners.alias("s").join(target.alias("t"), same, "left")
    return joined.select(*(F.col(f"s.{k}").alias(k) for k in keys), outcome(keys, is_newer))


def upsert(target: DataFrame, winners: DataFrame, keys: Sequence[str], is_newer: Column) -> DataFrame:
    """The target after the merge: one full outer join by key, each row from the newer side."""
    t = target.withColumn("_in_t", F.lit(True)).alias("t")
    s = winners.withColumn("_in_s", F.lit(True)).alias("s")
    joined = t.join(s, [F.col(f"s.{k}") == F.col(f"t.{k}") for k in keys], "full_outer")
    take = F.col("t._in_t").isNull() | (F.col("s._in_s").isNotNull() & F.coalesce(is_newer, F.lit(False)))
    return joined.select(*(F.when(take, F.col(f"s.{c}")).otherwise(F.col(f"t.{c}")).alias(c) for c in target.columns))


def evidence(rejected: DataFrame, batch: Batch, processed_at: Column) -> DataFrame:
    """Quarantine rows with an id that a replay gives again."""
    named = F.struct(
        F.lit(batch.manifest_key).alias("manifest_key"), "source_locator", "record_hash", "rejection_reason"
    )
    return rejected.select(
        F.sha2(F.to_json(named), 256).alias("quarantine_id"), "source_name", "source_entity",
        F.lit(batch.manifest_key).alias("manifest_key"), F.lit(batch.run).alias("logical_run_identity"),
        F.lit(batch.logical_date).cast("date").alias("logical_date"), "source_locator",
        F.col("source_payload_json").alias("original_payload"), "rejection_reason", "record_hash",
        processed_at.alias("processed_at"),
    )


def insert_once(target: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``target`` with the rows whose key it does not have."""
    return target.unionByName(rows.dropDuplicates([key]).join(target.select(key), key, "left_anti"))


def counters(checked: DataFrame, entity: str, outcomes: DataFrame) -> DataFrame:
    """One row: input, accepted (repeats included), rejected, duplicate, winner, inserted, updated, unchanged."""
    valid = F.col("rejection_reason").isNull()
    placed = ranked(checked.withColumn("_valid", valid), ["_valid", *ENTITIES[entity].key], freshness(entity))
    count = lambda what, name: F.count_if(what).alias(name)
    of = placed.agg(
        F.count(F.lit(1)).alias("input_count"), count(valid, "accepted_count"), count(~valid, "rejected_count"),
        count(valid & (F.col("_rank") > 1), "duplicate_count"), count(valid & (F.col("_rank") == 1), "unique_winner_count"),
    )
    done = outcomes.agg(*(count(F.col("outcome") == o, f"{n}_count") for o, n in (("insert", "inserted"), ("update", "updated"), ("unchanged", "unchanged"))))
    return of.crossJoin(done)  # two one-row relations


def numbered(rows: DataFrame, key: str, name: str, ranges: int = 64) -> DataFrame:
    """All rows with their place, from 1, in the order of a numeric ``key``; nulls come last.

    Bounds (approximate quantiles, at most ``ranges`` values, fixed before the plan) cut the
    keys into ranges; a place is the number in its range after all rows of the lower ranges.
    """
    bounds = sorted(set(rows.approxQuantile(key, [k / ranges for k in range(1, ranges)], 1 / (4 * ranges))))
    below = [F.when(F.col(key) > b, 1).otherwise(0) for b in bounds]
    part = F.when(F.col(key).isNull(), len(bounds) + 1).otherwise(sum(below, F.lit(0)))
    rows = rows.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("_part").count()  # a row a range
    starts = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.col(key).asc_nulls_last()))
    placed = rows.withColumn("_inside", inside).join(F.broadcast(starts), "_part")
    return placed.withColumn(name, (F.col("_start") + F.col("_inside")).cast("int")).drop("_part", "_inside", "_start")
