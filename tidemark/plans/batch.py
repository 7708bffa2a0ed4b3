"""A landed batch to silver tables: verify, check, merge, record; every step can be run again."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import backfill, silver
from tidemark.schemas import BUSINESS_VERSION, ENTITIES, SILVER
from tidemark.sources.publication import ManifestError, verify
from tidemark.sources.store import Store
from tidemark.sources.tables import Table

QUARANTINE = (
    "quarantine_id string, source_name string, source_entity string, manifest_key string, logical_run_identity string, "
    "logical_date date, source_locator string, original_payload string, rejection_reason string, record_hash string, processed_at timestamp"
)
COUNTS = (
    "input_count", "accepted_count", "rejected_count", "duplicate_count", "unique_winner_count",
    "inserted_count", "updated_count", "unchanged_count",
)
RECONCILIATION = "manifest_key string, source_entity string, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", processed_at timestamp"


@dataclass(frozen=True)
class Reconciliation:
    manifest_key: str
    source_entity: str
    input_count: int
    accepted_count: int
    rejected_count: int
    duplicate_count: int
    unique_winner_count: int
    inserted_count: int
    updated_count: int
    unchanged_count: int


class Silver:
    """The silver tables of a store."""

    def __init__(self, store: Store, namespace: str = "silver"):
        self.store = store
        self.reference = {e: Table(store, f"{namespace}/ref_{e}", s, keys=ENTITIES[e].key) for e, s in SILVER.items()}
        self.quarantine = Table(store, f"{namespace}/quarantine", QUARANTINE, partition_by=["logical_date"])
        self.reconciliation = Table(store, f"{namespace}/reconciliation", RECONCILIATION)

    def process(
        self, manifest_key: str, now: datetime | None = None, acknowledge: Callable[[Reconciliation], None] | None = None
    ) -> Reconciliation:
        """One verified manifest. Accepted rows include repeats; the acknowledgement comes last."""
        manifest = verify(self.store, manifest_key)
        entity = manifest["source_entity"]
        batch = _batch(manifest_key, manifest)
        spark, at = self.store.spark, now or datetime.now(timezone.utc)
        raw = spark.read.parquet(self.store.path(manifest["data_key"]))
        checked = silver.transform(raw, batch).persist()
        try:
            winners, rejected = silver.deduplicate(checked, entity)
            tallies = checked.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rejection_reason").isNotNull()).alias("bad")).first()
            unique = winners.count()
            target = self.reference[entity]
            winners = winners.select(*spark.createDataFrame([], target.schema).columns)
            merged = target.merge(winners, ENTITIES[entity].key, X.newer(BUSINESS_VERSION[entity]))
            self.quarantine.insert_once(silver.evidence(rejected, batch, F.lit(at).cast("timestamp")), "quarantine_id")
            good = tallies["n"] - tallies["bad"]
            result = Reconciliation(
                manifest_key, entity, tallies["n"], good, tallies["bad"], good - unique, unique,
                merged["insert"], merged["update"], merged["unchanged"],
            )
            row = spark.createDataFrame([(*asdict(result).values(), at)], RECONCILIATION)
            self.reconciliation.insert_once(row, "manifest_key")
        finally:
            checked.unpersist()
        if acknowledge:
            acknowledge(result)
        return result

    def validate_backfill(self, request: backfill.Request) -> dict[str, dict[str, int]]:
        """Counts by entity if the landed history agrees with the tables; raises ``BackfillError`` otherwise. Writes nothing."""
        backfill.check_request(request)
        manifests = []
        for key in request.manifest_keys:
            try:
                manifest = verify(self.store, key, request.most_bytes)
            except ManifestError as error:
                raise backfill.BackfillError(str(error)) from error
            start, end = (datetime.fromisoformat(manifest[k].replace("Z", "+00:00")) for k in ("interval_start", "interval_end"))
            if start < request.start or end > request.end:
                raise backfill.BackfillError("manifest_outside_expected_interval")
            manifests.append((key, manifest))
        if {m["source_entity"] for _, m in manifests} != set(SILVER):
            raise backfill.BackfillError("required_reference_entity_manifest_missing_or_unexpected")
        report = {}
        for entity in sorted(SILVER):
            own = [(k, m) for k, m in manifests if m["source_entity"] == entity]
            frames = [silver.transform(self.store.spark.read.parquet(self.store.path(m["data_key"])), _batch(k, m)) for k, m in own]
            historical = frames[0]
            for more in frames[1:]:
                historical = historical.unionByName(more, allowMissingColumns=True)
            report[entity] = backfill.validate(entity, historical, self.reference[entity].read(), [k for k, _ in own])
        return report


def _batch(key: str, manifest: dict) -> silver.Batch:
    return silver.Batch(
        key, manifest["source_entity"], manifest["logical_date"], manifest["interval_start"], manifest["interval_end"], manifest["logical_run_identity"]
    )
