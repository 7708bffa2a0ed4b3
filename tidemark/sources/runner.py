"""A registered source to a landed batch: everything it gives or nothing, and an account of it."""

from __future__ import annotations

import json
import os
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rules import contract_reason
from tidemark.schemas import ENTITIES, ENVELOPE
from tidemark.sources import files, rest
from tidemark.sources.batch import BatchContext
from tidemark.sources.events import Emitter
from tidemark.sources.landing import envelope
from tidemark.sources.publication import Publication, Publisher
from tidemark.sources.registry import Registry, RegistryError

STATUS = {"published": "completed", "already_published": "noop", "conflict": "conflicted", "failed": "failed"}


def fields(entity: str) -> str:
    return ", ".join(f"{f} string" for f in ENTITIES[entity].required)


def extract(spark: SparkSession, registry: Registry, source_id: str, root: str, client: rest.Client | None, environ: Mapping[str, str]) -> DataFrame:
    """The source's rows as text with ``source_version`` and ``source_locator``."""
    source = registry.get(source_id)
    if source.source_type == "rest_api":
        found = rest.records(registry.endpoint(source, environ), client or rest.UrlClient(), max_pages=source.max_pages, max_records=source.max_records)
        names = sorted({k for item, _, _ in found for k in item} | set(ENTITIES[source.source_entity].required))
        schema = ", ".join(f"`{n}` string" for n in (*names, "source_version", "source_locator"))
        text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v)
        return spark.createDataFrame([(*(text(item.get(n)) for n in names), version, at) for item, at, version in found], schema)
    path = f"{root.rstrip('/')}/{source.local_path}"
    if source.source_type == "json_file":
        frame = files.rows_of(spark, path, fields(source.source_entity))
    else:
        version = files.identities(spark, path).first()["content_sha256"]
        numbered = files.read_numbered_csv(spark, path, fields(source.source_entity), "_row")
        frame = numbered.withColumns({"source_version": F.lit(f"sha256:{version}"), "source_locator": F.concat(F.lit(f"content_sha256:{version}#row="), "_row")}).drop("_row")
    if frame.limit(source.max_records + 1).count() > source.max_records:
        raise rest.SourceError("max_records_exceeded", path)
    return frame


def run(
    spark: SparkSession, registry: Registry, publisher: Publisher, emit: Emitter, source_id: str, context: BatchContext, *,
    root: str = "", client: rest.Client | None = None, environ: Mapping[str, str] | None = None,
) -> Publication | str:
    """Extracts, checks and publishes; one bad record sets the whole batch aside, and the quarantine key comes back."""
    source = registry.get(source_id)
    if (context.source_name, context.source_entity) != (source.source_type, source.source_entity):
        raise RegistryError("context_does_not_match_registered_source")
    named = {"source_id": source_id, "source_entity": source.source_entity, "run_identity": context.ingestion_id}
    try:
        raw = extract(spark, registry, source_id, root, client, environ if environ is not None else os.environ)
        business = [c for c in raw.columns if c not in ("source_version", "source_locator")]
        if set(business) & set(ENVELOPE):
            raise rest.SourceError("reserved_envelope_field", source_id)
        bad = raw.withColumn("reason", contract_reason(source.source_entity, business)).where("reason IS NOT NULL").orderBy("source_locator").first()
        if bad:
            raise rest.SourceError("invalid_source_schema", bad["source_locator"], {"reason": bad["reason"]})
    except rest.SourceError as error:
        key = publisher.quarantine(context, error.reason, error.locator, error.original)
        emit(component="extractor", action="extract", status="failed", rejected_count=1, error_code=error.reason, **named)
        emit(component="quarantine", action="quarantine", status="quarantined", rejected_count=1, error_code=error.reason, manifest_ref=key, **named)
        return key
    contract = ENTITIES[source.source_entity]
    landed = envelope(
        raw.select(*business, F.col("source_version").alias("_version"), F.col("source_locator").alias("_locator")),
        ingestion_id=context.ingestion_id, source_name=context.source_name, source_entity=context.source_entity, key=contract.key,
        ingested_at=context.ingested_at.isoformat(), extracted=contract.extracted, locator=F.col("_locator"),
    ).withColumn("source_version", F.col("_version")).drop("_version", "_locator")
    emit(component="extractor", action="extract", status="completed", record_count=landed.count(), **named)
    result = publisher.publish(context, landed)
    status = "recovered" if result.detail.startswith("recovered") else STATUS[result.status]
    wrong = result.detail if result.status in ("conflict", "failed") else None
    emit(component="publisher", action="publish", status=status, record_count=result.record_count, error_code=wrong, manifest_ref=result.manifest_key, **named)
    return result
