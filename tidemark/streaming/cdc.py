"""Change streams into versioned ledgers.

Every micro-batch is decided against the ledger by the same windows as a batch would be:
the ledger's rows join in as events that arrived before all others, so a row's stored
position is all the state there is. Batches carry their id; one that ran before is
passed over, so a restart repeats nothing.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidemark.functions import exprs as X
from tidemark.operators import cdc
from tidemark.schemas import CDC_ENTITIES
from tidemark.sources.store import Store
from tidemark.sources.tables import Table

LEDGER = (
    "entity string, pk string, seq bigint, op string, phase int, lsn decimal(20,0), tx string, rec bigint, "
    "hash string, payload string, is_deleted boolean, source_event_at string, record_hash string, raw string, applied_at timestamp"
)
ASIDE = "entity string, pk string, seq bigint, lsn decimal(20,0), hash string, reason string, payload string, quarantine_id string"
#: What the ledger keeps of an event beside what decides.
AUDIT = {"source_event_at": "string", "record_hash": "string", "raw": "string", "applied_at": "timestamp"}
KEY = ("entity", "pk")
STATE = ("entity", "pk", "seq", "op", "phase", "lsn", "tx", "rec", "hash", "payload")


def decide(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """``events`` with decisions made as if the ledger's rows had come first. Ledger rows are not returned."""
    known = ledger.select(*STATE, *AUDIT).withColumn("seq", F.lit(-1).cast("bigint")).withColumn("_stored", F.lit(True))
    audit = [X.optional(events, name, kind).alias(name) for name, kind in AUDIT.items()]
    both = known.unionByName(events.select(*STATE, *audit).withColumn("_stored", F.lit(False)))
    return cdc.position_decisions(both).where("NOT _stored").drop("_stored")


def moved(decided: DataFrame) -> DataFrame:
    """The last applied event of each key, deletes as tombstones without payload."""
    return cdc.current_state(decided).withColumn("payload", F.when(~F.col("is_deleted"), F.col("payload"))).drop("decision")


def next_ledger(ledger: DataFrame, decided: DataFrame) -> DataFrame:
    """The ledger after the batch."""
    new = moved(decided)
    return ledger.join(new.select(*KEY), list(KEY), "left_anti").unionByName(new.select(*ledger.columns))


class Ledger:
    """Current state of change-captured entities with what was set aside, in one store.

    A batch first sets its rejects aside, once by their id, then commits the state under its own
    number. Died before the commit, it is decided again against the same state; after it, never.
    """

    def __init__(self, store: Store, namespace: str = "cdc"):
        self.store, self.namespace = store, namespace
        self.state = Table(store, f"{namespace}/ledger", LEDGER, keys=KEY)
        self.aside = Table(store, f"{namespace}/aside", ASIDE)

    def apply(self, records: DataFrame, batch_id: int, stream: str = "rows") -> dict[str, int] | None:
        """Decides and applies one batch of (value, seq) row records; None if it was applied before."""
        done = f"{self.namespace}/_applied/{stream}-{batch_id:012d}.json"
        if self.store.exists(done) or self.state.applied(stream) >= batch_id:
            return None
        parsed = cdc.parse_row_records(records).withColumns({"payload": F.to_json("data"), "raw": F.col("value"), "applied_at": F.current_timestamp()}).persist()
        try:
            good = parsed.where("reason IS NULL")
            decided = decide(good, self.state.around(self.state.touched(good))).persist()
            counts = {r["decision"]: r["count"] for r in decided.groupBy("decision").count().collect()}  # seven rows at most
            late = cdc.quarantine_reasons(decided).withColumnRenamed("rejection_reason", "reason")
            bad = parsed.where("reason IS NOT NULL").withColumn(
                "quarantine_id", F.sha2(F.concat_ws("|", "value", "reason"), 256)
            ).withColumn("payload", F.col("value"))
            columns = self.aside.columns
            self.aside.insert_once(late.select(*columns).unionByName(bad.select(*columns)), "quarantine_id")
            if any(d in cdc.APPLIED for d in counts):
                self.state.put(moved(decided).persist(), (stream, batch_id))
            decided.unpersist()
        finally:
            parsed.unpersist()
        self.store.create_same(done, json.dumps(counts, sort_keys=True).encode())
        return counts

    def live(self) -> DataFrame:
        return self.state.read().where("NOT is_deleted").orderBy(*KEY)

    def rows(self, entity: str) -> DataFrame:
        """One entity's ledger with business and audit columns, tombstones included."""
        return cdc.ledger_rows(self.state.read(), entity)

    def quarantined(self) -> DataFrame:
        return self.aside.read().orderBy("seq", "quarantine_id")


def run(source: DataFrame, ledger: Ledger, checkpoint: str, stream: str = "rows", trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream of (value, seq) records, or of values as they arrive, into the ledger; ``trigger`` defaults to everything there is now."""
    return (
        source.writeStream.foreachBatch(lambda batch, number: ledger.apply(_numbered(batch), number, stream) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def kafka(spark, servers: str, topics: Sequence[str]) -> DataFrame:
    """The topics from their beginning with key, partition and offset. Needs the Kafka connector on the classpath."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics)).option("startingOffsets", "earliest").load()
    return raw.select("topic", F.col("partition").alias("part"), F.col("offset").alias("off"), F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))


def _raw(messages: DataFrame) -> DataFrame:
    return cdc.archive(cdc.parse_debezium(messages), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))


def archive(messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Every message as Parquet by entity and day of its processing; nothing is dropped, late or broken."""
    return (
        _raw(messages).writeStream.format("parquet").partitionBy("entity", "event_date").option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )


def archive_lines(messages: DataFrame, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """The same as one JSON object a line, in folders by entity, year, month and day.

    A file is written a trigger (60 seconds, unless told otherwise) and task, of at most 64 MB of input a partition
    where the source splits by ``maxBytesPerTrigger``.
    """
    day = F.to_date("event_date")
    parts = {"year": F.date_format(day, "yyyy"), "month": F.date_format(day, "MM"), "day": F.date_format(day, "dd")}
    return (
        _raw(messages).withColumns(parts).drop("event_date").writeStream.format("json").partitionBy("entity", *parts).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "60 seconds"})).start()
    )


def fan_out(messages: DataFrame, path: str, checkpoint: str, entities: Sequence[str] = CDC_ENTITIES, trigger: dict | None = None) -> StreamingQuery:
    """One read of the log into a sink an entity for evidence and another for typed changes, and one for what is rejected.

    Each batch is parsed once and written to folders of its own number, so a replay writes the same again.
    A batch starts every 30 seconds unless told otherwise; a failed query is started again by whoever runs it.
    """

    def write(batch: DataFrame, number: int) -> None:
        parsed = cdc.parse_debezium(batch).persist()
        try:
            seen = cdc.archive(parsed, F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            rows = cdc.wide(parsed.where("reason IS NULL AND value IS NOT NULL"), F.current_timestamp())
            sinks = {f"bronze_cdc_{e}": seen.where(F.col("entity") == e) for e in entities} | {f"core_{e}": cdc.narrow(rows, e) for e in entities}
            sinks["quarantine_cdc"] = parsed.where("reason IS NOT NULL").drop("after", "before")
            for name, frame in sinks.items():
                frame.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        finally:
            parsed.unpersist()

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"processingTime": "30 seconds"})).start()


def lines(spark, path: str, **options: str) -> DataFrame:
    """A stream of the text lines (value) below a folder; ``run`` numbers them as they arrive."""
    return spark.readStream.schema("value string").option("recursiveFileLookup", True).options(**options).text(path)


def _numbered(batch: DataFrame) -> DataFrame:
    return batch if "seq" in batch.columns else batch.withColumn("seq", F.monotonically_increasing_id())


def once_by_id(events: DataFrame, key: str = "event_id", at: str = "ts", within: str = "60 seconds") -> DataFrame:
    """One row a ``key``: of a stream without repeats that come ``within`` the watermark, of a batch its earliest row ``at``, then the least."""
    if not events.isStreaming:
        rest = [c for c in events.columns if c not in (key, at)]
        least = F.min(F.struct(F.col(at).isNull().alias("_late"), *(F.col(f"`{c}`") for c in (at, *rest))))
        return events.groupBy(key).agg(least.alias("_row")).select(*(F.col(f"`{c}`" if c == key else f"_row.`{c}`") for c in events.columns))
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, within).dropDuplicatesWithinWatermark([key])


LOG_LEDGER = (
    "entity string, pk string, seq bigint, op string, lsn decimal(20,0), tx string, ord bigint, topic string, part int, off bigint, "
    "payload string, is_deleted boolean"
)
LOG_STATE = ("entity", "pk", "seq", "op", "lsn", "tx", "ord", "topic", "part", "off", "payload")


def decide_log(events: DataFrame, ledger: DataFrame) -> DataFrame:
    """As ``decide`` for log events: the ledger keeps each key's log position, transaction order and transport place."""
    known = ledger.select(*LOG_STATE).withColumn("seq", F.lit(-1).cast("bigint")).withColumn("_stored", F.lit(True))
    both = known.unionByName(events.select(*LOG_STATE).withColumn("_stored", F.lit(False)))
    return cdc.log_decisions(both)


class LogLedger:
    """Current state of log-captured entities. Deletes keep their position, so nothing late revives a row.

    A batch's outputs are written before the state is committed under the batch's number, so a
    replay either decides against the same state and writes the same, or finds its number and reads them.
    """

    STREAM = "log"

    def __init__(self, store: Store, namespace: str = "log"):
        self.store, self.namespace = store, namespace
        self.state = Table(store, f"{namespace}/ledger", LOG_LEDGER, keys=KEY)

    def outputs(self, batch_id: int) -> dict[str, DataFrame]:
        """What a batch that has run left behind."""
        return {n: self.store.spark.read.parquet(self.store.path(f"{self.namespace}/{n}/batch={batch_id}")) for n in ("changes", "ignored", "rejected")}

    def apply(self, messages: DataFrame, batch_id: int) -> dict[str, DataFrame] | None:
        """One batch of (topic, part, off, key, value, seq): ``changes``, ``ignored`` and ``rejected``; None if it ran before.

        Markers without a value change nothing. The frames are stored, and can be written on.
        """
        done = f"{self.namespace}/_applied/{batch_id:012d}.json"
        if self.store.exists(done) or self.state.applied(self.STREAM) >= batch_id:
            return None
        parsed = cdc.parse_debezium(messages).withColumn("payload", F.to_json("after"))
        parsed = parsed.withColumn("op", F.when(F.col("op") == "d", "delete").otherwise(F.col("op"))).persist()
        good = parsed.where("reason IS NULL AND value IS NOT NULL")
        decided = decide_log(good, self.state.around(self.state.touched(good))).persist()
        try:
            frames = {
                "changes": cdc.changelog(decided).where("NOT _stored"),
                "ignored": decided.where("NOT _stored AND decision <> 'newer'"),
                "rejected": parsed.where("reason IS NOT NULL").drop("after", "before"),
            }
            for name, frame in frames.items():
                frame.drop("_stored").write.mode("overwrite").parquet(self.store.path(f"{self.namespace}/{name}/batch={batch_id}"))
            new = moved(decided.where("NOT _stored").drop("_stored")).persist()
            if not new.isEmpty():
                self.state.put(new, (self.STREAM, batch_id))
            new.unpersist()
        finally:
            decided.unpersist()
            parsed.unpersist()
        self.store.create_same(done, b"{}")
        return self.outputs(batch_id)


def run_log(source: DataFrame, ledger: LogLedger, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Starts a stream of log messages into the ledger."""
    return (
        source.writeStream.foreachBatch(lambda batch, number: ledger.apply(batch, number) and None)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
