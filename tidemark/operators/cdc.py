"""Change events to decisions and current state, as window functions.

An event-by-event fold per key compares each event with the last one applied. The last
one applied is always the greatest position so far, so running maxima over the arrival
order give every decision at once; state that is already stored joins in as an event
that arrived before all others.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.functions.rules import first_reason
from tidemark.schemas import CDC_ENTITIES, ENTITIES, LEDGER, LEDGER_COMMON, NARROW, WIDE

OPERATIONS = {"r": "snapshot_read", "c": "create", "u": "update", "d": "delete"}
ROW_OPERATIONS = ("load", "insert", "update", "delete")
DEBEZIUM = (
    "op string, before map<string,string>, after map<string,string>, "
    "source struct<lsn: string, txId: string, ts_ms: string, snapshot: string>, "
    "transaction struct<id: string, total_order: string, data_collection_order: string>, _corrupt_record string"
)
ROW_RECORD = (
    "data map<string,string>, metadata struct<`timestamp`: string, `record-type`: string, operation: string, "
    "`schema-name`: string, `table-name`: string, `commit-timestamp`: string, `stream-position`: string, "
    "`transaction-id`: string, `transaction-record-id`: string>, _corrupt_record string"
)


def _earlier(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)


def position_decisions(events: DataFrame, keys: Sequence[str] = ("entity", "pk")) -> DataFrame:
    """``events`` (keys, seq, phase, lsn, tx, rec, hash, op) with ``decision``.

    Phase 0 is the snapshot, 1 the change stream. Later positions apply, earlier are
    ``stale``. At an equal position another transaction is ``incomparable``; within one,
    the record number decides, and an equal number is a ``duplicate`` if the content is
    equal, else a ``conflict``. The first event of a key is an insert or a delete.
    One exchange by key serves all four windows.
    """
    keys = list(keys)
    here = F.struct(F.col("phase"), F.coalesce("lsn", F.lit(0)).alias("lsn"))
    frame = events.withColumn("_pos", here)
    at = [*keys, "_pos"]
    first = lambda c, by: F.first(c).over(Window.partitionBy(*by).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    frame = frame.withColumn("_top", F.max("_pos").over(_earlier(keys)))
    frame = frame.withColumn("_tx", first("tx", at)).withColumn("_rec", F.max("rec").over(_earlier([*at, "tx"])))
    frame = frame.withColumn("_hash", first("hash", [*at, "tx", "rec"]))
    delete = F.col("op") == "delete"
    applied = F.when(delete, "applied_delete").otherwise("applied_update")
    same = F.when(F.col("hash") == F.col("_hash"), "duplicate").otherwise("conflict")
    decision = (
        F.when(F.col("_top").isNull(), F.when(delete, "applied_delete").otherwise("applied_insert"))
        .when(F.col("_pos") > F.col("_top"), applied)
        .when(F.col("_pos") < F.col("_top"), "stale")
        .when(F.col("phase") == 0, same)
        .when(~F.col("tx").eqNullSafe(F.col("_tx")) | F.col("rec").isNull() | F.col("_rec").isNull(), "incomparable")
        .when(F.col("rec") > F.col("_rec"), applied)
        .when(F.col("rec") < F.col("_rec"), "stale")
        .otherwise(same)
    )
    return frame.withColumn("decision", decision).drop("_pos", "_top", "_tx", "_rec", "_hash")


def log_decisions(events: DataFrame, keys: Sequence[str] = ("entity", "pk")) -> DataFrame:
    """``events`` (keys, seq, lsn, tx, ord, topic, part, off) with ``decision``.

    A higher log position is ``newer``, a lower one ``lower_lsn``. At an equal one the order
    within the transaction of the current event decides (``newer`` or
    ``lower_transaction_order``); else the same known transport place is an ``exact_replay``
    and anything else an ``equal_position_conflict``.
    """
    keys = list(keys)
    at = [*keys, "lsn"]
    before = _earlier(at)
    place = F.when(
        F.col("part").isNotNull() & F.col("off").isNotNull(), F.struct("topic", "part", "off")
    )
    frame = events.withColumn("_place", place)
    frame = frame.withColumn("_top", F.max("lsn").over(_earlier(keys)))
    up_to_here = Window.partitionBy(*at).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    frame = frame.withColumn("_first", F.first(F.struct("tx", "ord", "_place")).over(up_to_here))
    lead = F.col("_first")
    chain = (F.col("tx") == lead["tx"]) & F.col("ord").isNotNull() & lead["ord"].isNotNull()
    link = F.when(chain, F.struct("ord", (-F.col("seq")).alias("back"), "_place"))
    frame = frame.withColumn("_chain", chain).withColumn("_now", F.max(link).over(before))
    now = F.coalesce(F.col("_now")["_place"], F.when(F.col("_now").isNull(), lead["_place"]))
    decision = (
        F.when(F.col("_top").isNull() | (F.col("lsn") > F.col("_top")), "newer")
        .when(F.col("lsn") < F.col("_top"), "lower_lsn")
        .when(F.col("_chain") & (F.col("ord") > F.col("_now")["ord"]), "newer")
        .when(F.col("_chain") & (F.col("ord") < F.col("_now")["ord"]), "lower_transaction_order")
        .when(F.col("_place") == now, "exact_replay")
        .otherwise("equal_position_conflict")
    )
    return frame.withColumn("decision", decision).drop("_place", "_top", "_first", "_chain", "_now")


def _not_object(value: Column, parsed: Column) -> Column:
    """True for text that is no JSON object; parsers fill what they can of broken text and say so."""
    return parsed.isNull() | parsed["_corrupt_record"].isNotNull() | ~value.rlike(r"^\s*\{")


APPLIED = ("applied_insert", "applied_update", "applied_delete", "newer")


def current_state(decided: DataFrame, keys: Sequence[str] = ("entity", "pk")) -> DataFrame:
    """The last applied event of each key, by partial aggregates; deletes stay as tombstones."""
    rest = [c for c in decided.columns if c not in keys]
    last = F.max_by(F.struct(*rest), "seq").alias("last")
    state = decided.where(F.col("decision").isin(*APPLIED)).groupBy(*keys).agg(last)
    return state.select(*keys, "last.*", (F.col("last.op") == "delete").alias("is_deleted"))


def parse_debezium(raw: DataFrame) -> DataFrame:
    """(topic, part, off, key, value) to typed columns and ``reason``, null for a good event.

    A null value is a compaction marker: kept, with ``op`` tombstone and no reason.
    """
    parsed = raw.withColumn("e", F.from_json("value", DEBEZIUM)).withColumn("entity", X.topic_entity(F.col("topic")))
    known_key = F.from_json("key", "map<string,string>") if "key" in raw.columns else F.lit(None).cast("map<string,string>")
    by_entity = lambda m: F.element_at(m, F.element_at(F.create_map(*[F.lit(x) for e in CDC_ENTITIES for x in (e, ENTITIES[e].key[0])]), F.col("entity")))
    pk = F.coalesce(by_entity(known_key), by_entity(F.col("e.after")), by_entity(F.col("e.before")))
    number = lambda c: F.col(c).try_cast("bigint")
    bad = lambda c: F.col(c).isNotNull() & number(c).isNull()
    lsn = F.coalesce(X.lsn(F.col("e.source.lsn")), F.col("e.source.lsn").try_cast("decimal(20,0)"))
    not_object = _not_object(F.col("value"), F.col("e"))
    reason = first_reason([
        (not_object, "invalid_json"),
        (~F.col("entity").isin(*CDC_ENTITIES), "unowned_entity"),
        (F.col("e.op").isNull() | ~F.col("e.op").isin(*OPERATIONS), "unsupported_operation"),
        ((F.col("e.op") == "d") & F.col("e.after").isNotNull(), "delete_with_after"),
        (lsn.isNull(), "missing_lsn"),
        (pk.isNull(), "missing_primary_key"),
        (bad("e.transaction.total_order") | bad("e.transaction.data_collection_order"), "invalid_transaction_order"),
    ])
    return parsed.select(
        *raw.columns, "entity", pk.alias("pk"), F.when(F.col("value").isNull(), "tombstone").otherwise(F.col("e.op")).alias("op"),
        lsn.alias("lsn"), F.col("e.transaction.id").alias("tx"), number("e.transaction.total_order").alias("ord"),
        F.col("e.source.txId").alias("source_tx"), number("e.transaction.data_collection_order").alias("collection_order"),
        F.col("e.source.ts_ms").alias("source_event_ts"), F.col("e.after").alias("after"), F.col("e.before").alias("before"),
        F.when(F.col("value").isNotNull(), reason).alias("reason"),
    )


def parse_row_records(raw: DataFrame, schema: str = "commerce") -> DataFrame:
    """(value) of row records to typed columns and the first ``reason`` that rejects them."""
    e = raw.withColumn("e", F.from_json("value", ROW_RECORD))
    m = lambda c: F.col("e.metadata")[c]
    operation = F.lower(m("operation"))
    table = m("table-name")
    pairs = [F.lit(x) for n in CDC_ENTITIES for x in (n, ENTITIES[n].key[0])]
    pk = F.element_at(F.col("e.data"), F.element_at(F.create_map(*pairs), table))
    needed = F.create_map(*[x for n in CDC_ENTITIES for x in (F.lit(n), F.array(*map(F.lit, sorted(ENTITIES[n].required))))])
    missing = F.array_except(F.element_at(needed, table), F.map_keys("e.data"))
    stream = operation != "load"
    record = m("transaction-record-id").try_cast("bigint")
    not_object = _not_object(F.col("value"), F.col("e"))
    reason = first_reason([
        (F.col("value").isNull() | not_object, "invalid_json"),
        (F.col("e.metadata").isNull(), "missing_metadata"),
        (~m("record-type").eqNullSafe(F.lit("data")), "non_data_control_record"),
        (operation.isNull() | ~operation.isin(*ROW_OPERATIONS), "unsupported_operation"),
        (~m("schema-name").eqNullSafe(F.lit(schema)), "unexpected_source_schema"),
        (table.isNull() | ~table.isin(*CDC_ENTITIES), "unexpected_source_table"),
        (F.col("e.data").isNull(), "missing_data"),
        (pk.isNull() | (F.trim(pk) == ""), "missing_primary_key"),
        ((operation != "delete") & (F.size(missing) > 0), F.concat(F.lit("missing_business_fields:"), F.concat_ws(",", missing))),
        (stream & X.stream_position(m("stream-position")).isNull(), "missing_or_invalid_stream_position"),
        (stream & (m("transaction-id").isNull() | m("transaction-record-id").isNull()), "missing_transaction_order"),
        (stream & (record.isNull() | (record < 0)), "invalid_transaction_record_id"),
    ])
    content = F.sha2(F.to_json(F.map_from_entries(F.array_sort(F.map_entries("e.data")))), 256)
    phase = F.when(stream, 1).otherwise(0)
    on_stream = lambda c: F.when(stream, c)
    position = F.struct(phase.alias("phase"), on_stream(F.upper(m("stream-position"))).alias("at"), on_stream(m("transaction-id")).alias("tx"), on_stream(record).alias("rec"))
    return e.select(
        *raw.columns, table.alias("entity"), pk.alias("pk"), operation.alias("op"), phase.alias("phase"),
        on_stream(X.stream_position(m("stream-position"))).alias("lsn"), on_stream(m("transaction-id")).alias("tx"), on_stream(record).alias("rec"),
        F.coalesce(m("commit-timestamp"), m("timestamp")).alias("source_event_at"), F.col("e.data").alias("data"),
        content.alias("record_hash"), F.sha2(F.to_json(F.struct(table.alias("entity"), pk.alias("pk"), operation.alias("op"), position.alias("position"), content.alias("record_hash"))), 256).alias("hash"),
        reason.alias("reason"),
    )


def archive(parsed: DataFrame, processed_at: Column) -> DataFrame:
    """Every message as evidence: tombstones by name, rejected ones as ``unparsed`` with their payload."""
    return parsed.select(
        "entity", "pk", F.when(F.col("reason").isNotNull(), "unparsed").otherwise(F.col("op")).alias("op"), "lsn",
        "topic", "part", "off", F.col("value").alias("envelope"), processed_at.alias("processed_at"),
        F.substring(processed_at.cast("string"), 1, 10).alias("event_date"),
    )


def quarantine_reasons(decided: DataFrame) -> DataFrame:
    """Stale, conflicting and incomparable events with the reason they are set aside for."""
    reason = F.create_map(*[F.lit(x) for pair in (
        ("stale", "stale_source_position"), ("conflict", "same_position_different_content"), ("incomparable", "incomparable_source_position"),
    ) for x in pair])
    aside = decided.where(F.col("decision").isin("stale", "conflict", "incomparable"))
    aside = aside.withColumn("rejection_reason", F.element_at(reason, F.col("decision")))
    return aside.withColumn(
        "quarantine_id", F.sha2(F.concat_ws("|", "entity", "pk", F.col("hash").cast("string"), "rejection_reason"), 256)
    )


def changelog(decided: DataFrame, keys: Sequence[str] = ("entity", "pk")) -> DataFrame:
    """Applied events as changes of current rows: insert, update_after or delete.

    A delete changes a row only if there is one; the row it takes away is the one before it.
    """
    line = Window.partitionBy(*keys).orderBy("seq")
    applied = decided.where(F.col("decision").isin(*APPLIED))
    there = F.coalesce(F.lag(F.col("op") != "delete").over(line), F.lit(False))
    delete = F.col("op") == "delete"
    kind = F.when(delete, F.when(there, "delete")).when(there, "update_after").otherwise("insert")
    return applied.withColumn("change_type", kind).where("change_type IS NOT NULL")


def typed(ledger: DataFrame, entity: str, payload: str = "payload") -> DataFrame:
    """The live rows of one entity in its business columns; what does not fit a column is null."""
    data = F.from_json(payload, "map<string,string>")
    fields = (field.split(" ") for field in LEDGER[entity].split(", "))
    columns = [_cast(F.element_at(data, name), kind).alias(name) for name, kind in fields]
    return ledger.where((F.col("entity") == entity) & ~F.coalesce("is_deleted", F.lit(False))).select(*columns)


def lsn_text(lsn: Column) -> Column:
    """An unsigned 64-bit position as ``X/Y``, in hexadecimal."""
    half = F.lit(1 << 32).cast("decimal(20,0)")
    low = lsn % half
    return F.concat_ws("/", *(F.hex(c.cast("bigint")) for c in ((lsn - low) / half, low)))


def ledger_rows(ledger: DataFrame, entity: str, schema: str = "commerce") -> DataFrame:
    """One entity's ledger in full: business columns, then where each row comes from. Tombstones stay, without business values."""
    own = ledger.where(F.col("entity") == entity)
    data = F.from_json("payload", "map<string,string>")
    deleted = F.coalesce("is_deleted", F.lit(False))
    at = lambda c: F.try_to_timestamp(F.col(c).cast("string"))
    audit = {
        "payload_json": F.when(~deleted, F.col("payload")), "is_deleted": deleted, "source_schema": F.lit(schema), "source_table": F.col("entity"),
        "primary_key_value": F.col("pk"), "source_lsn": F.when(F.col("lsn").isNotNull(), lsn_text(F.col("lsn"))), "source_lsn_int": F.col("lsn"),
        "transaction_id": F.col("tx"), "transaction_record_id": F.col("rec"), "dms_operation": F.col("op"), "source_event_at": at("source_event_at"),
        "applied_at": F.col("applied_at"), "ingested_at": F.col("applied_at"), "record_hash": F.col("record_hash"), "event_hash": F.col("hash"), "raw_event_json": F.col("raw"),
    }
    kinds = dict(f.split(" ") for f in LEDGER_COMMON.split(", "))
    business = [_cast(F.when(~deleted, F.element_at(data, name)), kind).alias(name) for name, kind in (f.split(" ") for f in LEDGER[entity].split(", "))]
    key = ENTITIES[entity].key[0]
    business = [F.col("pk").alias(key) if c == key else b for c, b in zip((f.split(" ")[0] for f in LEDGER[entity].split(", ")), business)]
    return own.select(*business, *(column.cast(kinds[name]).alias(name) for name, column in audit.items()))


def _cast(text: Column, kind: str) -> Column:
    return F.try_to_timestamp(text) if kind == "timestamp" else text.try_cast(kind)


def wide(events: DataFrame, applied_at: Column) -> DataFrame:
    """Parsed log events as rows of one wide shape, whatever the entity: its fields as text, null for the others', and the position.

    An entity's own key falls back to the message key, so deletes have one.
    """
    keys = {ENTITIES[e].key[0]: e for e in CDC_ENTITIES}
    position = {
        "source_lsn": F.col("lsn").cast("string"), "source_tx_id": F.col("source_tx"), "transaction_id": F.col("tx"), "transaction_total_order": F.col("ord"),
        "transaction_data_collection_order": F.col("collection_order"), "source_event_ts": F.col("source_event_ts"), "kafka_topic": F.col("topic"),
        "kafka_partition": F.col("part"), "kafka_offset": F.col("off"), "applied_at": applied_at,
    }

    def field(name: str) -> Column:
        if name in position:
            return position[name]
        if name == "entity":
            return F.col("entity")
        held = F.element_at("after", name)
        return F.coalesce(held, F.when(F.col("entity") == keys[name], F.col("pk"))) if name in keys else held

    return events.select(*(field(name).alias(name) for name in WIDE))


def narrow(rows: DataFrame, entity: str) -> DataFrame:
    """The rows of one entity in its columns, money as decimal(12,2), and the position; the log has no ``updated_at`` of its own."""
    business = [F.col(n).try_cast("decimal(12,2)").alias(n) if n in ("unit_price", "order_total", "amount") else F.col(n) for n in NARROW[entity]]
    position = WIDE[WIDE.index("source_lsn") :]
    return rows.where(F.col("entity") == entity).select(*business, F.lit(None).cast("string").alias("updated_at"), *position)


def to_event(frame: DataFrame) -> DataFrame:
    """Each row as an event in JSON, nulls left out."""
    return frame.select(F.to_json(F.struct(*frame.columns)).alias("event"))


def from_event(frame: DataFrame, schema: str) -> DataFrame:
    """The rows again; text that is no such event is a row of nulls."""
    return frame.select(F.from_json("event", schema).alias("_e")).select("_e.*")
