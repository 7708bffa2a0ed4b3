"""Decisions against an event-by-event fold, and the ledger as a stream."""

import json
import random

import pytest

from tidemark.operators import cdc
from tidemark.sources.store import Store
from tidemark.streaming import cdc as stream

EVENTS = "entity string, pk string, seq bigint, op string, phase int, lsn decimal(20,0), tx string, rec bigint, hash string, payload string"


def fold(events):
    """(seq, decision) one by one, from the rules as stated."""
    last, out = {}, []
    for e in sorted(events, key=lambda e: e["seq"]):
        key, now = (e["entity"], e["pk"]), last.get((e["entity"], e["pk"]))
        applied = "applied_delete" if e["op"] == "delete" else "applied_update" if now else "applied_insert"
        if now is None:
            decision = applied
        elif e["phase"] != now["phase"]:
            decision = applied if e["phase"] > now["phase"] else "stale"
        elif e["phase"] == 1 and e["lsn"] != now["lsn"]:
            decision = applied if e["lsn"] > now["lsn"] else "stale"
        elif e["phase"] == 1 and (e["tx"] != now["tx"] or e["rec"] is None or now["rec"] is None):
            decision = "incomparable"
        elif e["phase"] == 1 and e["rec"] != now["rec"]:
            decision = applied if e["rec"] > now["rec"] else "stale"
        else:
            decision = "duplicate" if e["hash"] == now["hash"] else "conflict"
        if decision.startswith("applied"):
            last[key] = e
        out.append((e["seq"], decision))
    return out


def random_events(seed, n=600):
    rng = random.Random(seed)
    for seq in range(n):
        phase = int(rng.random() > 0.1)
        yield {
            "entity": "orders", "pk": str(rng.randrange(40)), "seq": seq, "op": rng.choice(["insert", "update", "delete"]) if phase else "load", "phase": phase,
            "lsn": rng.randrange(4) if phase else None, "tx": rng.choice("xy") if phase else None, "rec": rng.randrange(3) if phase else None,
            "hash": rng.choice("ab"), "payload": "{}",
        }


def frame(spark, events):
    from decimal import Decimal

    columns = [c.split()[0] for c in EVENTS.split(", ")]
    rows = [tuple(Decimal(e[c]) if c == "lsn" and e[c] is not None else e[c] for c in columns) for e in events]
    return spark.createDataFrame(rows, EVENTS)


@pytest.mark.parametrize("seed", [1, 2])
def test_position_decisions_are_the_fold(spark, seed):
    events = [*random_events(seed)]
    found = cdc.position_decisions(frame(spark, events).repartition(3)).select("seq", "decision").collect()
    assert sorted(map(tuple, found)) == fold(events)
    assert {d for _, d in fold(events)} == {"applied_insert", "applied_update", "applied_delete", "stale", "duplicate", "conflict", "incomparable"}


def test_batches_decide_as_one(spark):
    events = [*random_events(3)]
    ledger, out = spark.createDataFrame([], stream.LEDGER), []
    for a in range(0, 600, 200):
        decided = stream.decide(frame(spark, events[a : a + 200]), ledger)
        rows = decided.collect()
        out += [(r["seq"], r["decision"]) for r in rows]
        ledger = spark.createDataFrame(stream.next_ledger(ledger, decided).collect(), stream.LEDGER)
    assert sorted(out) == fold(events)


def test_log_decisions(spark):
    rows = [
        ("k1", 1, 16, None, None, 0, 1), ("k1", 2, 17, None, None, 0, 2), ("k1", 3, 15, None, None, 0, 3),
        ("k2", 1, 5, "t", 10, 0, 1), ("k2", 2, 5, "t", 11, 0, 2), ("k2", 3, 5, "t", 10, 0, 3), ("k2", 4, 5, "t", 11, 0, 2), ("k2", 5, 5, "t", 11, None, None),
        ("k3", 1, 5, None, None, 0, 9), ("k3", 2, 5, None, None, 0, 9), ("k3", 3, 5, None, None, 1, 9),
    ]
    events = spark.createDataFrame([("e", *r[:5], "topic", *r[5:]) for r in rows], "entity string, pk string, seq bigint, lsn bigint, tx string, ord bigint, topic string, part int, off bigint")
    found = {(r.pk, r.seq): r.decision for r in cdc.log_decisions(events).collect()}
    assert [found["k1", n] for n in (1, 2, 3)] == ["newer", "newer", "lower_lsn"]
    assert [found["k2", n] for n in range(1, 6)] == ["newer", "newer", "lower_transaction_order", "exact_replay", "equal_position_conflict"]
    assert [found["k3", n] for n in (1, 2, 3)] == ["newer", "exact_replay", "equal_position_conflict"]


def record(operation, at=None, tx="1", rec=1, table="orders", schema="commerce", kind="data", **data):
    base = {"order_id": "o1", "customer_id": "c", "order_status": "created", "order_ts": "t", "currency": "DKK", "order_total": "1", "updated_at": "t"} | data
    meta = {"timestamp": "2024-01-01T00:00:00Z", "record-type": kind, "operation": operation, "schema-name": schema, "table-name": table}
    if at:
        meta |= {"stream-position": at, "transaction-id": tx, "transaction-record-id": rec}
    return json.dumps({"data": {k: v for k, v in base.items() if v is not None}, "metadata": meta})


def test_record_rejections(spark):
    cases = {
        "{broken": "invalid_json", "[]": "invalid_json", "{}": "missing_metadata",
        record("load", kind="control"): "non_data_control_record", record("truncate"): "unsupported_operation",
        record("load", schema="x"): "unexpected_source_schema", record("load", table="x"): "unexpected_source_table",
        record("load", order_id=None): "missing_primary_key", record("load", order_id=" "): "missing_primary_key",
        record("insert", "1/A", currency=None, order_ts=None): "missing_business_fields:currency,order_ts",
        record("update", "zz"): "missing_or_invalid_stream_position", record("update", "1/A", tx=None): "missing_transaction_order",
        record("update", "1/A", rec="x"): "invalid_transaction_record_id", record("update", "1/A", rec=-1): "invalid_transaction_record_id",
        record("load"): None, record("update", "ffffffff/FFFFFFFF"): None, record("delete", "1/A", currency=None): None,
    }
    found = {r.value: r for r in cdc.parse_row_records(spark.createDataFrame([(v,) for v in cases], "value string")).collect()}
    assert {v: r.reason for v, r in found.items()} == cases
    assert int(found[record("update", "ffffffff/FFFFFFFF")].lsn) == 2**64 - 1


def test_stream_equals_batch(spark, tmp_path):
    steps = [
        (record("load"), 0), (record("update", "16/B6C60", order_status="completed"), 1), (record("delete", "16/B6C70"), 2), (record("delete", "16/B6C70"), 3),
        (record("update", "16/B6C65", order_status="late"), 4), (record("update", "10/0", order_id="o2"), 5), (record("update", "F/FFFFFFFF", order_id="o2"), 6), ("{", 7),
    ]
    for k, part in enumerate((steps[:3], steps[3:])):
        spark.createDataFrame(part, "value string, seq bigint").coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    ledger = stream.Ledger(Store(spark, f"{tmp_path}/store"))
    source = spark.readStream.schema("value string, seq bigint").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    stream.run(source, ledger, f"{tmp_path}/checkpoint").awaitTermination()
    state = {r.pk: r for r in ledger.state.read().collect()}
    assert state["o1"].is_deleted and state["o1"].payload is None and int(state["o1"].lsn) == (0x16 << 32) + 0xB6C70
    assert not state["o2"].is_deleted and [r.pk for r in ledger.live().collect()] == ["o2"]
    reasons = sorted(r.reason for r in ledger.aside.read().collect())
    assert reasons == ["invalid_json", "stale_source_position", "stale_source_position"]
    version = ledger.state.version()
    assert ledger.apply(spark.createDataFrame(steps[:3], "value string, seq bigint"), 0) is None  # that batch ran before
    assert ledger.apply(spark.createDataFrame(steps, "value string, seq bigint"), 99)["duplicate"] >= 1
    assert ledger.state.version() == version  # a replay changes nothing


def test_archive_and_once_by_id(spark, tmp_path):
    rows = [("s.commerce.orders", 0, 1, None), ("s.commerce.orders", 0, 2, "{bad"), ("s.commerce.orders", 0, 3, '{"op":"c","after":{"order_id":"o"},"source":{"lsn":"5"}}')]
    spark.createDataFrame(rows, "topic string, part int, off bigint, value string").write.parquet(f"{tmp_path}/m")
    source = spark.readStream.schema("topic string, part int, off bigint, value string").parquet(f"{tmp_path}/m")
    stream.archive(source, f"{tmp_path}/out", f"{tmp_path}/c1").awaitTermination()
    assert {r.off: r.op for r in spark.read.parquet(f"{tmp_path}/out").collect()} == {1: "tombstone", 2: "unparsed", 3: "c"}
    events = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events.parquet*")
    twice = events.union(events)
    query = stream.once_by_id(twice).writeStream.format("memory").queryName("once").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/c2").start()
    query.awaitTermination()
    assert spark.table("once").count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()


def test_log_ledger(spark, tmp_path):
    def message(k, op, lsn, pk="o1", after=True, status="created", tx=None):
        value = {"op": op, "before": {"order_id": pk}, "after": {"order_id": pk, "order_status": status, "order_total": "12.50", "order_ts": "2024-01-01T00:00:00Z"} if after else None, "source": {"lsn": lsn}}
        return ("s.commerce.orders", 0, k, None, json.dumps(value) if tx is None else json.dumps(value | {"transaction": tx}), k)

    schema = "topic string, part int, off bigint, key string, value string, seq bigint"
    ledger = stream.LogLedger(Store(spark, f"{tmp_path}/store"))
    one = [message(0, "c", "0/10"), message(1, "u", "0/11", status="completed"), message(2, "u", "0/F"), ("s.commerce.orders", 0, 3, None, None, 3), ("s.commerce.orders", 0, 4, None, "[]", 4), message(5, "d", "0/5", "o9", after=False)]
    out = ledger.apply(spark.createDataFrame(one, schema), 0)
    assert {(r.pk, r.seq): r.change_type for r in out["changes"].collect()} == {("o1", 0): "insert", ("o1", 1): "update_after"}
    assert [r.decision for r in out["ignored"].collect()] == ["lower_lsn"] and [r.reason for r in out["rejected"].collect()] == ["invalid_json"]
    rows = cdc.typed(ledger.state.read(), "orders").collect()
    assert [(r.order_id, r.order_status, str(r.order_total)) for r in rows] == [("o1", "completed", "12.50")]
    two = [message(6, "u", "0/11"), message(7, "d", "0/12", after=False), message(8, "u", "0/10"), message(9, "c", "0/4", "o9")]
    out = ledger.apply(spark.createDataFrame(two, schema), 1)
    assert {(r.pk, r.seq): r.change_type for r in out["changes"].collect()} == {("o1", 7): "delete"}
    assert sorted(r.decision for r in out["ignored"].collect()) == ["equal_position_conflict", "lower_lsn", "lower_lsn"]
    spark.createDataFrame(one + two, schema).coalesce(1).write.parquet(f"{tmp_path}/all")
    streamed = stream.LogLedger(Store(spark, f"{tmp_path}/other"))
    stream.run_log(spark.readStream.schema(schema).parquet(f"{tmp_path}/all"), streamed, f"{tmp_path}/c").awaitTermination()
    same = lambda x: sorted(map(str, x.state.read().select("entity", "pk", "lsn", "is_deleted").collect()))
    assert same(streamed) == same(ledger)
    assert ledger.state.read().where("is_deleted").count() == 2 and ledger.apply(spark.createDataFrame(two, schema), 1) is None
