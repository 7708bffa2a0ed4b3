"""Commits that die at any step and run again, and what lands beside the tables."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_cdc import record
from test_landing import GOOD, context, landed

from tidemark.operators import backfill, cdc
from tidemark.schemas import WIDE
from tidemark.sources import files, jdbc, publication, registry, rest
from tidemark.sources.store import Exists, Store
from tidemark.sources.tables import Table
from tidemark.streaming import cdc as stream

ROWS = "id long, name string"


class Died(Exception):
    pass


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, f"{tmp_path}/store")


def dies(monkeypatch, owner, name, after=False):
    """The next call of a method dies, before or after it has done its work."""
    real = getattr(owner, name)

    def once(*args, **kw):
        monkeypatch.setattr(owner, name, real)
        if after:
            real(*args, **kw)
        raise Died

    monkeypatch.setattr(owner, name, once)


def rows(frame):
    return sorted(map(tuple, frame.collect()), key=str)


@pytest.mark.parametrize("after", [False, True])
def test_a_commit_that_died_damages_nothing(spark, store, monkeypatch, after):
    table = Table(store, "t", ROWS)
    frame = lambda *of: spark.createDataFrame(of, ROWS)
    table.commit(frame((1, "a")), "one")
    dies(monkeypatch, Store, "create", after)
    with pytest.raises(Died):
        table.commit(frame((2, "b")), "two")
    assert rows(table.read()) == ([(2, "b")] if after else [(1, "a")])
    table.commit(frame((3, "c")), "three")
    assert rows(table.read()) == [(3, "c")] and rows(table.read(1)) == [(1, "a")]
    assert [r.operation for r in table.versions().collect()] == (["three", "two", "one"] if after else ["three", "one"])


def test_two_writers_cannot_both_log_a_version(spark, store, monkeypatch):
    table = Table(store, "t", ROWS)
    table.commit(spark.createDataFrame([(1, "a")], ROWS), "one")
    entry = table.entry()
    table.commit(spark.createDataFrame([(2, "b")], ROWS), "two")
    monkeypatch.setattr(table, "entry", lambda version=None: entry)  # a writer that began before
    with pytest.raises(Exists):
        table.commit(spark.createDataFrame([(3, "c")], ROWS), "late")
    monkeypatch.undo()
    assert rows(table.read()) == [(2, "b")] and len(store.names("t/data")) == 2


def test_appends_and_upserts_leave_other_folders(spark, store):
    plain = Table(store, "p", ROWS)
    for k in range(3):
        assert plain.insert_once(spark.createDataFrame([(k, "x"), (k, "y"), (0, "z")], ROWS), "id") == 1
    assert plain.version() == 3 and len(plain.entry()["parts"]) == 3 and {r.id for r in plain.read().collect()} == {0, 1, 2}
    assert rows(plain.since(2)) == [(2, plain.read().where("id = 2").first()["name"])]
    assert plain.insert_once(spark.createDataFrame([(1, "x")], ROWS), "id") == 0 and plain.version() == 3
    keyed = Table(store, "k", ROWS, keys=["id"], buckets=8)
    keyed.commit(spark.createDataFrame([(k, "old") for k in range(100)], ROWS), "load")
    before = {p["bucket"]: p["folder"] for p in keyed.entry()["parts"]}
    keyed.put(spark.createDataFrame([(5, "new"), (200, "new")], ROWS))
    after = {p["bucket"]: p["folder"] for p in keyed.entry()["parts"]}
    assert 6 <= sum(before[b] == after[b] for b in before) < 8
    assert rows(keyed.read()) == sorted([(k, "new" if k in (5, 200) else "old") for k in [*range(100), 200]], key=str)
    assert rows(keyed.read(1)) == sorted([(k, "old") for k in range(100)], key=str)
    newer = F.col("s.name") > F.col("t.name")
    assert keyed.merge(spark.createDataFrame([(5, "newest"), (6, "a"), (300, "b")], ROWS), ["id"], newer) == {"insert": 1, "update": 1, "unchanged": 1}
    keyed.add_column("note string")
    again = Table(store, "k", ROWS, keys=["id"], buckets=8)
    assert again.read().columns == ["id", "name", "note"] and again.read().where("note IS NOT NULL").isEmpty()


STEPS = [[(record("load"), 0), (record("update", "16/B6C60", order_status="completed"), 1), ("{", 2)], [(record("delete", "16/B6C70"), 3), (record("update", "16/B6C65", order_status="late"), 4), (record("update", "10/0", order_id="o2"), 5)]]


def state(ledger):
    return [rows(ledger.state.read().drop("applied_at")), rows(ledger.aside.read())]


@pytest.mark.parametrize("where", ["nothing", "aside", "before", "after", "marker"])
def test_a_ledger_that_died_and_replays(spark, tmp_path, monkeypatch, where):
    frames = [spark.createDataFrame(s, "value string, seq bigint") for s in STEPS]
    good, torn = (stream.Ledger(Store(spark, f"{tmp_path}/{n}")) for n in ("good", "torn"))
    for number, frame in enumerate(frames):
        good.apply(frame, number)
        if where != "nothing":
            owner, name, after = {"aside": (Table, "insert_once", True), "before": (Table, "put", False), "after": (Table, "put", True), "marker": (Store, "create_same", False)}[where]
            dies(monkeypatch, owner, name, after)
            with pytest.raises(Died):
                torn.apply(frame, number)
        torn.apply(frame, number)
        assert torn.apply(frame, number) is None
    assert state(torn) == state(good)
    assert [r.reason for r in torn.quarantined().collect()] == ["invalid_json", "stale_source_position"]
    full = {r.order_id: r for r in torn.rows("orders").collect()}
    assert full["o1"].is_deleted and full["o1"].payload_json is None and full["o1"].source_lsn == "16/B6C70" and full["o1"].dms_operation == "delete"
    assert full["o2"].order_status == "created" and full["o2"].source_table == "orders" and json.loads(full["o2"].raw_event_json)["data"]["order_id"] == "o2"


@pytest.mark.parametrize("where", ["before", "after", "marker"])
def test_a_log_ledger_keeps_its_changes_on_replay(spark, tmp_path, monkeypatch, where):
    schema = "topic string, part int, off bigint, key string, value string, seq bigint"
    value = lambda lsn, status: json.dumps({"op": "u", "after": {"order_id": "o1", "order_status": status}, "source": {"lsn": lsn}})
    frame = spark.createDataFrame([("s.c.orders", 0, k, None, value(f"0/{k + 1}", f"s{k}"), k) for k in range(3)], schema)
    ledger = stream.LogLedger(Store(spark, f"{tmp_path}/s"))
    owner, name, after = {"before": (Table, "put", False), "after": (Table, "put", True), "marker": (Store, "create_same", False)}[where]
    dies(monkeypatch, owner, name, after)
    with pytest.raises(Died):
        ledger.apply(frame, 0)
    ledger.apply(frame, 0)
    assert sorted((r.seq, r.change_type) for r in ledger.outputs(0)["changes"].collect()) == [(0, "insert"), (1, "update_after"), (2, "update_after")]
    assert ledger.outputs(0)["rejected"].isEmpty() and ledger.state.read().first()["seq"] == 2


def test_control_files_are_whole_and_written_once(store):
    store.create("a/x.json", b"1")
    with pytest.raises(Exists):
        store.create("a/x.json", b"2")
    assert store.read("a/x.json") == b"1" and store.names("a") == ["x.json"]
    store.replace("a/x.json", b"3")
    assert store.read("a/x.json") == b"3" and store.size("a/x.json") == 1
    assert publication.report(store, "r/one.json", {"a": 1}) and not publication.report(store, "r/one.json", {"a": 1})
    with pytest.raises(Exists):
        publication.report(store, "r/one.json", {"a": 2})
    for key in ("/etc/x", "a/../../x"):
        with pytest.raises(ValueError):
            store.path(key)


def test_retries_say_what_they_found(spark, store):
    publisher, of = publication.Publisher(store), context()
    publisher.publish(of, landed(spark, GOOD, of))
    assert publisher.publish(of, landed(spark, GOOD, of)).detail == "verified_identical_retry"
    later = context(ingested="2025-03-01T00:00:00Z")
    assert publisher.publish(later, landed(spark, GOOD, later)).detail == "verified_independent_replay_preserved_first_ingestion"
    key = publisher.quarantine_lines(of, spark.createDataFrame([(1, "bad"), (2, "worse")], ROWS))
    assert publisher.quarantine_lines(of, spark.createDataFrame([(3, "other")], ROWS)) == key
    assert sorted(r.id for r in spark.read.json(store.path(key)).collect()) == [1, 2]
    found = files.bronze(spark, store.path("bronze"))
    assert found.count() == 2 and dict(found.dtypes)["ingested_at"] == "timestamp" and "ingestion_id" in found.columns


def test_rows_of_a_split_file_are_numbered(spark, tmp_path):
    path = Path(tmp_path) / "a.csv"
    path.write_text("id,name\n" + "".join(f"{k},{'x' * (k % 50)}\n" for k in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "10000")
    try:
        found = files.read_numbered_csv(spark, str(path), ROWS)
        assert found.rdd.getNumPartitions() > 1 and all(r.id == r.row_number for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    with pytest.raises(ValueError):
        files.read_csv(spark, str(path) + ".exe", ROWS)


def test_a_sweep_sets_aside_what_is_malformed(spark, tmp_path):
    folder = Path(tmp_path)
    contents = {"a.csv": "id,name\n1,x\n", "b.csv": "id,name\n1,x\n", "c.csv": "ident\n1\n", "d.json": '[{"id": 1}]', "e.json": "{broken", "f.json": "3", "g.exe": "x", "h.json": "[]"}
    for name, text in contents.items():
        (folder / name).write_text(text)
    land, aside = files.sweep(spark, str(folder), ["a.csv", "gone.csv"], {"a.csv": ["id", "name"], "c.csv": ["id"]})
    name = lambda path: path.rsplit("/", 1)[-1]
    assert {name(r.path) for r in land.collect()} == {"a.csv", "d.json", "h.json"}
    assert {name(r.path): r.reason for r in aside.collect()} == {"b.csv": "duplicate_content", "c.csv": "malformed_file", "e.json": "malformed_file", "f.json": "malformed_file", "g.exe": "unsupported_file_type", "gone.csv": "expected_file_missing"}


def test_ranges_deal_out_each_row_once(spark):
    parts = jdbc.predicates("orders", "2025-01-01T00:00:00Z", "2025-01-02T00:00:00Z", 4)
    at = spark.sql("SELECT explode(sequence(TIMESTAMP '2024-12-31 12:00:00', TIMESTAMP '2025-01-02 12:00:00', INTERVAL '1' HOUR)) AS updated_at")
    hits = [at.where(p).count() for p in parts]
    assert hits == [6, 6, 6, 6]
    cut = jdbc.predicates("orders", splits=["o3", "o'6"])
    keys = spark.createDataFrame([(k,) for k in ("a", "o3", "o4", "o'6", "z", "o9")], "order_id string")
    assert sum(keys.where(p.replace("''", "\\'")).count() for p in cut) == 6 and jdbc.predicates("orders") == ["1 = 1"]
    bad = spark.createDataFrame([("o1", None)], "order_id string, customer_id string").withColumns({c: F.lit("1") for c in ("order_status", "currency", "order_total")}).withColumns({c: F.current_timestamp() for c in ("order_ts", "updated_at")})
    with pytest.raises(Exception, match="invalid_source_schema:missing:customer_id"):
        jdbc.checked(bad, "orders").collect()
    assert jdbc.checked(bad.withColumn("customer_id", F.lit("c")), "orders").columns == bad.columns


def test_pages_are_asked_for_when_they_are_wanted():
    asked = []

    class Client:
        def get(self, url, timeout):
            asked.append(url)
            return rest.Response(200, json.dumps({"items": [{"n": len(asked)}], "next_page": len(asked) + 1}).encode(), {})

    pages = rest.follow("https://h/x", Client())
    assert next(pages).items == [{"n": 1}] and len(asked) == 1
    with pytest.raises(rest.SourceError, match="max_pages_exceeded"):
        rest.records("https://h/x", Client(), max_pages=3)


def test_registry_holds_to_its_contract():
    one = {"source_id": "d", "source_type": "json_file", "source_entity": "devices", "contract_version": "v1", "enabled": True, "max_records": 5, "local_path": "in/d.json"}
    parse = lambda source, **kw: registry.Registry.parse(json.dumps({"registry_version": registry.VERSION, "sources": [source]}), **kw)
    assert parse(one, roots=["in"]).get("d").local_path == "in/d.json"
    for source, kw in ((one | {"contract_version": "v0"}, {}), (one, {"roots": ["elsewhere"]}), (one | {"local_path": "in/../x.json"}, {})):
        with pytest.raises(registry.RegistryError):
            parse(source, **kw)


def test_the_log_fans_out(spark, tmp_path):
    value = lambda op, **kw: json.dumps({"op": op, "source": {"lsn": "0/1", "txId": "7"}, **kw})
    messages = [
        ("s.c.orders", 0, 1, None, value("c", after={"order_id": "o1", "order_total": "12.345"})), ("s.c.orders", 0, 2, None, value("d", before={"order_id": "o2"})),
        ("s.c.products", 0, 3, None, value("c", after={"product_id": "p", "unit_price": "x"})), ("s.c.orders", 0, 4, None, "{"), ("s.c.orders", 0, 5, None, None),
    ]
    schema = "topic string, part int, off bigint, key string, value string"
    spark.createDataFrame(messages, schema).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    stream.fan_out(source, f"{tmp_path}/out", f"{tmp_path}/c1", trigger={"availableNow": True}).awaitTermination()
    sink = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}").drop("batch")
    orders = {r.order_id: r for r in sink("core_orders").collect()}
    assert str(orders["o1"].order_total) == "12.35" and orders["o2"].order_total is None and orders["o2"].source_tx_id == "7"
    assert sink("core_products").first()["unit_price"] is None and sink("core_payments").count() == 0
    assert sink("bronze_cdc_orders").count() == 4 and sink("quarantine_cdc").count() == 1
    stream.archive_lines(source, f"{tmp_path}/lines", f"{tmp_path}/c2", trigger={"availableNow": True}).awaitTermination()
    lines = spark.read.json(f"{tmp_path}/lines")
    assert lines.count() == 5 and {"entity", "year", "month", "day"} <= set(lines.columns)
    wide = cdc.wide(cdc.parse_debezium(spark.createDataFrame(messages, schema)).where("reason IS NULL AND value IS NOT NULL"), F.current_timestamp())
    assert tuple(wide.columns) == WIDE and len(WIDE) == 31
    back = cdc.from_event(cdc.to_event(wide), wide.schema.simpleString())
    assert rows(back.drop("applied_at")) == rows(wide.drop("applied_at"))
    (Path(tmp_path) / "nd").mkdir()
    (Path(tmp_path) / "nd" / "a.ndjson").write_text("\n".join(v for v, _ in STEPS[0] + STEPS[1]) + "\n")
    ledger = stream.Ledger(Store(spark, f"{tmp_path}/ledger"))
    stream.run(stream.lines(spark, f"{tmp_path}/nd"), ledger, f"{tmp_path}/c3").awaitTermination()
    assert [(r.pk, r.is_deleted) for r in ledger.state.read().orderBy("pk").collect()] == [("o1", True), ("o2", False)] and ledger.aside.read().count() == 2


def test_seeds_and_bounds(spark, tmp_path):
    (Path(tmp_path) / "rates.csv").write_text("day,rate\n2025-01-01,7.45\n")
    seeds = files.seeds(spark, str(tmp_path), {"rates": "day date, rate decimal(10,4)"})
    assert str(seeds["rates"].first()["rate"]) == "7.4500"
    from datetime import datetime, timezone

    at = lambda day: datetime(2025, 1, day, tzinfo=timezone.utc)
    request = lambda **kw: backfill.Request(**({"run": "8f40746f-d3ce-52c7-9694-9f367cf03f40", "namespace": "silver", "start": at(1), "end": at(2), "manifest_keys": ("a", "b")} | kw))
    backfill.check_request(request())
    for wrong, token in (({"most_bytes": 0}, "payload_verification_bound_invalid"), ({"most_bytes": 1 << 40}, "payload_verification_bound_invalid"), ({"end": at(1)}, "invalid_expected_interval"), ({"run": "x"}, "invalid_validation_run_identity"), ({"namespace": "a-b"}, "invalid_namespace")):
        with pytest.raises(backfill.BackfillError, match=token):
            backfill.check_request(request(**wrong))
