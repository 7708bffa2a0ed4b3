"""Landing, silver tables and backfill validation, end to end."""

import json
import shutil
from datetime import datetime, timezone
from pathlib import Path

import pytest

from tidemark.operators import backfill
from tidemark.plans.batch import Silver
from tidemark.sources import files, jdbc, registry, rest
from tidemark.sources.batch import BatchContext, resolve_run
from tidemark.sources.events import Emitter
from tidemark.sources.landing import content_checksum, envelope
from tidemark.sources.publication import ManifestError, Publisher, reprocess, verify
from tidemark.sources.store import Exists, Store

RATES = "rate_date string, base_currency string, quote_currency string, rate string, retrieved_at string"
LOCATIONS = "location_id string, location_name string, country_code string, timezone string, updated_at string"


def context(entity="exchange_rates", day=1, ingested="2025-02-10T00:00:00Z"):
    made = resolve_run(f"2025-02-{day:02d}", f"2025-02-{day:02d}T00:00:00Z", f"2025-02-{day + 1:02d}T00:00:00Z", ingested)
    return made("rest_api", entity)


def landed(spark, rows, of, schema=RATES, extracted="retrieved_at", key=("rate_date", "base_currency", "quote_currency")):
    from pyspark.sql import functions as F

    frame = spark.createDataFrame(rows, schema)
    return envelope(
        frame, ingestion_id=of.ingestion_id, source_name=of.source_name, source_entity=of.source_entity, key=key,
        ingested_at=of.ingested_at.isoformat(), extracted=extracted, locator=F.concat(F.lit("row="), F.monotonically_increasing_id()),
    )


GOOD = [("2025-02-01", " eur", "dkk ", "7.48", "2025-02-01T00:00:00Z"), ("2025-02-01", "EUR", "DKK", "7.47", "2025-01-31T00:00:00Z")]
BAD = [("2025-02-01", "EUR", "EUR", "-1", "2025-02-01T00:00:00Z"), ("never", "EUR", "DKK", "x", None)]


def test_publication(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/a")
    publisher, of = Publisher(store), context()
    frame = landed(spark, GOOD, of)
    first = publisher.publish(of, frame)
    assert (first.status, first.detail, first.record_count) == ("published", "committed_new_data", 2)
    later = context(ingested="2025-03-01T00:00:00Z")
    assert later.ingestion_id == of.ingestion_id
    again = publisher.publish(later, landed(spark, GOOD, later))
    assert again.status == "already_published"
    assert publisher.publish(of, landed(spark, GOOD[:1], of)).detail == "source_content_conflict"
    store.delete(first.manifest_key)
    assert publisher.publish(of, landed(spark, GOOD[:1], of)).detail == "data_exists_with_different_source_content"
    assert publisher.publish(of, frame).detail == "recovered_matching_orphan_data"
    assert len(publisher.list_committed()) == 1
    with pytest.raises(Exists):
        store.create(first.manifest_key, b"{}")
    one = publisher.quarantine(of, "bad", "row=1", {"a": 1})
    assert publisher.quarantine(of, "bad", "row=1", {"a": 1}) == one
    told = []
    emit = Emitter(lambda line: told.append(json.loads(line)))
    assert reprocess(publisher, first.manifest_key, lambda m: m["record_count"], emit) == 2
    with pytest.raises(ZeroDivisionError):
        reprocess(publisher, first.manifest_key, lambda m: 1 / 0, emit)
    assert [t["status"] for t in told] == ["completed", "failed"]


def test_verify_refuses(spark, tmp_path):
    store, of = Store(spark, f"{tmp_path}/a"), context()
    key = Publisher(store).publish(of, landed(spark, GOOD, of)).manifest_key
    assert verify(store, key)["record_count"] == 2
    good = json.loads(store.read(key))

    def token(**changes):
        store.replace(key, json.dumps({k: v for k, v in (good | changes).items() if v is not None}).encode())
        with pytest.raises(ManifestError) as found:
            verify(store, key)
        return str(found.value)

    assert token(record_count=None) == "manifest_fields_do_not_match_contract"
    assert token(manifest_version="x") == "unsupported_manifest_version"
    assert token(source_entity="orders") == "source_entity_not_owned_by_batch"
    assert token(interval_end="2025-02-01T00:00:00Z") == "invalid_logical_interval"
    assert token(interval_end="2025-02-03T00:00:00Z") == "logical_run_identity_mismatch"
    assert token(data_key="bronze/x") == "manifest_and_data_paths_do_not_match_identity"
    assert token(record_count=-1) == "invalid_record_count"
    assert token(record_count=3) == "record_count_mismatch"
    assert token(payload_checksum="sha256:0") == "invalid_checksum_encoding"
    assert token(payload_checksum="sha256:" + "0" * 64) == "payload_checksum_mismatch"
    with pytest.raises(ManifestError, match="prefix"):
        verify(store, "elsewhere/_COMMITTED.json")
    shutil.rmtree(f"{tmp_path}/a/{of.folder}/data.parquet")
    assert token() == "committed_data_object_missing"


def test_silver_and_backfill(spark, tmp_path):
    store = Store(spark, f"{tmp_path}/a")
    publisher, silver = Publisher(store), Silver(store)
    tallies = lambda r: (r.input_count, r.accepted_count, r.rejected_count, r.duplicate_count, r.unique_winner_count, r.inserted_count, r.updated_count, r.unchanged_count)

    def process(of, rows, **kw):
        return silver.process(publisher.publish(of, landed(spark, rows, of, **kw)).manifest_key)

    of = context()
    assert tallies(process(of, GOOD + BAD)) == (4, 2, 2, 1, 1, 1, 0, 0)
    version = silver.reference["exchange_rates"].version()
    assert tallies(process(of, GOOD + BAD))[5:] == (0, 0, 1)
    assert silver.reference["exchange_rates"].version() == version  # nothing changed, nothing committed
    assert silver.quarantine.read().count() == 3 and silver.reconciliation.read().count() == 1
    newer = [("2025-02-01", "EUR", "DKK", "7.4800000004", "2025-02-02T00:00:00Z"), ("2025-02-02", "EUR", "DKK", "7.5", "2025-02-02T00:00:00Z")]
    assert tallies(process(context(day=2), newer))[5:] == (1, 1, 0)
    stale = [("2025-02-01", "EUR", "DKK", "1", "2025-01-01T00:00:00Z")]
    assert tallies(process(context(day=3), stale))[5:] == (0, 0, 1)
    table = silver.reference["exchange_rates"]
    assert {str(r.rate) for r in table.read().collect()} == {"7.4800000004", "7.5000000000"} and table.read(version).count() == 1
    place = dict(schema=LOCATIONS, extracted="updated_at", key=("location_id",))
    same = [("l1", "Here", "dk", "Europe/Copenhagen", "2025-02-02T00:00:00Z")] * 3
    assert tallies(process(context("locations", 2), same, **place)) == (3, 3, 0, 2, 1, 1, 0, 0)

    keys = lambda *of: tuple(f"{c.folder}/_COMMITTED.json" for c in of)
    once = context("locations", 5)
    process(once, same[:1], **place)
    utc = lambda d: datetime(2025, 2, d, tzinfo=timezone.utc)
    request = lambda *of, a=1, b=9: backfill.Request("8f40746f-d3ce-52c7-9694-9f367cf03f40", "silver", utc(a), utc(b), keys(*of))
    report = silver.validate_backfill(request(context(day=2), once))
    assert report["exchange_rates"]["exact_match_count"] == 2 and report["locations"]["superseded_by_newer_count"] + report["locations"]["exact_match_count"] == 1
    assert silver.validate_backfill(request(context(day=2), once)) == report
    assert silver.validate_backfill(request(context(day=3), once))["exchange_rates"]["superseded_by_newer_count"] == 1

    def token(bad):
        with pytest.raises(backfill.BackfillError) as found:
            silver.validate_backfill(bad)
        return str(found.value)

    assert token(request(context(), once)) == "invalid_historical_reference_value"
    assert token(request(context(day=2))) == "required_reference_entity_manifest_missing_or_unexpected"
    assert token(request(context(day=2), context(day=2))) == "invalid_manifest_selection"
    assert token(request(context(day=2), once, a=4)) == "manifest_outside_expected_interval"
    assert token(request(context(day=2), context("locations", 2))) == "duplicate_historical_business_key"
    assert token(request(context(day=7), once)) == "manifest_unreadable_or_malformed"


def test_batch_identity():
    of = context()
    assert of.ingestion_id == context(ingested="2030-01-01T00:00:00Z").ingestion_id != context(day=2).ingestion_id
    with pytest.raises(ValueError):
        BatchContext("a", "b", of.logical_date, of.end, of.start, of.ingested_at)
    with pytest.raises(ValueError):
        resolve_run("2025-01-01", "2025-01-01T00:00:00Z", "2025-01-02T00:00:00Z", "2025-01-02T00:00:00Z", backfill_start="2025-01-01T00:00:00Z")


def test_envelope_and_checksum(spark):
    of = context()
    frame = landed(spark, GOOD, of)
    with pytest.raises(ValueError, match="reserved_envelope_field"):
        envelope(frame, ingestion_id="x", source_name="x", source_entity="x", key=(), ingested_at="x")
    one = content_checksum(frame.drop("source_locator")).first()[0]
    assert one == content_checksum(landed(spark, GOOD[::-1], context(ingested="2026-01-01T00:00:00Z")).drop("source_locator")).first()[0]


class Pages:
    def __init__(self, *answers):
        self.answers, self.asked = list(answers), []

    def get(self, url, timeout):
        self.asked.append(url)
        answer = self.answers.pop(0)
        if isinstance(answer, Exception):
            raise answer
        status, body, *headers = answer
        return rest.Response(status, json.dumps(body).encode() if not isinstance(body, bytes) else body, headers[0] if headers else {})


def test_rest_pages():
    page = lambda items, after: (200, {"items": items, "next_page": after}, {"ETag": "v1"})
    waits = []
    client = Pages((429, {}, {"Retry-After": "90"}), page([{"a": 1}], 2), ConnectionError("x"), page([{"a": 2}], None))
    found = rest.records("https://h/r?size=1", client, sleep=waits.append)
    assert [x[0]["a"] for x in found] == [1, 2] and found[1][1] == "https://h/r?size=1&page=2#item=0" and found[0][2] == "v1"
    assert waits == [30.0, 0.25]

    def token(*answers, **bounds):
        with pytest.raises(rest.SourceError) as error:
            rest.records("https://h/r", Pages(*answers), sleep=waits.append, **bounds)
        return error.value.reason

    assert token(page([], 1)) == "pagination_loop"
    assert token(page([], 2), max_pages=1) == "max_pages_exceeded"
    assert token(page([{}, {}], None), max_records=1) == "max_records_exceeded"
    assert token((404, {})) == "rest_non_retryable_http"
    assert token((503, {}), (503, {}), (503, {})) == "rest_retry_exhausted"
    assert token((200, b"{")) == "malformed_json"
    assert token((200, {"items": []})) == "invalid_response_schema"
    assert token(page([3], None)) == "invalid_response_schema"
    assert token(page([], "2")) == "invalid_next_page"
    assert token(*[ConnectionError("x")] * 3) == "rest_transport_error"


def test_rest_source(spark):
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer
    from urllib.parse import parse_qs, urlparse

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            page = int(parse_qs(urlparse(self.path).query)["page"][0])
            body = json.dumps({"items": [{"n": page}], "next_page": page + 1 if page < 3 else None}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    spark.dataSource.register(rest.PagedRest)
    found = spark.read.format("paged_rest").option("url", f"http://127.0.0.1:{server.server_port}/x").load()
    assert [json.loads(r.item)["n"] for r in found.collect()] == [1, 2, 3]
    server.shutdown()


def test_files(spark, tmp_path):
    folder = Path(tmp_path)
    (folder / "a.csv").write_bytes(b"\xef\xbb\xbfcategory_code,category_name,sort_order\nc1,One,1\n")
    (folder / "b.csv").write_bytes((folder / "a.csv").read_bytes())
    (folder / "d.json").write_text('[{"device_id": "d1", "location_id": "l"}, {"device_id": "d2"}]')
    (folder / "one.json").write_text('{"device_id": "d3"}')
    rows = files.read_csv(spark, f"{folder}/a.csv", "category_code string, category_name string, sort_order string").collect()
    assert [tuple(r) for r in rows] == [("c1", "One", "1")]
    found = files.rows_of(spark, f"{folder}/*.json", "device_id string, location_id string").collect()
    assert sorted(r.device_id for r in found) == ["d1", "d2", "d3"] and all("#row=" in r.source_locator for r in found)
    land, aside = files.sweep(spark, str(folder), ["a.csv", "gone.csv"])
    assert land.count() == 3 and sorted(r.reason for r in aside.collect()) == ["duplicate_content", "expected_file_missing"]
    assert files.read_json(spark, f"{folder}/d.json", "device_id string").count() == 2


def test_jdbc_statement():
    assert jdbc.statement("orders") == "SELECT * FROM commerce.orders ORDER BY order_id"
    assert ">= TIMESTAMP '2025-01-01 00:00:00'" in jdbc.statement("orders", "2025-01-01T00:00:00Z", "2025-01-02T00:00:00Z")
    for bad in (("users",), ("orders", "2025-01-01"), ("orders", "x' OR 1=1", "2025-01-01")):
        with pytest.raises(ValueError):
            jdbc.statement(*bad)


def test_registry():
    one = {"source_id": "r", "source_type": "rest_api", "source_entity": "locations", "contract_version": "v1", "enabled": True, "max_records": 5, "endpoint_env": "URL", "allowed_hosts": ["h.example"]}
    parse = lambda *s: registry.Registry.parse(json.dumps({"registry_version": registry.VERSION, "sources": s}))
    source = parse(one).get("r")
    assert registry.Registry.endpoint(source, {"URL": "https://h.example/x"}) == "https://h.example/x"
    for url in ("http://h.example/x", "https://other/x", "https://u:p@h.example/", "https://h.example/#f"):
        with pytest.raises(registry.RegistryError):
            registry.Registry.endpoint(source, {"URL": url})
    bad = [
        [one, one], [one, one | {"source_id": "s"}], [one | {"source_entity": "orders"}], [one | {"max_records": 0}], [one | {"extra": 1}],
        [one | {"source_type": "csv_file", "source_entity": "product_categories", "local_path": "../x.csv"}],
    ]
    for sources in bad:
        with pytest.raises(registry.RegistryError):
            parse(*sources)
    for name in ("x", "off"):
        with pytest.raises(registry.RegistryError):
            parse(one | {"source_id": "off", "enabled": False}).get(name)


def test_events():
    emit = Emitter(lambda line: None)
    assert emit(component="a", action="b", run_identity="c", status="noop").at.endswith("Z")
    for wrong in ({"status": "odd"}, {"record_count": -1}, {"component": ""}):
        with pytest.raises(ValueError):
            emit(**({"component": "a", "action": "b", "run_identity": "c", "status": "noop"} | wrong))


def test_runner(spark, tmp_path):
    from tidemark.sources import runner

    source = lambda **kw: {"contract_version": "v1", "enabled": True, "max_records": 5} | kw
    made = registry.Registry.parse(json.dumps({"registry_version": registry.VERSION, "sources": [
        source(source_id="rates", source_type="rest_api", source_entity="exchange_rates", endpoint_env="URL", allowed_hosts=["h"]),
        source(source_id="categories", source_type="csv_file", source_entity="product_categories", local_path="c.csv"),
        source(source_id="devices", source_type="json_file", source_entity="devices", local_path="d.json"),
    ]}))
    (Path(tmp_path) / "c.csv").write_text("category_code,category_name,sort_order\nc1,One,1\n")
    (Path(tmp_path) / "d.json").write_text('[{"device_id": "d", "location_id": "l", "device_type": "t", "device_status": "s", "updated_at": "never"}]')
    publisher, told = Publisher(Store(spark, f"{tmp_path}/lake")), []
    emit = Emitter(lambda line: told.append(json.loads(line)["status"]))
    of = lambda name, entity: BatchContext(name, entity, context().logical_date, context().start, context().end, context().ingested_at)
    go = lambda i, name, entity, **kw: runner.run(spark, made, publisher, emit, i, of(name, entity), root=str(tmp_path), **kw)
    rate = dict(zip(("rate_date", "base_currency", "quote_currency", "rate", "retrieved_at"), GOOD[0]))
    pages = lambda *items: Pages((200, {"items": [*items], "next_page": None}, {"ETag": "v1"}))
    web = dict(environ={"URL": "https://h/x"})
    assert go("rates", "rest_api", "exchange_rates", client=pages(rate | {"rate": 7.5}), **web).status == "published"
    assert go("rates", "rest_api", "exchange_rates", client=pages(rate | {"rate": 7.5}), **web).status == "already_published"
    assert go("rates", "rest_api", "exchange_rates", client=pages(rate), **web).detail == "source_content_conflict"
    assert "rejection=" in go("rates", "rest_api", "exchange_rates", client=pages(rate, rate | {"rate": "-1"}), **web)
    assert go("categories", "csv_file", "product_categories").record_count == 1
    assert "rejection=" in go("devices", "json_file", "devices")
    assert told == ["completed", "completed", "completed", "noop", "completed", "conflicted", "failed", "quarantined", "completed", "completed", "failed", "quarantined"]
    with pytest.raises(registry.RegistryError):
        go("rates", "csv_file", "exchange_rates")


def test_bridge(spark, tmp_path):
    from tidemark.sources import bridge

    store = Store(spark, f"{tmp_path}/x")
    frame = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    key = bridge.export(store, "out", "p1", {"t": (frame, ["id"])})
    assert bridge.load(store, key, "p1", ["t"])["t"].count() == 2
    for phase, names in (("p2", ["t"]), ("p1", ["t", "u"])):
        with pytest.raises(bridge.BridgeError):
            bridge.load(store, key, phase, names)
    told = json.loads(store.read(key))
    for change in ({"row_count": 3}, {"checksum": "sha256:0"}, {"path": "elsewhere"}):
        store.replace(key, json.dumps(told | {"tables": {"t": told["tables"]["t"] | change}}).encode())
        with pytest.raises(bridge.BridgeError):
            bridge.load(store, key, "p1", ["t"])
