"""Every registered query with a statement gives the statement's rows."""

import datetime
import decimal
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.operators import silver
from tidemark.plans import catalogue, oracles
from tidemark.streaming import cdc as stream

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else repr(round(value, 6) + 0.0)
    if isinstance(value, datetime.datetime):
        return str(value.replace(tzinfo=None))
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return None if value is None else str(value)


def test_all_have_statements():
    assert set(catalogue.QUERIES) == set(catalogue.ORACLES)


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    ours = sorted((tuple(plain(x) for x in r) for r in frame.select(*columns).collect()), key=str)
    found = duck.sql(catalogue.ORACLES[name])
    assert sorted(found.columns) == columns
    at = [found.columns.index(c) for c in columns]
    theirs = sorted((tuple(plain(r[i]) for i in at) for r in found.fetchall()), key=str)
    assert ours == theirs


#: Statements of the whole job, where the registered one asks for less.
WHOLE = {
    "event_dedup_by_id": "SELECT * FROM (SELECT * FROM events UNION ALL SELECT * FROM events) QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY ts) = 1",
    "route_by_type": "SELECT entity, count(*) AS row_count FROM cdc_positions GROUP BY entity",
    "ordered_scan": "SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_suppkey)::INTEGER AS place FROM supplier",
}


@pytest.mark.parametrize("name", sorted(WHOLE))
def test_whole_job(spark, duck, name):
    found = duck.sql(oracles.statement(WHOLE[name]))
    ours = catalogue.QUERIES[name](spark, SF).select(*found.columns).collect()
    assert sorted((tuple(plain(x) for x in r) for r in ours), key=str) == sorted((tuple(plain(x) for x in r) for r in found.fetchall()), key=str)


def test_positions_of_over_32_bits(spark, duck, tmp_path):
    keys = [0, 65534, 65535, 65536, 99_999, 6_000_000, 1 << 40, 1 << 46]
    rows = duck.sql(f"SELECT * REPLACE ({keys}[row_number() OVER ()] AS event_id, 1000000 - user_id AS user_id) FROM events LIMIT {len(keys)}")
    rows.write_parquet(f"{tmp_path}/events.parquet")
    mine = catalogue.QUERIES["lsn_parse"](spark, str(tmp_path)).select("event_id", "lsn_text", "lsn").collect()
    whole = catalogue.ORACLES["lsn_parse"].replace("FROM events", f"FROM '{tmp_path}/events.parquet'")
    theirs = duck.sql(f"SELECT event_id, lsn_text, lsn FROM ({whole})").fetchall()
    assert sorted(map(tuple, mine)) == sorted(theirs) and len(theirs) == len(keys)
    texts = ["FFFFFFFF/FFFFFFFF", "0/100000000", "123456789/1", "1/12345678901234567", "1/", "x/1", None]
    found = spark.createDataFrame([(n, x) for n, x in enumerate(texts)], "n int, t string").select("n", X.lsn(F.col("t")), X.stream_position(F.col("t"))).collect()
    assert [tuple(r)[1:] for r in sorted(found)] == [(2**64 - 1, 2**64 - 1), (2**32, None)] + [(None, None)] * 5


def test_numbered(spark):
    keys = [k * k % 7919 for k in range(3000)]
    keys = [*dict.fromkeys(keys), None]
    found = silver.numbered(spark.createDataFrame([(k,) for k in keys], "k long").repartition(5), "k", "place").collect()
    assert {r.k: r.place for r in found} == {k: n for n, k in enumerate([*sorted(keys[:-1]), None], 1)} and len(found) == len(keys)
    assert silver.numbered(spark.createDataFrame([], "k long"), "k", "place").collect() == []
    assert [r.s_suppkey for r in catalogue.QUERIES["ordered_scan"](spark, SF).collect()] == sorted(r.s_suppkey for r in spark.read.parquet(f"{SF}/supplier.parquet").collect())


def test_once_by_id_of_a_batch(spark):
    rows = [(1, 5, "b"), (1, 3, "c"), (1, 3, "a"), (1, None, "0"), (2, None, "x"), (3, 1, "a"), (4, 1, "a")]
    found = stream.once_by_id(spark.createDataFrame(rows, "event_id long, ts long, `a.b` string").repartition(3))
    assert found.columns == ["event_id", "ts", "a.b"]
    assert sorted(map(tuple, found.collect()), key=str) == [(1, 3, "a"), (2, None, "x"), (3, 1, "a"), (4, 1, "a")]
