"""Versioned Parquet tables: a log of versions, each naming the folders its rows lie in.

A commit writes its rows to a folder of its own, under a name nobody else can have, and then
creates the next log entry, at most once. The highest entry is the table; there is no pointer,
so nothing is ever replaced or half there. A writer that dies before its entry leaves a folder
that no version names; one that comes second finds its number taken and fails.

Appends add a folder. Tables with ``keys`` keep their rows in buckets by key, and an upsert
rewrites only the buckets it touches.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import silver
from tidemark.sources.store import Exists, Store

BUCKET = "_bucket"
#: Appends beyond so many folders write the table anew, as one.
MOST_FOLDERS = 64


class Table:
    """A table at ``key`` of a store. Readers keep the version they began with.

    ``partition_by`` lays folders out by columns, ``keys`` with ``buckets`` by a hash of the key.
    """

    def __init__(self, store: Store, key: str, schema: str, partition_by: Sequence[str] = (), keys: Sequence[str] = (), buckets: int = 16):
        self.store, self.key, self.partition_by, self.keys, self.buckets = store, key, tuple(partition_by), tuple(keys), buckets
        self._schema = schema

    @property
    def spark(self) -> SparkSession:
        return self.store.spark

    @property
    def schema(self) -> str:
        return self.entry().get("schema", self._schema)

    @property
    def columns(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def version(self) -> int:
        return max((int(n.removesuffix(".json")) for n in self.store.names(f"{self.key}/log")), default=0)

    def entry(self, version: int | None = None) -> dict:
        """The log entry of a version, of the latest by default; empty before the first."""
        at = self.version() if version is None else version
        return json.loads(self.store.read(f"{self.key}/log/{at:012d}.json")) if at else {}

    def _load(self, parts: Sequence[dict], schema: str) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], schema)
        reader, paths = self.spark.read.schema(schema), [self.store.path(p["folder"]) for p in parts]
        # Partitioned folders are roots of their own; there are MOST_FOLDERS at most.
        return reduce(DataFrame.unionByName, map(reader.parquet, paths)) if self.partition_by else reader.parquet(*paths)

    def read(self, version: int | None = None) -> DataFrame:
        entry = self.entry(version)
        return self._load(entry.get("parts", ()), entry.get("schema", self._schema))

    def since(self, version: int) -> DataFrame:
        """The rows that folders hold which ``version`` does not name: what was appended or rewritten since."""
        known = {p["folder"] for p in self.entry(version).get("parts", ())}
        entry = self.entry()
        return self._load([p for p in entry.get("parts", ()) if p["folder"] not in known], entry.get("schema", self._schema))

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _write(self, frame: DataFrame) -> list[dict]:
        """Rows to a new folder; what the log says about it."""
        folder = f"{self.key}/data/{uuid.uuid4().hex}"
        rows, by = frame.select(*self.columns), list(self.partition_by)
        if self.keys:
            # One task a bucket and write; a bucket holds its share of the keys.
            rows, by = rows.withColumn(BUCKET, self._bucket()).repartition(self.buckets, BUCKET), [BUCKET]
        writer = rows.write.option("partitionOverwriteMode", "static")
        (writer.partitionBy(*by) if by else writer).parquet(self.store.path(folder))
        if not self.keys:
            return [{"folder": folder}]
        found = (n for n in self.store.names(folder) if n.startswith(f"{BUCKET}="))
        return [{"folder": f"{folder}/{n}", "bucket": int(n.partition("=")[2])} for n in found]

    def _log(self, entry: dict, operation: str, parts: list[dict], now: Callable[[], datetime], batch: tuple[str, int] | None = None, **more) -> int:
        """The version after ``entry``; raises ``Exists`` if another writer was first."""
        at = entry.get("version", 0) + 1
        applied = entry.get("applied", {}) | ({batch[0]: batch[1]} if batch else {})
        told = {"version": at, "operation": operation, "committed_at": now().isoformat(), "parts": parts, "applied": applied, "schema": entry.get("schema", self._schema)}
        try:
            self.store.create(f"{self.key}/log/{at:012d}.json", json.dumps(told | more).encode())
        except Exists:
            for folder in {p["folder"].removesuffix(f"/{BUCKET}={p.get('bucket')}") for p in parts if p not in entry.get("parts", ())}:
                self.store.delete(folder)
            raise
        return at

    def commit(self, frame: DataFrame, operation: str, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc), batch: tuple[str, int] | None = None) -> int:
        """``frame`` as the whole next version. Two writers cannot both log one version."""
        entry = self.entry()
        return self._log(entry, operation, self._write(frame), now, batch)

    def append(self, frame: DataFrame, operation: str = "append", now: Callable[[], datetime] = lambda: datetime.now(timezone.utc)) -> int:
        entry = self.entry()
        parts = list(entry.get("parts", ()))
        if len(parts) >= max(MOST_FOLDERS, 4 * self.buckets * bool(self.keys)):
            return self.commit(self._load(parts, self.schema).unionByName(frame.select(*self.columns)), operation, now)
        return self._log(entry, operation, parts + self._write(frame), now)

    def applied(self, stream: str) -> int:
        """The last batch of a stream that a version came of; -1 before the first. Batches of a stream come in order."""
        return self.entry().get("applied", {}).get(stream, -1)

    def touched(self, rows: DataFrame) -> list[int] | None:
        """The buckets that ``rows`` have keys in; None for a table without."""
        return [r[0] for r in rows.select(self._bucket().alias("b")).distinct().collect()] if self.keys else None  # a row a bucket

    def around(self, buckets: list[int] | None) -> DataFrame:
        """The rows of some buckets."""
        entry = self.entry()
        parts = [p for p in entry.get("parts", ()) if buckets is None or p["bucket"] in buckets]
        return self._load(parts, entry.get("schema", self._schema))

    def rewrite(self, frame: DataFrame, buckets: list[int] | None, operation: str, now: Callable[[], datetime] = lambda: datetime.now(timezone.utc), batch: tuple[str, int] | None = None) -> int:
        """The next version, with ``frame`` in place of some buckets."""
        entry = self.entry()
        kept = [] if buckets is None else [p for p in entry.get("parts", ()) if p["bucket"] not in buckets]
        return self._log(entry, operation, kept + self._write(frame), now, batch)

    def versions(self) -> DataFrame:
        """version, operation, committed_at of all commits, latest first."""
        schema = "version bigint, operation string, committed_at timestamp"
        if not self.version():
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).json(self.store.path(f"{self.key}/log")).orderBy(F.desc("version"))

    def merge(self, winners: DataFrame, keys: Sequence[str], is_newer: Column) -> dict[str, int]:
        """Upserts what is new or newer; commits nothing if nothing is."""
        winners = winners.persist()
        try:
            buckets = self.touched(winners)
            target = self.around(buckets)
            found = silver.classify(winners, target, keys, is_newer).groupBy("outcome").count().collect()  # three rows at most
            counts = {"insert": 0, "update": 0, "unchanged": 0} | {r["outcome"]: r["count"] for r in found}
            if counts["insert"] or counts["update"]:
                self.rewrite(silver.upsert(target, winners, keys, is_newer), buckets, "merge")
        finally:
            winners.unpersist()
        return counts

    def put(self, rows: DataFrame, batch: tuple[str, int] | None = None, operation: str = "merge") -> int:
        """Rows in place of those with their keys, in the buckets they touch."""
        buckets = self.touched(rows)
        keys = list(self.keys)
        rest = self.around(buckets).join(rows.select(*keys), keys, "left_anti")
        return self.rewrite(rest.unionByName(rows.select(*self.columns)), buckets, operation, batch=batch)

    def insert_once(self, rows: DataFrame, key: str) -> int:
        """Appends the rows whose key is new; commits nothing if none is, and rewrites nothing."""
        fresh = rows.dropDuplicates([key]).join(self.read().select(key), key, "left_anti").persist()
        try:
            count = fresh.count()
            if count:
                self.append(fresh)
        finally:
            fresh.unpersist()
        return count

    def add_column(self, definition: str) -> None:
        """A nullable column more, from the next version on; rows written before read it as null. A known column is left as it is."""
        if definition.split()[0] not in self.columns:
            entry, now = self.entry(), lambda: datetime.now(timezone.utc)
            self._log(entry, "add_column", list(entry.get("parts", ())), now, schema=f"{self.schema}, {definition}")
