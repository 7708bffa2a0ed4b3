"""Tables handed from one layer to another, with a manifest that the receiver checks."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.batch import canonical
from tidemark.sources.landing import checksum
from tidemark.sources.store import Store


class BridgeError(ValueError):
    pass


def export(store: Store, folder: str, phase: str, tables: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> str:
    """Writes each (frame, key) and the manifest last; an export is never overwritten. What is counted is what was written."""
    entries = {}
    for name, (frame, key) in sorted(tables.items()):
        at = f"{folder}/{phase}/{name}"
        frame.write.mode("errorifexists").parquet(store.path(at))
        entries[name] = {"path": at, "key": list(key)} | _account(store, at, key)
    manifest = f"{folder}/{phase}/_MANIFEST.json"
    store.create(manifest, canonical({"phase": phase, "tables": entries}))
    return manifest


def _account(store: Store, at: str, key: Sequence[str]) -> dict[str, int | str]:
    """Rows, keys and checksum of a stored table, in one aggregate."""
    frame = store.spark.read.parquet(store.path(at))
    found = frame.agg(F.count(F.lit(1)), F.count_distinct(F.struct(*key)), checksum(frame.columns)).first()
    return {"row_count": found[0], "key_count": found[1], "checksum": f"sha256:{found[2]}"}


def load(store: Store, manifest_key: str, phase: str, expected: Sequence[str]) -> dict[str, DataFrame]:
    """The tables of a manifest that is of ``phase``, names exactly ``expected`` and tells the truth."""
    manifest = json.loads(store.read(manifest_key))
    if manifest.get("phase") != phase:
        raise BridgeError("unexpected_phase")
    if set(manifest["tables"]) != set(expected):
        raise BridgeError("unexpected_tables")
    frames = {}
    for name, entry in manifest["tables"].items():
        if not entry["path"].startswith(manifest_key.rsplit("/", 1)[0] + "/") or ".." in entry["path"]:
            raise BridgeError(f"path_escapes_export:{name}")
        found = _account(store, entry["path"], entry["key"])
        if found["checksum"] != entry["checksum"]:
            raise BridgeError(f"checksum_mismatch:{name}")
        if any(found[k] != entry[k] for k in ("row_count", "key_count")):
            raise BridgeError(f"count_mismatch:{name}")
        frames[name] = store.spark.read.parquet(store.path(entry["path"]))
    return frames
