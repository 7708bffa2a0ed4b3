"""SimHash near-duplicates by pigeonhole blocks.

Two fingerprints that differ in at most four bits leave at least three of seven
blocks untouched. Every distinct fingerprint is therefore filed under each of the
35 choices of three blocks (27 or 28 bits and the choice), equal keys meet, and the
Hamming distance is verified. 28 bits keep chance meetings rare at any size this
fits; copies have one fingerprint and meet once, before any key is made.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.graph import components
from tidemark.llm.util import LOWER_BYTES, streamed, trimmed, word_pieces, written

SHINGLE = 4
SEED = 42
MAX_BITS = 4
BLOCKS = ((0, 9), (9, 9), (18, 9), (27, 9), (36, 9), (45, 9), (54, 10))
CHOICES = tuple(combinations(range(len(BLOCKS)), len(BLOCKS) - MAX_BITS))
#: Runs up to this length are compared by shifts of the whole column, longer ones block by block.
SHORT = 48
TILE = 1024
#: Beyond this length a run is split again by pigeonhole before any comparison.
LONG = 16384
#: Runs above this length leave their task and meet again by finer keys: (blocks, blocks shared).
HOT = 1 << 16
FINER = ((5, 1), (6, 2), (8, 4))


def _digests(words: list[bytes]) -> np.ndarray:
    """Hashes of all shingles of at least SHINGLE words."""
    line = b" ".join(words)
    ends = [*accumulate(map((1).__add__, map(len, words)))]
    hashed = xxhash.xxh64_intdigest
    return np.array([hashed(line[a : b - 1], SEED) for a, b in zip([0, *ends], ends[SHINGLE - 1 :])], "<u8")


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text; 0 when it has no word."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    for words in word_pieces(text.encode().translate(LOWER_BYTES) if text else b""):
        held += words
        if len(held) >= SHINGLE:
            digests = _digests(held)
            for k in range(0, len(digests), 8192):
                part = digests[k : k + 8192].view(np.uint8)
                ones += np.unpackbits(part, bitorder="little").reshape(-1, 64).sum(0, dtype=np.int64)
            n, held = n + len(digests), held[1 - SHINGLE :]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and ``fp``, the fingerprint's bits as a signed long."""
    schema = docs.select(*keep).withColumn("fp", F.lit(0).cast("long")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in trimmed(batches):
            of = np.array([fingerprint(t.as_py()) for t in batch.column(len(keep))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(of)], [*keep, "fp"])

    return streamed(docs.select(*keep, F.col(text).alias("_text"))).mapInArrow(run, schema)


def _tiles(values: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (from ``at``) of the close pairs of ``values``, compared tile by tile."""
    for i in range(0, len(values), TILE):
        for j in range(i, len(values), TILE):
            near = np.bitwise_count(values[i : i + TILE, None] ^ values[None, j : j + TILE]) <= MAX_BITS
            a, b = np.nonzero(np.triu(near, 1) if i == j else near)
            yield at[a + i], at[b + j]


def _close(values: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """As ``_tiles``; a long run is first split by five blocks, of which a close pair shares one."""
    if len(values) <= LONG:
        yield from _tiles(values, at)
        return
    for low in range(0, 64, 13):
        block = (values >> np.uint64(low)) & np.uint64(0x1FFF)
        order = np.argsort(block, kind="stable")
        for part in np.split(order, np.nonzero(np.diff(block[order]))[0] + 1):
            if len(part) > 1:
                yield from _tiles(values[part], at[part])


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' components."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (deeper := root[root])[...].tobytes() != root.tobytes():
            root = deeper
        if (root[a] == root[b]).all():
            return root


def _joined(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``root`` after the links (a, b) as well."""
    a, b = root[a], root[b]
    new = a != b
    if not new.any():
        return root
    inside, ends = np.unique(np.r_[a[new], b[new]], return_inverse=True)
    to = np.arange(len(root))
    to[inside] = inside[_forest(len(inside), *np.split(ends, 2))]
    return to[root]


def _linked(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For whole runs of equal keys: as few links as connect all that are close, not all pairs."""
    cut = np.nonzero(np.diff(keys))[0] + 1
    first, last = np.r_[0, cut], np.r_[cut, len(keys)]
    length = last - first
    root = np.arange(len(keys))
    for k in np.nonzero(length > SHORT)[0]:
        own, at = np.arange(length[k]), np.arange(length[k])
        for a, b in _close(values[first[k] : last[k]], at):
            own = _joined(own, a, b)
        root[first[k] : last[k]] = own + first[k]
    left = np.repeat(np.where(length > SHORT, 0, last), length) - np.arange(len(keys))
    for step in range(1, SHORT):
        at = np.nonzero(left > step)[0]
        if not len(at):
            break
        near = at[np.bitwise_count(values[at] ^ values[at + step]) <= MAX_BITS]
        root = _joined(root, near, near + step)
    moved = root != np.arange(len(keys))
    return values[moved], values[root[moved]]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, fp) sorted by key to links (a, b); the fingerprints of a run above HOT go on as (null, fp, key), to be met by finer keys.

    A run that a batch ends in is carried into the next, HOT rows at most.
    """
    names = ["a", "b", "key"]

    def out(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64())], names)

    def passed(key: int, values: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(values), pa.int64()), pa.array(values.view(np.int64)), pa.array(np.full(len(values), key))], names)

    here, held, count, hot = None, [], 0, False

    def end() -> Iterator[pa.RecordBatch]:
        if held and not hot:
            values = np.concatenate(held)
            yield out(*_linked(np.zeros(len(values), np.int64), values))

    for batch in batches:
        keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        if not len(keys):
            continue
        cut = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)]
        # Runs that lie within the batch are linked together; its last may go on.
        first = 0
        if keys[0] == here:
            held, count, first = [*held, values[: cut[1]]], count + int(cut[1]), 1
            if count > HOT or hot:
                yield passed(here, np.concatenate(held))
                held, hot = [], True
        if first < len(cut) - 1:
            yield from end()
            long = np.flatnonzero(np.diff(cut[first:-1]) > HOT) + first
            for k in long:
                yield passed(keys[cut[k]], values[cut[k] : cut[k + 1]])
            whole = np.ones(len(keys), bool)
            whole[: cut[first]] = whole[cut[-2] :] = False
            for k in long:
                whole[cut[k] : cut[k + 1]] = False
            if whole.any():
                yield out(*_linked(keys[whole], values[whole]))
            here, held, count, hot = keys[-1], [values[cut[-2] :]], int(cut[-1] - cut[-2]), False
            if count > HOT:
                yield passed(here, np.concatenate(held))
                held, hot = [], True
    yield from end()


def _met(filed: DataFrame) -> DataFrame:
    met = filed.repartition("key").sortWithinPartitions("key")
    return written(streamed(met).mapInArrow(_runs, "a long, b long, key long"), "met")


def links(distinct: DataFrame) -> DataFrame:
    """Links (a, b) that connect exactly the fingerprints connected by steps of up to four bits.

    Fingerprints of a key that more than HOT share meet again by that key with each of five
    blocks of all bits, one of which a close pair shares; where those are still too many, with
    two of six, then with four of eight. What is left then is compared whole, in tiles.
    """
    keys = []
    for number, choice in enumerate(CHOICES):
        key = F.lit(number).cast("long")
        for block in choice:
            at, wide = BLOCKS[block]
            key = F.shiftleft(key, wide).bitwiseOR(
                F.shiftrightunsigned("fp", at).bitwiseAND(F.lit((1 << wide) - 1).cast("long"))
            )
        keys.append(key)
    met = _met(distinct.select(F.explode(F.array(*keys)).alias("key"), "fp"))
    found = met.where("key IS NULL").select("a", "b")
    for parts, shared in FINER:
        hot = met.where("key IS NOT NULL").select("key", F.col("b").alias("fp"))
        if hot.isEmpty():
            break
        edges = [64 * k // parts for k in range(parts + 1)]
        cut = [F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long")) for a, b in zip(edges, edges[1:])]
        finer = [F.xxhash64("key", F.lit(n), *(cut[k] for k in choice)) for n, choice in enumerate(combinations(range(parts), shared))]
        met = _met(hot.select(F.explode(F.array(*finer)).alias("key"), "fp"))
        found = found.unionByName(met.where("key IS NULL").select("a", "b"))
    last = met.where("key IS NOT NULL").select("key", F.col("b").alias("fp"))
    if not last.isEmpty():
        tiles = last.repartition("key").sortWithinPartitions("key")
        found = found.unionByName(streamed(tiles).mapInArrow(_whole_runs, "a long, b long"))
    return found


def _whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """As ``_runs``, each run held whole."""
    here, held = None, []

    def end() -> Iterator[pa.RecordBatch]:
        if held:
            values = np.concatenate(held)
            a, b = _linked(np.zeros(len(values), np.int64), values)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    for batch in batches:
        keys, values = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
        cut = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)] if len(keys) else [0]
        for x, y in zip(cut[:-1], cut[1:]):
            if keys[x] != here:
                yield from end()
                here, held = keys[x], []
            held.append(values[x:y])
    yield from end()


def _classes(marked: DataFrame) -> DataFrame:
    """``fp``, ``component_id`` and ``first``, the least (doc_id, rid) of its component, once for each fingerprint."""
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    distinct = written(marked.groupBy("fp").agg(F.min(name).alias("least")), "distinct")
    names = components(links(distinct.select("fp")))
    named = distinct.join(names.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )
    roots = named.groupBy("root").agg(F.min("least").alias("first"))
    return named.join(roots, "root").select("fp", "first", F.col("first.doc_id").alias("component_id"))


def groups(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id`` (the key), ``fp`` and ``component_id`` (smallest key reachable) of every row.

    Null and wordless texts have fingerprint 0 and link like any other. A null key
    keeps its row; its component is the smallest non-null key of the group, or null.
    Repeated rows stay repeated. An empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.monotonically_increasing_id().alias("rid"))
    marked = written(fingerprints(rows, keep=("doc_id", "rid")), "fingerprints")
    # A row of _classes for each fingerprint: the join repeats no row, and a
    # fingerprint with many copies is split by the adaptive skew join.
    return marked.join(_classes(marked), "fp").select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row of each group with all its columns, whatever their names: that of the smallest key.

    Null keys come last; of rows that share a key the first by position stays.
    """
    rows = docs.select(
        F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"),
        docs[key].alias("doc_id"), docs[text].alias("text"), F.monotonically_increasing_id().alias("rid"),
    )
    rows = written(rows, "documents")
    marked = written(fingerprints(rows, keep=("doc_id", "rid")), "fingerprints")
    stay = _classes(marked).select(F.col("first.rid").alias("rid")).distinct()
    return rows.join(stay, "rid", "left_semi").select("row.*")


def op2(docs: DataFrame) -> DataFrame:
    return groups(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
