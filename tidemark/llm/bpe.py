"""Byte-level BPE as a monoid: encode halves, join neighbours at their boundary.

A text is the concatenation of the pattern's matches, each encoded by itself. A
match that is no token is split in halves down to leaves of LEAF bytes; the leaves
are merged by rank, and two encoded neighbours are joined by re-encoding a window
around their boundary.

When may the window stop growing? Write ``ok(x, y)`` if the merges alone turn the
bytes of tokens x and y into exactly x, y. A token sequence is the encoding of its
bytes if and only if every adjacent pair is ok: up to the first merge that would
cross a token's end, the merges inside a pair run as they would with the pair
alone, so such a merge would also happen there. Inside the window the encoding is
right by construction, outside it both sides were right before; if the pairs at
the window's two edges are ok too, no token outside can ever change.

Decoding goes up the same kind of tree: halves are decoded and concatenated, which
is associative as it stands.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import mapped, streamed, trimmed

#: Bytes of a leaf: many ordinary words are longer.
LEAF = 8
#: Windows of more bytes are merged by a heap.
WIDE = 128
#: Ids of a leaf when decoding.
RUN = 512
#: Encoded matches remembered by a worker; the memory is emptied when full.
REMEMBERED = 400_000
#: Matches encoded before their ids are digested, which bounds what a very long text holds at once.
SLICE = 200_000
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


class Codec(dict):
    """Ranks with their pattern; as a dict, the memory of encoded matches (str to tuple of ids)."""

    def __init__(self, data: bytes, pattern: str):
        super().__init__()
        self.ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in data.splitlines() if x.strip())}
        self.bytes_of = {v: k for k, v in self.ranks.items()}
        self.pattern = regex.compile(pattern)
        self.stable: dict[tuple[int, int], bool] = {}
        self.leaves: dict[bytes, list[int]] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The merges alone: always the adjacent pair of least rank, the leftmost of equals."""
        if len(piece) > WIDE:
            return self.merge_long(piece)
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2], 1 << 60) for i in range(len(piece) - 1)]
        while pairs and (least := min(pairs)) < 1 << 60:
            i = pairs.index(least)
            parts[i] += parts.pop(i + 1)
            pairs.pop(i)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], 1 << 60)
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], 1 << 60)
        return [ranks[x] for x in parts]

    def merge_long(self, piece: bytes) -> list[int]:
        """As ``merge``, by a heap of pairs over linked parts: for wide windows."""
        ranks, n = self.ranks, len(piece)
        end, before, after = [*range(1, n + 1)], [*range(-1, n - 1)], [*range(1, n + 1)]
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            _, i, to = heappop(heap)
            j = end[i]
            if j is None or after[i] >= n or end[after[i]] != to:
                continue  # one of the two has been merged since
            j = after[i]
            end[i], end[j], after[i] = to, None, after[j]
            if after[i] < n:
                before[after[i]] = i
                if (r := ranks.get(piece[i : end[after[i]]])) is not None:
                    heappush(heap, (r, i, end[after[i]]))
            if (k := before[i]) >= 0 and (r := ranks.get(piece[k:to])) is not None:
                heappush(heap, (r, k, to))
        return [ranks[piece[i : end[i]]] for i in range(n) if end[i] is not None]

    def ok(self, x: int, y: int) -> bool:
        found = self.stable.get((x, y))
        if found is None:
            if len(self.stable) > REMEMBERED:
                self.stable.clear()
            found = self.stable[x, y] = self.merge(self.bytes_of[x] + self.bytes_of[y]) == [x, y]
        return found

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both, given the encoding of each."""
        if not left or not right or self.ok(left[-1], right[0]):
            return left + right
        i, j, step = len(left), 0, 1
        while True:
            i, j, step = max(0, i - step), min(len(right), j + step), 2 * step
            window = self.merge(b"".join(map(self.bytes_of.__getitem__, left[i:] + right[:j])))
            before = i == 0 or self.ok(left[i - 1], window[0])
            after = j == len(right) or self.ok(window[-1], right[j])
            if before and after:
                return left[:i] + window + right[j:]

    def leaf(self, piece: bytes) -> list[int]:
        found = self.leaves.get(piece)
        if found is None:
            if len(self.leaves) > REMEMBERED:
                self.leaves.clear()
            found = self.leaves[piece] = self.merge(piece)
        return found

    def tree(self, piece: bytes) -> list[int]:
        if len(piece) <= LEAF:
            return self.leaf(piece)
        half = LEAF << ((len(piece) - 1) // LEAF).bit_length() - 1  # repeats of 2, 4, ... bytes then meet in step
        return self.join(self.tree(piece[:half]), self.tree(piece[half:]))

    def __missing__(self, match: str) -> tuple[int, ...]:
        piece = match.encode()
        whole = self.ranks.get(piece)
        ids = (whole,) if whole is not None else tuple(self.tree(piece))
        if len(match) <= 2 * WIDE:
            if len(self) >= REMEMBERED:
                self.clear()
            self[match] = ids
        return ids

    def slices(self, text: str | None) -> Iterator[list[int]]:
        """The text's ids, some matches at a time."""
        matches: list[str] = []
        if text and len(text) <= SLICE:
            yield [*chain.from_iterable(map(self.__getitem__, self.pattern.findall(text)))]
            return
        for m in self.pattern.finditer(text or ""):
            matches.append(m[0])
            if len(matches) >= SLICE:
                yield [*chain.from_iterable(map(self.__getitem__, matches))]
                matches.clear()
        yield [*chain.from_iterable(map(self.__getitem__, matches))]

    def encode(self, text: str | None) -> list[int]:
        return [*chain.from_iterable(self.slices(text))]

    def decode(self, ids: Sequence[int]) -> bytes:
        """The bytes of the ids: of each half, one after the other; leaves of RUN ids are looked up."""
        if len(ids) <= RUN:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = RUN << ((len(ids) - 1) // RUN).bit_length() - 1
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def digest(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids in decimal, SHA-256 of the bytes they decode to."""
        n, listed, decoded = 0, hashlib.sha256(), hashlib.sha256()
        for ids in self.slices(text):
            if ids:
                listed.update((("," if n else "") + ",".join(map(str, ids))).encode())
                decoded.update(self.decode(ids))
                n += len(ids)
        return n, listed.hexdigest(), decoded.hexdigest()


@lru_cache(2)
def codec(data: bytes, pattern: str) -> Codec:
    return Codec(data, pattern)


def vocabulary(path: str | None = None) -> tuple[bytes, str]:
    """The rank file's bytes and the pattern, read once by the driver; the size is the vocabulary's, never the data's."""
    import public_tokenizers

    with open(path or public_tokenizers.path(VOCABULARY), "rb") as file:
        return file.read(), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, text: str = "text") -> DataFrame:
    """All columns of ``docs``, then ``token_ids`` (array of int; empty for null and empty texts).

    An existing column ``token_ids`` is replaced. Ids decode to the text's UTF-8 bytes.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    rest = [c for c in docs.columns if c != "token_ids"]
    frame = docs.select(*(docs[f"`{c}`"] for c in rest))
    schema = frame.withColumn("token_ids", F.array().cast("array<int>")).schema
    at = rest.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*held.value)
        for batch in trimmed(batches):
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                ids = pa.array([own.encode(x.as_py()) for x in part.column(at)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, ids], [*rest, "token_ids"])

    return mapped(frame, run, schema)


def decode(docs: DataFrame, path: str | None = None, ids: str = "token_ids") -> DataFrame:
    """``docs`` with ``decoded``, the bytes of ``ids``; null ids give empty bytes.

    What ``encode`` returned is decoded in the same pass, by the same worker.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    rest = [c for c in docs.columns if c != "decoded"]
    frame = docs.select(*(docs[f"`{c}`"] for c in rest)) if len(rest) < len(docs.columns) else docs
    schema = frame.withColumn("decoded", F.lit(b"")).schema
    at = rest.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*held.value)
        for batch in batches:
            texts = pa.array([own.decode(x.as_py() or ()) for x in batch.column(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], [*rest, "decoded"])

    return mapped(frame, run, schema)


def digests(docs: DataFrame, path: str | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``doc_id``, ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` of every row.

    The ids are encoded and decoded again in one pass, so they need not be kept. Null
    and empty texts have no id; repeated rows stay repeated; a null key is kept.
    """
    held = docs.sparkSession.sparkContext.broadcast(vocabulary(path))
    frame = docs.select(docs[key].alias("doc_id"), docs[text].alias("text"))
    schema = frame.select(
        "doc_id", F.lit(0).cast("long").alias("n_tokens"), F.lit("").alias("ids_sha256"), F.lit("").alias("decoded_sha256")
    ).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*held.value)
        for batch in batches:
            found = [own.digest(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return streamed(frame).mapInArrow(run, schema)


def op3(docs: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; see ``digests`` for odd rows."""
    return digests(docs)
