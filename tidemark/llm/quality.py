"""Quality by the votes of nearest labelled neighbours.

A text's terms are the shapes of its words (runs of capitals, small letters and digits,
with their punctuation and a length class; a word of more than ``WORD`` characters counts
piece by piece), pairs of neighbouring shapes, and words that repeat the one before. Term
shares are weighted by rarity and projected on the leading singular vectors of the labelled
sample (latent-semantic analysis). The labelled vectors are broadcast; every text's cosines
with all of them are exact matrix products, block by block, and the most similar ones vote
with their similarity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import discard, remainder, streamed, trimmed, word_pieces, written

TERMS = 2048
DIMENSIONS = 48
NEIGHBOURS = 25
#: The bound of the labelled sample, in rows.
LABELLED = 2000
KEEP = 0.3
#: Similarities count with this power, so near neighbours outweigh far ones.
SHARPNESS = 4
#: Similarities this close are equal: rounding differs between blocks.
TIE = 1e-12
BLOCK = 256
REMEMBERED = 300_000
RUNS = ((regex.compile(r"\p{Lu}+"), "A"), (regex.compile(r"[\p{L}\p{M}]+"), "a"), (regex.compile(r"\p{N}+"), "0"), (regex.compile(r"(.)\1+"), r"\1"))
SHAPES = 512
REPEATED = 0
#: Longer words count as consecutive words of this length, so that every character counts.
WORD = 64


class Shapes(dict):
    """Words of at most WORD characters to shape numbers (1 to SHAPES - 1), remembered."""

    def __missing__(self, word: str) -> int:
        if len(self) > REMEMBERED:
            self.clear()
        shape = word.replace("A", "Z").replace("a", "z")
        for runs, mark in RUNS:
            shape = runs.sub(mark, shape)
        shape += str(min(len(word), 24).bit_length())
        self[word] = number = 1 + xxhash.xxh32_intdigest(shape.encode()) % (SHAPES - 1)
        return number


def terms(text: str | None, shapes: Shapes) -> np.ndarray:
    """Square roots of the term shares of a text: single shapes, then hashed pairs."""
    counts, n, last, before = np.zeros(TERMS), 0, None, None
    for words in word_pieces(text or ""):
        if not words:
            continue
        parts = words if max(map(len, words)) <= WORD else (w[k : k + WORD] for w in words for k in range(0, len(w), WORD))
        ids = np.fromiter(map(shapes.__getitem__, parts), np.int64)
        m = len(ids)
        counts[:SHAPES] += np.bincount(ids, minlength=SHAPES)
        counts[REPEATED] += sum(map(eq, words, words[1:])) + (words[0] == last)
        if before is not None:
            ids = np.r_[before, ids]
        counts += np.bincount(SHAPES + (ids[:-1] * 31 + ids[1:] * 17) % (TERMS - SHAPES), minlength=TERMS)
        n, last, before = n + m, words[-1], ids[-1]
    counts[:SHAPES] /= max(n, 1)
    counts[SHAPES:] /= max(n - 1, 1)
    return np.sqrt(counts)


@dataclass
class Voters:
    """weights: of terms; axes: terms to latent dimensions; vectors: of the labelled, of length 1; labels; prior: their mean."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    def place(self, rows: np.ndarray) -> np.ndarray:
        at = (rows * self.weights) @ self.axes
        length = np.linalg.norm(at, axis=1, keepdims=True)
        return np.divide(at, length, out=np.zeros_like(at), where=length > 1e-12)

    def score(self, rows: np.ndarray) -> np.ndarray:
        """The weighted vote for label 1, from 0 to 1; the prior where nothing is similar.

        All neighbours as similar as the last of the nearest vote with them, so ties need no order.
        """
        near = self.place(rows) @ self.vectors.T
        k = min(NEIGHBOURS, len(self.labels))
        least = np.partition(near, -k, axis=1)[:, -k, None]
        weight = np.where(near >= least - TIE, np.maximum(near, 0), 0) ** SHARPNESS
        total, votes = weight.sum(1), weight @ self.labels
        return np.clip(np.where(total > 0, votes / np.where(total > 0, total, 1), self.prior), 0, 1)


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED) -> Voters | None:
    """From at most ``labelled`` rows of ``labels`` (doc_id, quality), the first by hash of the key; one text a key, the least of its rows."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    taken = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most ``labelled`` keys
    taken = taken.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").alias("quality"))  # each once, so rows are bounded, too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shapes = Shapes()
        for batch in batches:
            rows = [terms(t.as_py(), shapes) for t in batch.column(0)]
            at = [np.nonzero(r)[0] for r in rows]
            columns = [batch.column(1), pa.array([x.astype(np.int32) for x in at], pa.list_(pa.int32())), pa.array([r[x] for r, x in zip(rows, at)], pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["quality", "term", "share"])

    found = streamed(taken.select("text", F.col("quality").cast("int").alias("quality"))).mapInArrow(run, "quality int, term array<int>, share array<double>")
    stored = written(found, "labelled")
    found = stored.orderBy("quality", "term", "share").toPandas()
    discard(stored)
    if found.empty:
        return None
    rows = np.zeros((len(found), TERMS))
    for k, (at, share) in enumerate(zip(found["term"], found["share"])):
        rows[k, at] = share
    held = found["quality"].to_numpy().astype(float)
    weights = np.log((1 + len(rows)) / (1 + (rows > 0).sum(0))) + 1
    weighed = rows * weights
    # Leading right singular vectors, from the smaller of the two Gram matrices.
    values, left = np.linalg.eigh(weighed @ weighed.T)
    best = np.argsort(-values)[:DIMENSIONS]
    best = best[values[best] > 1e-9]
    axes = weighed.T @ left[:, best] / np.sqrt(values[best])
    voters = Voters(weights, axes, np.zeros((0, axes.shape[1])), held, float(held.mean()))
    voters.vectors = voters.place(rows)
    return voters


def score(docs: DataFrame, voters: Voters | None, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """The kept columns and ``score`` of each row, which only the text decides.

    Null texts and texts without a word score the sample's mean label; with nothing
    labelled every score is 0.5. Repeated rows stay repeated; a null key stays.
    """
    held = docs.sparkSession.sparkContext.broadcast(voters)  # bounded by LABELLED, TERMS and DIMENSIONS
    schema = docs.select(*keep).withColumn("score", F.lit(0.0)).schema
    names = [f.name for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, shapes = held.value, Shapes()
        for batch in trimmed(batches):
            texts = batch.column(len(names) - 1)
            of = np.full(batch.num_rows, 0.5)
            for k in range(0, batch.num_rows if own else 0, BLOCK):
                of[k : k + BLOCK] = own.score(np.stack([terms(t.as_py(), shapes) for t in texts[k : k + BLOCK]]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names) - 1], pa.array(of)], names)

    return streamed(docs.select(*keep, F.col(text).alias("_text"))).mapInArrow(run, schema)


def keep_good(docs: DataFrame, labels: DataFrame, least: float = KEEP) -> DataFrame:
    """The rows of ``docs`` that score at least ``least``, with their own columns, whatever their names.

    Null and wordless texts score the sample's mean label and stay or go by it; repeated rows
    do so alike; without labels all rows stay. An empty table gives an empty result.
    """
    rows = docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), docs["text"].alias("text"))
    scored = score(rows, fit(docs.select("doc_id", "text"), labels), keep=("row",))
    return scored.where(F.col("score") >= least).select("row.*")


def op8(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted: learns from labels whose key's remainder by 5 is not 0, scores every row; see ``score`` for odd rows."""
    held_out = F.coalesce(remainder(F.col("doc_id"), 5) == 0, F.lit(False))
    voters = fit(docs, labels.where(~held_out))
    return score(docs, voters).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= KEEP).cast("int").alias("predicted")
    )
