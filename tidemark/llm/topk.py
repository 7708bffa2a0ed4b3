"""Exact top-k inner products from an impact-ordered index, score at a time.

Vectors are quantised to integers. A block of rows is indexed as posting lists, one a
component: its rows by falling impact (size of the component), those of equal impact a
segment. A query meets segments in the order of what they add to a score, its own weight
times their impact, the largest first: each round takes all segments above a level, adds
their products to the rows' accumulators and counts what each row has met.

What a row has not met yet is less than the level, times the components left, in either
direction. Rows whose most is below the threshold are out: the k-th of the rows' least, or of
the exact scores of those that lead after the first round. A query stops when few rows are
left, and no earlier; these possible members are scored again over all components, in exact
integers. The k-th score in a query's own block goes with it to all others, so most rows there
are out at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field


import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import streamed, written
from tidemark.llm.vectors import best, meetings, taking_part

SCALE = 64
K = 20
#: Rows and components of a block (about), share of its rows that is few.
BLOCK, CELLS, FEW = 16384, 1 << 20, 0.2
#: Rows whose scores are made exact after the first round, for a threshold: so many times k.
TRIED = 8
#: Rounds end where this share of a query's postings is met.
ROUNDS = (0.35, 0.45, 0.55, 0.65, 0.75, 0.85)
#: Points by which the levels are found.
POINTS = 64
#: Sums below this are exact in floating point.
EXACT = float(1 << 53)
LONG = (-(1 << 63), (1 << 63) - 1)


def quantised(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), as floats: whole numbers, exact but for the overflow of huge components, which are cut to 1e300."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * vectors), -1e300, 1e300)


def whole(vector: np.ndarray) -> list[int]:
    """The same as integers of any size."""
    return [SCALE * int(x) if abs(x) >= EXACT else int(np.floor(SCALE * x)) for x in vector.tolist()]


@dataclass
class Met:
    """How queries ended: closed in a round by proof, or with all postings met; possible members scored again."""

    closed: list[int] = field(default_factory=lambda: [0] * len(ROUNDS))
    to_the_end: int = 0
    members: int = 0


class Block:
    """ids; vectors; for each component the rows by falling impact, with their values there."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors, self.rows = ids, vectors, quantised(vectors)
        self.n, self.d = self.rows.shape
        order = np.argsort(-np.abs(self.rows), axis=0, kind="stable")
        self.places = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(self.rows, order, 0).T)
        self.impacts = np.abs(self.values)
        self.rising = np.ascontiguousarray(self.impacts[:, ::-1])
        self.points = self.impacts[:, np.linspace(0, self.n - 1, min(POINTS, self.n)).astype(int)]
        self.most = self.impacts[:, 0].max()
        # Rows and products of a round, one after the other; used again by every query.
        self.at, self.adds = np.empty(self.rows.size, np.int64), np.empty(self.rows.size)
        by_id = np.argsort(ids, kind="stable")
        firsts = np.flatnonzero(np.r_[True, np.diff(ids[by_id]) != 0])
        self.by_id, self.firsts = (by_id, firsts) if len(firsts) < len(ids) else (None, None)
        self.keys = len(firsts)

    def edge(self, low: np.ndarray, k: int) -> float:
        """The k-th of the rows' ``low``, a key once."""
        if self.by_id is not None:
            low = np.maximum.reduceat(low[self.by_id], self.firsts)
        return np.partition(low, -k)[-k] if k <= len(low) else -np.inf

    def members(self, name: int, asked: np.ndarray, k: int, least: float, met: Met) -> np.ndarray:
        """Rows that may be among the first ``k`` and reach ``least``."""
        own = self.ids == name
        weight = np.abs(asked)
        active = np.flatnonzero(weight)
        spread = weight.max(initial=0) * self.most * max(self.d, 1)
        if spread > 1e290:  # beyond what bounds in floating point can say
            return np.flatnonzero(~own)
        slack = 1e-9 * (spread + 1)  # rounding may not exclude a member
        # Adding this to each product counts the postings of a row in the same sum.
        unit = float(1 << max(1, int(2 * spread + 1).bit_length()))
        both = np.zeros(self.n)
        if unit * (self.d + 1) >= EXACT:
            return np.flatnonzero(~own)
        few = max(4 * k, int(FEW * self.n))
        done = np.zeros(self.d, np.int64)
        total = np.where(own, -np.inf, 0.0)
        steps = np.sort((weight[active, None] * self.points[active]).ravel())[::-1]
        for number, share in enumerate((*ROUNDS, 1.0) if len(active) else ()):
            last = share == 1
            level = 0.0 if last else steps[min(int(share * len(steps)), len(steps) - 1)]
            upto = done.copy()
            for c in active:
                # Segments are taken whole: all rows of an impact that adds ``level`` or more.
                upto[c] = self.n if last else max(done[c], self.impacts[c].size - int(np.searchsorted(self.rising[c], level / weight[c], "left")))
            n = int((upto - done).sum())
            at, adds, k0 = self.at[:n], self.adds[:n], 0
            for c in active:
                a, b = done[c], upto[c]
                at[k0 : k0 + b - a] = self.places[c, a:b]
                np.multiply(self.values[c, a:b], asked[c], out=adds[k0 : k0 + b - a])
                k0 += b - a
            done = upto
            adds += unit
            both += np.bincount(at, adds, self.n)
            seen = np.rint(both / unit)
            total = both - seen * unit
            total[own] = -np.inf
            left = (len(active) - seen) * level + slack
            if not number:
                # Whatever the bounds say, the k-th of some exact scores is a threshold.
                some = np.argpartition(total, -min(TRIED * k, self.n))[-min(TRIED * k, self.n) :]
                tried = np.full(self.n, -np.inf)
                tried[some] = np.where(own[some], -np.inf, self.rows[some] @ asked - slack)
                least = max(least, self.edge(tried, k))
            floor = max(least, self.edge(total - left, k))
            may = total + left >= floor
            count = int(np.count_nonzero(may))
            if count <= few and not last:
                met.closed[number] += 1
                break
        else:
            met.to_the_end += 1
            floor = max(least, self.edge(total - slack, k))
            may = total + slack >= floor
        may &= ~own
        found = np.flatnonzero(may)
        met.members += len(found)
        return found

    def exact(self, asked: np.ndarray, vector: np.ndarray, place: np.ndarray) -> np.ndarray:
        """Scores of rows over all components, in integers; beyond 64 bits they are cut to the range of long."""
        if np.abs(asked).max(initial=0) * self.most * max(self.d, 1) < EXACT:
            return (self.rows[place] @ asked).astype(np.int64)
        own = whole(vector)
        sums = (sum(a * b for a, b in zip(own, whole(row))) for row in self.vectors[place])
        return np.array([min(max(x, LONG[0]), LONG[1]) for x in sums], np.int64)

    def top(self, name: int, vector: np.ndarray, k: int, least: float, met: Met) -> tuple[np.ndarray, np.ndarray]:
        """ids and scores of the first ``k`` of the block that reach ``least``; a key once, ties to the smaller."""
        asked = quantised(vector)
        place = self.members(name, asked, min(k, self.keys), least, met)
        score = self.exact(asked, vector, place)
        ids = self.ids[place]
        order = np.lexsort((ids, -score))
        ids, score = ids[order], score[order]
        if self.by_id is not None:
            first = np.sort(np.unique(ids, return_index=True)[1])
            ids, score = ids[first], score[first]
        keep = score[:k] >= least
        return ids[:k][keep], score[:k][keep]


def search(frame: DataFrame, queries: Column, k: int = K, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score (integer inner product) of the highest scores of each row where ``queries`` holds.

    ``queries`` is a condition on ``vec_id``. Rows with a null key and vectors that are null,
    empty or hold null or non-finite components take no part; vectors meet only those of their
    own length. Rows that share a key are one, of the higher score; ties go to the smaller key.
    Scores are exact, and cut to the range of long beyond it. An empty table gives an empty result.
    """
    rows = taking_part(frame, key, vector, zero=True).withColumn("asks", queries)
    count, cells = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("vector").cast("long")), F.lit(0))).first()
    blocks = max(1, -(-count // BLOCK), -(-cells // CELLS))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[np.ndarray, Block] | None = None
        for names, asked, ids, block, least in meetings(batches):
            if held is None or held[0] is not ids:
                held = (ids, Block(ids, block))
            met = Met()
            found = [held[1].top(int(q), v, k, float(x), met) for q, v, x in zip(names, asked, least.to_numpy())]
            counts = [len(x) for x, _ in found]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.repeat(names, counts)), pa.array(np.concatenate([x for x, _ in found])), pa.array(np.concatenate([x for _, x in found]))],
                ["query_id", "vec_id", "score"],
            )

    size = F.size("vector")
    none = F.lit(float("-inf"))
    own = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    filed = rows.select(own.alias("block"), F.lit(0).cast("byte").alias("asks"), "vec_id", "vector", none.alias("least"))

    def met(asking: DataFrame) -> DataFrame:
        """(block, vec_id, vector, least) of queries, in streams, against the rows of their block."""
        asked = asking.select("block", F.lit(1).cast("byte").alias("asks"), "vec_id", "vector", "least")
        both = filed.unionByName(asked).select(F.xxhash64("block", size).alias("key"), "asks", "vec_id", "vector", "least")
        return streamed(both.repartition("key").sortWithinPartitions("key", "asks")).mapInArrow(scored, "query_id long, vec_id long, score long")

    asking = rows.where("asks").withColumns({"own": own, "least": none})
    # Each query meets the block it is filed in first, so the first meetings are spread like the rows.
    found = met(asking.withColumn("block", F.col("own")))
    if blocks > 1:
        found = written(found, "own-block")
        # The k-th score of a whole answer bounds the final one from below.
        bound = found.groupBy("query_id").agg(F.count_distinct("vec_id").alias("n"), F.min("score").cast("double").alias("edge")).where(F.col("n") >= k)
        bound = bound.select(F.col("query_id").alias("vec_id"), (F.col("edge") - F.abs("edge") * 1e-12).alias("bound"))
        others = asking.join(bound, "vec_id", "left").withColumn("least", F.coalesce("bound", none))
        others = others.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(F.col("block") != F.col("own"))
        found = found.unionByName(met(others))
    return best(found, k, F.col("score").desc(), F.max("score"))


def op7(frame: DataFrame) -> DataFrame:
    """query_id, rank, vec_id, score: the 20 highest of each row whose key is divisible by 20; see ``search`` for odd rows."""
    return search(frame, F.col("vec_id") % 20 == 0)


ORACLE = """
WITH taking AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM taking q JOIN taking c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM scored QUALIFY rank <= 20"""
