"""What the two vector searches share: valid vectors, and rows of a key met in order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid(vector: Column, zero: bool) -> Column:
    """True for vectors without null or non-finite components; ``zero`` lets vectors of zeros in."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    some = F.lit(True) if zero else F.exists(vector, lambda x: x != 0)
    return F.coalesce(vector.isNotNull() & (F.size(vector) > 0) & finite & some, F.lit(False))


def taking_part(frame: DataFrame, key: str, vector: str, zero: bool, cast: bool = True) -> DataFrame:
    """(vec_id, vector: array<double>, or as it is) of the rows that take part; a null key takes no part."""
    kept = frame.where(valid(frame[vector], zero) & frame[key].isNotNull())
    return kept.select(kept[key].cast("long").alias("vec_id"), (kept[vector].cast("array<double>") if cast else kept[vector]).alias("vector"))


def matrix(column: pa.ListArray, at: slice) -> np.ndarray:
    """The vectors at ``at``, all of one length, as rows."""
    part = column.slice(at.start, at.stop - at.start)
    return part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1)


def meetings(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array | None]]:
    """Rows (key, asks, vec_id, vector, perhaps one more) sorted by key and asks: each piece of a key's queries with the key's whole block.

    Yields query ids, query vectors, block ids, block vectors, and the queries' further column. Only the block is held.
    """
    here, ids, rows = None, [], []
    block: tuple[np.ndarray, np.ndarray] | None = None
    for batch in batches:
        key, asks = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        names, vectors = batch.column(2).to_numpy(), batch.column(3)
        more = batch.column(4) if batch.num_columns > 4 else None
        cuts = np.r_[0, np.nonzero((np.diff(key) != 0) | (np.diff(asks) != 0))[0] + 1, len(key)] if len(key) else [0]
        for a, b in zip(cuts[:-1], cuts[1:]):
            if key[a] != here:
                here, ids, rows, block = key[a], [], [], None
            if not asks[a]:
                ids.append(names[a:b])
                rows.append(matrix(vectors, slice(a, b)))
            elif ids:
                block = block or (np.concatenate(ids), np.concatenate(rows))
                yield names[a:b], matrix(vectors, slice(a, b)), *block, None if more is None else more.slice(a, b - a)


def best(found: DataFrame, k: int, order: Column, merge: Column) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's first ``k`` by ``order``; a pair met twice counts once."""
    once = found.groupBy("query_id", "vec_id").agg(merge.alias("score"))
    line = Window.partitionBy("query_id").orderBy(order, "vec_id")
    return once.withColumn("rank", F.row_number().over(line)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
