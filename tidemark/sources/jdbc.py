"""Relational snapshots and half-open increments, read in parallel ranges."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.rules import contract_reason
from tidemark.schemas import CDC_ENTITIES, ENTITIES


def statement(table: str, start: str | None = None, end: str | None = None, schema: str = "commerce") -> str:
    """The SELECT for an allowed table; both bounds or neither, start <= updated_at < end."""
    where = predicates(table, start, end, 1)[0]
    return f"SELECT * FROM {schema}.{table}{'' if start is None else f' WHERE {where}'} ORDER BY {ENTITIES[table].key[0]}"


def _time(text: str) -> datetime:
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return at.astimezone(timezone.utc).replace(tzinfo=None) if at.tzinfo else at


def _stamp(at: datetime) -> str:
    return f"TIMESTAMP '{at.isoformat(sep=' ')}'"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def predicates(table: str, start: str | None = None, end: str | None = None, parts: int = 8, splits: Sequence[str] = ()) -> list[str]:
    """Conditions that deal the rows out, each row to one of them.

    An increment is cut into equal spans of ``updated_at``; a snapshot at the given keys, or not at all.
    """
    if table not in CDC_ENTITIES:
        raise ValueError(f"table not allowed: {table}")
    if (start is None) != (end is None):
        raise ValueError("an increment needs both bounds")
    if start is not None:
        low, high = _time(start), _time(end)
        at = [low + (high - low) * k / parts for k in range(parts)] + [high]
        return [f"updated_at >= {_stamp(a)} AND updated_at < {_stamp(b)}" for a, b in zip(at, at[1:])]
    key, cuts = ENTITIES[table].key[0], [_text(s) for s in sorted(splits)]
    lows = [f"{key} >= {c}" for c in cuts]
    highs = [f"{key} < {c}" for c in cuts]
    return [" AND ".join(filter(None, pair)) or "1 = 1" for pair in zip(["", *lows], [*highs, ""])]


def read(
    spark: SparkSession, url: str, table: str, start: str | None = None, end: str | None = None, fetch_size: int = 1000, most: int | None = None,
    parts: int = 8, splits: Sequence[str] = (), schema: str = "commerce", **options: str,
) -> DataFrame:
    """The rows in order of their key, each range by a task of its own. Needs the database's JDBC driver on the classpath.

    ``most`` refuses, rather than cuts, a larger result. Rows that break the entity's contract raise.
    """
    dealt = predicates(table, start, end, parts, splits)
    frame = spark.read.jdbc(url, f"{schema}.{table}", predicates=dealt, properties={"fetchsize": str(fetch_size), **options})
    if most is not None and frame.limit(most + 1).count() > most:
        raise ValueError("max_records_exceeded")
    return checked(frame, table).orderBy(ENTITIES[table].key[0])


def checked(frame: DataFrame, table: str) -> DataFrame:
    """``frame``; a row that breaks the contract of its table fails whoever reads it, with the reason."""
    text = frame.select(F.struct(*frame.columns).alias("_row"), *(F.col(c).cast("string").alias(c) for c in frame.columns))
    reason = contract_reason(table, frame.columns)
    broken = F.raise_error(F.concat(F.lit("invalid_source_schema:"), reason)).cast("boolean")
    return text.where(F.when(reason.isNull(), True).otherwise(broken)).select("_row.*")
