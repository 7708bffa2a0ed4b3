"""The landing envelope and content checksums, as plans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exprs as X
from tidemark.schemas import ENVELOPE


def envelope(
    frame: DataFrame, *, ingestion_id: str, source_name: str, source_entity: str, key: Sequence[str],
    ingested_at: str, extracted: str | None = None, source_version: str | None = None, locator: Column | None = None,
) -> DataFrame:
    """``frame`` with the nine landing columns; refuses frames that already use one of their names."""
    taken = sorted(set(frame.columns) & set(ENVELOPE))
    if taken:
        raise ValueError(f"reserved_envelope_field: {', '.join(taken)}")
    text = lambda value: F.lit(value).cast("string")
    return frame.withColumns({
        "ingestion_id": text(ingestion_id), "source_name": text(source_name), "source_entity": text(source_entity),
        "source_record_key": F.concat_ws("|", *(F.col(k).cast("string") for k in key)),
        "source_extract_ts": F.col(extracted).cast("string") if extracted else text(None),
        "ingested_at": text(ingested_at), "source_version": text(source_version),
        "source_locator": locator if locator is not None else text(source_entity),
        "record_hash": X.record_hash(frame.columns),
    })


def checksum(columns: Sequence[str]) -> Column:
    """An aggregate: one checksum of all rows, whatever their order; repeated rows count.

    The number of rows and, of eight 32-bit lanes of the row hashes, the sums, hashed together:
    each task hands on nine numbers, so nothing is gathered.
    """
    row = X.record_hash(columns)
    lane = lambda k: F.sum(F.conv(F.substring(row, 8 * k + 1, 8), 16, 10).cast("decimal(20,0)")).cast("string")
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *(lane(k) for k in range(8))), 256)


def content_checksum(frame: DataFrame) -> DataFrame:
    """One row: a checksum of all rows but for their order and ``ingested_at``."""
    return frame.agg(checksum([c for c in frame.columns if c != "ingested_at"]).alias("checksum"))
