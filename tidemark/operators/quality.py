"""Data-quality checks and reconciliations: a row is a failure."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def not_null(frame: DataFrame, column: str) -> DataFrame:
    return frame.where(F.col(column).isNull())


def duplicate_keys(frame: DataFrame, keys: Sequence[str], name: str = "row_count") -> DataFrame:
    return frame.groupBy(*keys).agg(F.count(F.lit(1)).alias(name)).where(F.col(name) > 1)


def accepted_values(frame: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return frame.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def orphans(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows of ``child`` whose non-null reference finds no parent."""
    return child.where(F.col(column).isNotNull()).join(
        parent.select(F.col(key).alias(column)), column, "left_anti"
    )


def any_null(columns: Sequence[str]) -> Column:
    return reduce(or_, (F.col(c).isNull() for c in columns))


def missing_both_ways(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str]) -> DataFrame:
    """(exception_type, key): keys that only one side has."""
    one = left.select(key).join(right.select(key), key, "left_anti").withColumn("exception_type", F.lit(names[0]))
    two = right.select(key).join(left.select(key), key, "left_anti").withColumn("exception_type", F.lit(names[1]))
    return one.unionByName(two).select("exception_type", key)


def mismatches(expected: DataFrame, actual: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Keys whose values differ or that only one side has; nulls are values like any other."""
    e, a = expected.alias("e"), actual.alias("a")
    joined = e.join(a, [F.col(f"e.{k}").eqNullSafe(F.col(f"a.{k}")) for k in keys], "full_outer")
    differ = reduce(or_, (~F.col(f"e.{v}").eqNullSafe(F.col(f"a.{v}")) for v in values))
    return joined.where(differ).select(*(F.coalesce(f"e.{k}", f"a.{k}").alias(k) for k in keys))


#: The gates and how binding each is.
GATES = {
    "Q01": "BLOCKING", "Q02": "BLOCKING", "Q03": "BLOCKING", "Q04": "BLOCKING", "Q05": "BLOCKING",
    "Q06": "WARNING", "Q07": "WARNING", "Q08": "WARNING", "Q09": "INFORMATIONAL", "Q10": "INFORMATIONAL",
}


def counted(counts: Sequence[DataFrame], name: str, value: str) -> DataFrame:
    """One-row frames of numbers as rows (name, value), a row a column."""
    row = reduce(DataFrame.crossJoin, counts)  # one-row relations
    pairs = [F.struct(F.lit(c).alias(name), F.col(c).cast("bigint").alias(value)) for c in row.columns]
    return row.select(F.explode(F.array(*pairs)).alias("_pair")).select("_pair.*")


def gate(counts: Sequence[DataFrame]) -> DataFrame:
    """(gate_id, classification, failures, status) of one-row frames whose columns are gates.

    A failure blocks or is reported; what informs is recorded, whatever its number.
    """
    kinds = F.create_map(*[F.lit(x) for pair in GATES.items() for x in pair])
    kind = F.element_at(kinds, F.col("gate_id"))
    status = F.when(kind == "INFORMATIONAL", "recorded").when(F.col("failures") == 0, "passed").when(kind == "BLOCKING", "blocked").otherwise("reported")
    return counted(counts, "gate_id", "failures").select("gate_id", kind.alias("classification"), "failures", status.alias("status"))


def key_excess(frame: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """One row: how many keys occur more than once."""
    return duplicate_keys(frame, keys, "_n").agg(F.count(F.lit(1)).alias(name))


def one_sided(left: DataFrame, right: DataFrame, key: str, name: str, values: Sequence[str] = ()) -> DataFrame:
    """One row: keys that only one side has, or whose ``values`` differ."""
    return mismatches(left.withColumn("_there", F.lit(True)), right.withColumn("_there", F.lit(True)), [key], ["_there", *values]).agg(F.count(F.lit(1)).alias(name))
