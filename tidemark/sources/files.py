"""CSV and JSON feeds, by content: the same bytes are the same file wherever they lie."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The kinds of file that are read.
SUFFIXES = (".csv", ".json")


def _allowed(path: str, *suffixes: str) -> str:
    if PurePosixPath(path).suffix.lower() not in suffixes:
        raise ValueError(f"unsupported_file_type:{path}")
    return path


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """With header, every field as the schema says; a byte order mark is no part of the first name."""
    return spark.read.option("header", True).option("enforceSchema", True).option("encoding", "UTF-8").schema(schema).csv(_allowed(path, ".csv"))


def read_numbered_csv(spark: SparkSession, path: str, schema: str, name: str = "row_number") -> DataFrame:
    """As ``read_csv`` with each row's place in its file, from 0, however the file is split.

    Splits are read in order, so a row's place is its place in the split after the rows of the
    splits before it; those are counted, a row a split.
    """
    rows = read_csv(spark, path, schema).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    splits = rows.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = splits.withColumn("_start", F.coalesce(before, F.lit(0))).drop("_n")
    placed = rows.join(starts, ["_file", "_block"]).withColumn(name, F.col("_start") + F.col("_id") - F.col("_first"))
    return placed.drop("_file", "_block", "_id", "_first", "_start")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of objects, or one object, to a row each; ``_corrupt_record`` holds what is neither."""
    return spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(f"{schema}, _corrupt_record string").json(_allowed(path, ".json"))


def _contents(spark: SparkSession, paths: str | Sequence[str], glob: str = "*") -> DataFrame:
    """Feeds are files of at most 2 GB: each is one value."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(paths)


def identities(spark: SparkSession, paths: str | Sequence[str], glob: str = "*") -> DataFrame:
    """path, content_sha256, length and ``copy`` (1 for the first path of each content)."""
    named = _contents(spark, paths, glob).select("path", F.sha2("content", 256).alias("content_sha256"), "length")
    return named.withColumn("copy", F.row_number().over(Window.partitionBy("content_sha256").orderBy("path")))


def rows_of(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows of JSON files with ``source_version`` (content hash) and ``source_locator`` (hash and place in the file)."""
    content = spark.read.format("binaryFile").load(_allowed(path, ".json")).select(F.sha2("content", 256).alias("h"), F.decode("content", "UTF-8").alias("text"))
    text = F.when(F.col("text").rlike(r"^\s*\["), F.col("text")).otherwise(F.concat(F.lit("["), "text", F.lit("]")))
    rows = content.select("h", F.posexplode_outer(F.from_json(text, f"array<struct<{schema}>>")).alias("at", "row"))
    return rows.select(
        "row.*", F.concat(F.lit("sha256:"), "h").alias("source_version"),
        F.concat(F.lit("content_sha256:"), "h", F.lit("#row="), F.col("at")).alias("source_locator"),
    )


def _malformed(headers: Mapping[str, Sequence[str]]) -> Column:
    """Files that are no JSON object or array of objects, or CSV files without the header they should have."""
    suffix = F.lower(F.element_at(F.split("name", r"\."), -1))
    text = F.decode("content", "UTF-8")
    parsed = F.try_parse_json(text)
    kind = F.schema_of_variant(parsed)
    not_json = parsed.isNull() | ~(kind.startswith("OBJECT") | kind.startswith("ARRAY<OBJECT") | (kind == "ARRAY<VOID>"))
    found = F.split(F.regexp_replace(F.element_at(F.split(text, r"\r?\n"), 1), "^\ufeff", ""), ",")
    wanted = [(name, F.array(*map(F.lit, fields))) for name, fields in headers.items()]
    needed = F.element_at(F.create_map(*(x for name, fields in wanted for x in (F.lit(name), fields))), F.col("name")) if wanted else F.lit(None).cast("array<string>")
    not_csv = F.coalesce(F.size(F.array_except(needed, found)) > 0, F.lit(False)) | (F.length(F.trim(text)) == 0)
    return F.when(suffix == "json", not_json).when(suffix == "csv", not_csv).otherwise(F.lit(True))


def sweep(spark: SparkSession, folder: str, expected: Sequence[str] = (), headers: Mapping[str, Sequence[str]] | None = None) -> tuple[DataFrame, DataFrame]:
    """(files to land, files to set aside).

    Copies of a content land once. What is malformed (``headers`` names the fields of CSV files),
    of another kind than SUFFIXES, or expected and not there is set aside.
    """
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    found = _contents(spark, folder).select("path", name, "content", "length", F.sha2("content", 256).alias("content_sha256"))
    known = F.lower(F.concat(F.lit("."), F.element_at(F.split("name", r"\."), -1))).isin(*SUFFIXES)
    reason = F.when(~known, "unsupported_file_type").when(_malformed(headers or {}), "malformed_file")
    judged = found.withColumn("reason", reason).drop("content")
    first = F.row_number().over(Window.partitionBy("content_sha256").orderBy("path"))
    good = judged.where("reason IS NULL").withColumn("copy", first)
    wanted = spark.createDataFrame([(e,) for e in expected], "name string")
    absent = wanted.join(judged.select("name"), "name", "left_anti").select(F.col("name").alias("path"), F.lit("expected_file_missing").alias("reason"))
    copies = good.where("copy > 1").select("path", F.lit("duplicate_content").alias("reason"))
    aside = judged.where("reason IS NOT NULL").select("path", "reason").unionByName(copies).unionByName(absent)
    return good.where("copy = 1").select("path", "content_sha256", "length"), aside


def bronze(spark: SparkSession, root: str) -> DataFrame:
    """All landed Parquet below ``root``, at any depth, with the envelope's times as timestamps.

    Folders are not read as columns, so ``ingestion_id=`` in a path does not hide the column; batches
    may differ in their columns, and a time that is none is null.
    """
    found = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").option("mergeSchema", True).parquet(root)
    return found.withColumns({c: F.try_to_timestamp(F.col(c).cast("string")) for c in ("source_extract_ts", "ingested_at") if c in found.columns})


def seeds(spark: SparkSession, folder: str, schemas: Mapping[str, str]) -> dict[str, DataFrame]:
    """Small CSV tables that come with a project, by name: ``folder/name.csv`` in its schema; a value that does not fit fails the read."""
    return {n: spark.read.option("header", True).option("mode", "FAILFAST").schema(schema).csv(f"{folder.rstrip('/')}/{n}.csv") for n, schema in schemas.items()}
