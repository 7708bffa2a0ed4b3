"""A corpus from raw documents: ``STAGES`` in order, each on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, mixing, quality, simhash, suffixdedup
from tidemark.llm.util import read, remainder, written


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts; it learns from labels whose key's remainder by 5 is not 0."""
    labels = read(spark, sf_dir, "labels")
    return quality.keep_good(docs, labels.where(remainder(F.col("doc_id"), 5) != 0))


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return simhash.first_of_each(docs)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without strings of 400 bytes and passages of over 50 words that repeat; ``n_chars`` follows the text."""
    cut = suffixdedup.remove_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in cut.columns else cut


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sources at their target weights, documents as often as the mix takes them."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their ``token_ids``, which are decoded here and must give the text; the stage fails if not."""
    columns = [c for c in docs.columns if c != "token_ids"]
    others = [docs[f"`{c}`"] for c in columns if c != "text"] or [F.lit(0).alias("_")]
    packed = docs.select(F.struct(*others).alias("row"), docs["text"].alias("text"))
    same = F.col("decoded") == F.coalesce("text", F.lit("")).cast("binary")
    wrong = F.raise_error(F.lit("token ids do not decode to the text")).cast("boolean")
    checked = bpe.decode(bpe.encode(packed)).where(F.when(same, True).otherwise(wrong))
    return checked.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in columns), "token_ids")


STAGES = [
    ("quality", good),
    ("near-duplicates", distinct),
    ("repeats", unrepeated),
    ("mixture", mixed),
    ("tokens", tokens),
]
#: SQL cannot express the classifier, the suffix sort and the encoding; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's rows written before the next reads them."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
