"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import ann, bpe, chat, langid, licenses, mixing, quality, simhash, suffixdedup, topk
from tidemark.llm.util import read


def _over(table: str, operator: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: operator(read(spark, sf_dir, table))


QUERIES = {
    "op1_language_id": _over("documents", langid.op1),
    "op2_simhash_near_dedup": _over("documents", simhash.op2),
    "op3_byte_bpe": _over("documents", bpe.op3),
    "op4_chat_formatting": _over("conversations", chat.op4),
    "op5_nearest_neighbours": _over("embeddings", ann.op5),
    "op6_license_scan": _over("documents", licenses.op6),
    "op7_exact_topk": _over("embeddings", topk.op7),
    "op8_quality_classifier": lambda spark, sf_dir: quality.op8(
        read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    ),
    "op9_suffix_array_dedup": _over("documents", suffixdedup.op9),
    "op10_mixing": _over("documents", mixing.op10),
}
ORACLES = {
    "op4_chat_formatting": chat.ORACLE,
    "op6_license_scan": licenses.ORACLE,
    "op7_exact_topk": topk.ORACLE,
    "op10_mixing": mixing.ORACLE,
}
