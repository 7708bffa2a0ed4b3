"""The corpus pipeline, stage by stage, on a small input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, quality, simhash, suffixdedup
from tidemark.llm.util import read, remainder

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = read(spark, SF, "documents")
    before = docs.collect()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
        assert docs.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    labels = {r.doc_id: r.quality for r in read(spark, SF, "labels").collect()}
    good = {r.doc_id for r in kept["quality"]}
    wrong = [r.doc_id for r in before if r.doc_id in labels and (labels[r.doc_id] == 1) != (r.doc_id in good)]
    assert len(wrong) <= 0.05 * len(labels)
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in kept["quality"]}
    first = {r.doc_id for r in kept["near-duplicates"]}
    assert all(any((prints[d] ^ prints[e]).bit_count() <= 4 for e in prints if e != d) for d in prints if d not in first)
    assert all((prints[d] ^ prints[e]).bit_count() > 4 for d in first for e in first if d < e)
    assert {r.doc_id for r in kept["repeats"]} == first
    assert all(r.n_chars == len(r.text) for r in kept["repeats"])
    assert {r.doc_id for r in kept["mixture"]} <= first
    codec = bpe.codec(*bpe.vocabulary())
    assert all(codec.decode(r.token_ids) == r.text.encode() for r in kept["tokens"]) and len(kept["tokens"]) == len(kept["mixture"])


def test_run_is_the_stages(spark):
    assert corpus_pipeline.run(spark, SF).columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids"]


@pytest.mark.parametrize("text", ["text"])
def test_repeats_keep_characters_whole(spark, text):
    body = "é" * 400
    docs = spark.createDataFrame([(1, "x" + body), (2, "yé" + body), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in suffixdedup.remove_repeats(docs).collect()}[3] is None
    assert quality.KEEP == 0.3 and remainder is not None


def test_tokens_are_decoded(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "é a", 7), (2, None, 7), (3, "", 7), (None, "x", None)], "doc_id long, text string, decoded int")
    found = corpus_pipeline.tokens(spark, docs, SF)
    assert found.columns == ["doc_id", "text", "decoded", "token_ids"]
    assert sorted((tuple(r)[:3] for r in found.collect()), key=str) == sorted(map(tuple, docs.collect()), key=str)
    monkeypatch.setattr(bpe, "decode", lambda d: d.withColumn("decoded", F.lit(b"other")))
    with pytest.raises(Exception, match="do not decode to the text"):
        corpus_pipeline.tokens(spark, docs, SF).collect()


def test_tokens_take_one_worker_a_task(spark):
    passes = lambda frame: frame._jdf.queryExecution().executedPlan().toString().count("MapInArrow")
    assert passes(corpus_pipeline.tokens(spark, read(spark, SF, "documents"), SF)) == 1
    docs = spark.createDataFrame([(1, "é a", 7, "x"), (2, None, 7, "y"), (3, "", None, None), (None, "don't", 1, "z")], "doc_id long, text string, n int, s string").toDF("doc_id", "text", "a.b", "_")
    found = corpus_pipeline.tokens(spark, docs, SF)
    assert passes(found) == 1 and found.columns == ["doc_id", "text", "a.b", "_", "token_ids"]
    codec = bpe.codec(*bpe.vocabulary())
    assert {tuple(r)[:4]: r.token_ids for r in found.collect()} == {tuple(r): codec.encode(r.text) for r in docs.collect()}
    # Ids of other origin, and those that were changed since, are decoded as they stand.
    encoded = bpe.encode(docs.select("doc_id", "text", "_"))
    some = bpe.decode(encoded.where("doc_id = 1").select("doc_id", F.slice("token_ids", 1, 1).alias("token_ids")))
    assert passes(some) == 2 and [bytes(r.decoded) for r in some.collect()] == [codec.decode(codec.encode("é a")[:1])]
    again = bpe.decode(bpe.decode(encoded))
    assert again.columns == ["doc_id", "text", "_", "token_ids", "decoded"]
    assert all(bytes(r.decoded) == (r.text or "").encode() for r in again.collect())
    only = corpus_pipeline.tokens(spark, docs.select(F.lit("old").alias("token_ids"), "text"), SF)
    assert only.columns == ["text", "token_ids"] and sorted(len(r.token_ids) for r in only.collect()) == sorted(len(codec.encode(r.text)) for r in docs.collect())
