"""The registered queries of this subpackage: each applies its operator to its whole table and returns the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fluvius.llm import ann, decontam, licenses, passages, pii, quality, sentencepiece, simhash, tokenstore, toxicity

PIECES, WORD_VOCABULARY = "piece_bpe_32k.model", "word_bpe_49k.json"


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.scan(_table(spark, sf_dir, "documents")))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.scores(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text encoded, and decoded again: ``exact`` tells whether the text came back."""
    return sentencepiece.encode(_table(spark, sf_dir, "documents"), vocabulary(PIECES), checked=True).select("doc_id", "n_tokens", "ids_crc32", "exact")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scores(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeats(_table(spark, sf_dir, "documents"))


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, manifest = tokenstore.write(_table(spark, sf_dir, "documents"), vocabulary(WORD_VOCABULARY))
    return tokenstore.read(spark, folder, manifest)


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.scan(_table(spark, sf_dir, "documents")))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    return ann.search(rows, rows.where(F.col("vec_id") % 100 == 0))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.groups(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexed(F.col("fp")).alias("fingerprint"), "component_id")


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_decontamination, op3_quality, op4_sentencepiece, op5_toxicity, op6_passages, op7_token_store, op8_pii, op9_nearest, op10_simhash)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE: dict[str, str] = {}
