"""Bounded samples of labelled rows, from which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sample(docs: DataFrame, labels: DataFrame, label: str, fold: int, rest: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``most`` labelled rows outside the held-out fold (crc32 of the id as text, modulo ``fold``,
    is ``rest``), those with the smallest hashes of their ids. Rows with a null id, or with a label other than 0 and 1, are not
    learnt from; of an id that comes with several texts, one is: that with the smallest hash."""
    key = F.col(id_col).cast("string")
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1) & (F.crc32(key) % fold != rest))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label).cast("double").alias("label"))  # repeated labels count once
    chosen = known.orderBy(F.xxhash64("_id"), "_id").limit(most)  # at most `most` rows: small enough to broadcast
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"))
    found = rows.join(F.broadcast(chosen), "_id").groupBy("_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return found.select(F.col("_id").alias("doc_id"), F.col("t.text").alias("text"), "label")


def held_out(key: str, fold: int, rest: int):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % fold == rest, F.lit(False))
