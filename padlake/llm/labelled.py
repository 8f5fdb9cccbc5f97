"""A bounded sample of labelled rows, on which classifiers are fitted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, n: int) -> Column:
    """crc32 of the key as text, modulo n; null for a null key."""
    return F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % n


def training_rows(docs: DataFrame, labels: DataFrame, label: str, learnable: Column, bound: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text, label) of at most ``bound`` label rows that are ``learnable``, those of the smallest key hash.

    ``bound`` also bounds what is broadcast: the sample's keys. Rows without a key or label are no candidates; a key
    that ``docs`` has more than once gives a row for each. Columns may have any names.
    """
    some = (
        labels.where(learnable)
        .select(F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").cast("double").alias("label"))
        .where(F.col("label").isNotNull())
        .orderBy(F.xxhash64(F.col("key").cast("string")), "key", "label")
        .limit(bound)
    )
    return docs.select(F.col(f"`{key}`").alias("key"), F.col(f"`{text}`").alias("text")).join(F.broadcast(some), "key").select("key", "text", "label")
