"""Key frequencies. Everything downstream of a table, but for its rows, is computed from its key histogram."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def keyed(df: DataFrame, key: Column, domain: int) -> DataFrame:
    """``df`` with ``key``, a long in [1, domain]; rows of null or other keys go."""
    return df.withColumn("key", key.cast("long")).where(F.col("key").between(1, domain))


def key_freq(df: DataFrame) -> DataFrame:
    """(key, freq) of a keyed table: one map-side combined shuffle."""
    return df.groupBy("key").agg(F.count("*").alias("freq"))


def key_groups(df: DataFrame) -> DataFrame:
    """(key, freq, payloads): all rows of a key in one array. For groups of bounded size; everything else uses key_freq."""
    rows = F.struct(*[F.col(c) for c in df.columns if c != "key"])
    return df.groupBy("key").agg(F.count("*").alias("freq"), F.array_sort(F.collect_list(rows)).alias("payloads"))


def max_freq(freq: DataFrame) -> DataFrame:
    """One row (max_freq); 0 for an empty table."""
    return freq.agg(F.coalesce(F.max("freq"), F.lit(0)).cast("long").alias("max_freq"))


def multi_key_max_freq(df: DataFrame, keys: list[Column]) -> DataFrame:
    """One row (max_freq): the largest frequency of any of several keys of one table, at least 1; 1 if a key has no values."""
    every = df.select(F.explode(F.array(*[F.struct(F.lit(k).alias("which"), c.cast("long").alias("key")) for k, c in enumerate(keys)])).alias("x"))
    freq = every.select("x.*").where("key IS NOT NULL").groupBy("which", "key").agg(F.count("*").alias("freq"))
    each = freq.groupBy("which").agg(F.max("freq").alias("m"))
    return each.agg(F.when(F.count("*") < len(keys), 1).otherwise(F.greatest(F.max("m"), F.lit(1))).cast("long").alias("max_freq"))


def joined_freq(*freqs: DataFrame) -> DataFrame:
    """(key, freq) of the equi-join of tables on their keys, without a joined row."""
    return reduce(lambda a, b: a.join(b.withColumnRenamed("freq", "other"), "key").select("key", (F.col("freq") * F.col("other")).alias("freq")), freqs)
