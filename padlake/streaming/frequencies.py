"""Key histograms of a stream, window by window: what the padded joins need of a table, kept up to date as rows come.

The tables that the joins know are static; a stream becomes one when its windows close. Late rows count until the
watermark has passed their window, and a closed window is released once, as its noise must be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padlake.functions.noise import Keyed, ShiftedGeometric


def windowed_key_freq(stream: DataFrame, key: Column, time: str, window: str, late: str, domain: int) -> DataFrame:
    """(start, key, freq) of each window, for rows whose key lies in [1, domain]; for a batch table the same without lateness."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).withColumn("key", key.cast("long")).where(F.col("key").between(1, domain))
    counts = rows.groupBy(F.window(time, window).alias("w"), "key").agg(F.count("*").alias("freq"))
    return counts.select(F.col("w.start").alias("start"), "key", "freq")


def windowed_buckets(stream: DataFrame, bucket: Column, time: str, window: str, late: str, noise: ShiftedGeometric, source: Keyed, table: str) -> DataFrame:
    """(start, part_id, n_real, n_dummy) of each window and bucket that has rows; ``bucket`` is the bucket of a row, as of equal intervals."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late).withColumn("part_id", bucket)
    counts = rows.groupBy(F.window(time, window).alias("w"), "part_id").agg(F.count("*").alias("n_real"))
    start, part = F.col("w.start").cast("long"), F.col("part_id")
    drawn = noise.noise(source.column("window", table, start, part, "u"), source.column("window", table, start, part, "v"))
    return counts.select(F.col("w.start").alias("start"), "part_id", "n_real", drawn.alias("n_dummy"))
