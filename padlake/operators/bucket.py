"""Buckets: rows dealt to intervals, each padded with noisily many dummies.

Dummies are counts; rows of them are made only on demand, for there may be many times more than real rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padlake.functions.noise import Keyed, ShiftedGeometric, shifted_geometric_sql
from padlake.operators.partition import part_of

DUMMY_KEY = -999


def buckets(freq: DataFrame, parts: DataFrame, domain: int, noise: ShiftedGeometric, source: Keyed, table: str) -> DataFrame:
    """(part_id, start, end, n_real, n_dummy): rows of a key histogram in each interval, and its dummies, one draw for each."""
    real = part_of(freq, parts, domain).groupBy("part_id").agg(F.sum("freq").cast("long").alias("n_real"))
    padded = parts.join(real, "part_id", "left").withColumn("n_real", F.coalesce("n_real", F.lit(0)).cast("long"))
    draw = noise.noise(source.column("bucket", table, F.col("part_id"), "u"), source.column("bucket", table, F.col("part_id"), "v"))
    return padded.withColumn("n_dummy", draw)


def buckets_sql(name: str, freq: str, parts: str, noise: ShiftedGeometric | tuple[str, float, float], source: Keyed, table: str) -> str:
    """Common table expression ``name`` (part_id, start, end, n_real, n_dummy). ``noise`` is a mechanism, or (SQL of its sensitivity, eps, delta)."""
    u, v = (source.sql("'bucket'", f"'{table}'", "p.part_id", f"'{x}'") for x in "uv")
    drawn = noise.noise_sql(u, v) if isinstance(noise, ShiftedGeometric) else shifted_geometric_sql(*noise, u, v)
    return f"""
    {name} AS (
        SELECT p.part_id, p.start, p."end", coalesce(sum(f.freq), 0)::BIGINT AS n_real, any_value({drawn}) AS n_dummy
        FROM {parts} p LEFT JOIN {freq} f ON f.key BETWEEN p.start AND p."end" GROUP BY p.part_id, p.start, p."end")"""


def summary(bucket: DataFrame) -> DataFrame:
    """One row: intervals, empty ones, real rows, dummies, the ratio (real + dummies) / real and the mean size of a bucket, null where there is nothing."""
    total = F.col("n_real") + F.col("n_dummy")
    stats = bucket.agg(F.count("*").alias("n_buckets"), F.sum(F.when(F.col("n_real") == 0, 1).otherwise(0)).alias("n_empty"), F.sum("n_real").alias("n_real"), F.sum("n_dummy").alias("n_dummy"), F.sum(total).alias("n_total"))
    each = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return stats.select("n_buckets", F.coalesce("n_empty", F.lit(0)).cast("long").alias("n_empty"), F.coalesce("n_real", F.lit(0)).alias("n_real"), F.coalesce("n_dummy", F.lit(0)).alias("n_dummy"), each("n_total", "n_real").alias("ratio"), each("n_total", "n_buckets").alias("mean_size"))


def padded_rows(rows: DataFrame, bucket: DataFrame, domain: int) -> DataFrame:
    """Rows of a keyed table with part_id and is_dummy, and the dummies of each bucket, of key DUMMY_KEY and nulls else."""
    real = part_of(rows, bucket.select("part_id", "start", "end"), domain).withColumn("is_dummy", F.lit(False))
    some = bucket.where("n_dummy > 0").select("part_id", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_dummy"))).alias("n"))
    dummies = some.select("part_id", F.lit(DUMMY_KEY).cast("long").alias("key"), F.lit(True).alias("is_dummy"))
    return real.unionByName(dummies, allowMissingColumns=True)


def real_rows(padded: DataFrame) -> DataFrame:
    """Back to the table: dummies and bucket numbers go."""
    return padded.where(~F.col("is_dummy")).drop("is_dummy", "part_id")
