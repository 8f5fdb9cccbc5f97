"""Synthetic keyed tables: most keys in Gaussian clusters around centres, the rest uniform over the domain.

Draws are keyed by the seed, the table and the row, so that they don't depend on partitions, a task that runs again
makes the same rows, and another engine can make them too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from padlake.functions.noise import Keyed

#: Fixed values of the generators: the share of clustered keys, and a cluster's deviation as a share of the domain.
CLUSTERED, SPREAD, CLUSTERS = 0.8, 1e-4, 50
#: Fixed values of the mock table: first key, last key, least and most rows of each.
MOCK = ((1, 10, 5, 14), (40, 45, 1, 4), (90, 100, 20, 49))
SOURCE = Keyed("rows")


def centers(domain: int, n: int = CLUSTERS, seed: int = 1) -> list[int]:
    """n places in the domain."""
    return [math.floor(SOURCE.value("centre", seed, k) * domain) + 1 for k in range(n)]


def _clustered(at: Column, n: int, domain: int, around: list[int], spread: float, tag: str) -> Column:
    """Key of row ``at`` of n: as many for each centre as its share, then uniform ones; clipped to the domain."""
    each = int(CLUSTERED * n) // len(around)
    u, v = SOURCE.column(tag, at, "u"), SOURCE.column(tag, at, "v")
    centre = F.element_at(F.array(*[F.lit(c).cast("long") for c in around]), (F.floor(at / max(each, 1)) + 1).cast("int"))
    normal = F.sqrt(-2 * F.log(u)) * F.cos(F.lit(2 * math.pi) * v)
    drawn = F.when(at < each * len(around), centre + normal * F.lit(spread * domain)).otherwise(F.floor(u * domain) + 1)
    return F.least(F.greatest(drawn.cast("long"), F.lit(1)), F.lit(domain)).cast("long")


def clustered_keys(spark: SparkSession, domain: int, n: int, around: list[int] | None = None, spread: float = SPREAD, seed: int = 1, name: str = "key") -> DataFrame:
    """(key): n keys. Rows are made where they are used."""
    around = around or centers(domain, seed=seed)
    return spark.range(n).select(_clustered(F.col("id"), n, domain, around, spread, f"{seed}/{name}").alias(name))


def _small(low: int, high: int, tag: str) -> Column:
    return (F.floor(SOURCE.column(tag, F.col("id")) * (high - low + 1)) + low).cast("long")


def fk_tables(spark: SparkSession, domain: int, n1: int, n2: int, n3: int, seed: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """T1(A, B), T2(B, C), T3(C, D): B and C clustered around shared centres, A and D uniform in 1..999."""
    on_b, on_c = centers(domain, seed=seed), centers(domain, seed=seed + 1)
    key = lambda n, around, tag: _clustered(F.col("id"), n, domain, around, SPREAD, f"{seed}/{tag}")
    t1 = spark.range(n1).select(_small(1, 999, f"{seed}/A1").alias("A"), key(n1, on_b, "B1").alias("B"))
    t2 = spark.range(n2).select(key(n2, on_b, "B2").alias("B"), key(n2, on_c, "C2").alias("C"))
    t3 = spark.range(n3).select(key(n3, on_c, "C3").alias("C"), _small(1, 999, f"{seed}/D3").alias("D"))
    return t1, t2, t3


def same_key_tables(spark: SparkSession, domain: int, *sizes: int, attributes: bool = True, seed: int = 1) -> list[DataFrame]:
    """Tables (Key, Attr_A..) of shared centres, one for each size; attributes are uniform in 1..99."""
    around = centers(domain, seed=seed)
    out = []
    for k, n in enumerate(sizes):
        columns = [_clustered(F.col("id"), n, domain, around, SPREAD, f"{seed}/Key{k}").alias("Key")]
        out.append(spark.range(n).select(*columns, *([_small(1, 99, f"{seed}/Attr{k}").alias(f"Attr_{'ABCD'[k]}")] if attributes else [])))
    return out


def sparse_keys(spark: SparkSession, domain: int, n: int, clusters: int = 5, spread: float = 0.005, seed: int = 1) -> DataFrame:
    """(key), sorted: few wide clusters in a large domain."""
    return clustered_keys(spark, domain, n, centers(domain, clusters, seed), spread, seed).orderBy("key")


def mock_keys(spark: SparkSession, seed: int = 1) -> DataFrame:
    """(key) in 1..100: dense at 1-10 (5 to 14 rows each), sparse at 40-45 (1 to 4), denser at 90-100 (20 to 49), nothing between."""
    spans = spark.createDataFrame(list(MOCK), "a int, b int, low int, high int")
    keys = spans.select(F.explode(F.sequence("a", "b")).alias("k"), "low", "high").withColumn("key", F.col("k").cast("long"))
    n = (F.floor(SOURCE.column("mock", F.lit(seed), F.col("key")) * (F.col("high") - F.col("low") + 1)) + F.col("low")).cast("int")
    return keys.select("key", F.explode(F.sequence(F.lit(1), n)).alias("copy")).select("key")


# The same as DuckDB SQL


def _at_sql(n: int) -> str:
    return f"(SELECT unnest(range({n})) AS id)"


def clustered_sql(n: int, domain: int, around: list[int], tag: str, spread: float = SPREAD) -> str:
    """The key of row ``id``."""
    each = int(CLUSTERED * n) // len(around)
    u, v = (SOURCE.sql(f"'{tag}'", "id", f"'{x}'") for x in "uv")
    normal = f"sqrt(-2 * ln({u})) * cos({2 * math.pi!r} * {v})"
    centre = f"{around}[id // {max(each, 1)} + 1]"
    return f"least(greatest(trunc(CASE WHEN id < {each * len(around)} THEN {centre} + {normal} * {spread * domain!r} ELSE floor({u} * {domain}) + 1 END)::BIGINT, 1), {domain})::BIGINT"


def small_sql(low: int, high: int, tag: str) -> str:
    return f"(floor({SOURCE.sql(_quoted(tag), 'id')} * {high - low + 1}) + {low})::BIGINT"


def keys_sql(n: int, domain: int, around: list[int], tag: str, name: str = "key", spread: float = SPREAD) -> str:
    return f'SELECT {clustered_sql(n, domain, around, tag, spread)} AS "{name}" FROM {_at_sql(n)}'


def mock_sql(seed: int = 1) -> str:
    spans = ", ".join(f"({a}, {b}, {low}, {high})" for a, b, low, high in MOCK)
    n = f"(floor({SOURCE.sql(_quoted('mock'), str(seed), 'key')} * (high - low + 1)) + low)::INT"
    keys = f"SELECT unnest(range(a, b + 1)) AS key, low, high FROM (VALUES {spans}) s(a, b, low, high)"
    return f"SELECT key::BIGINT AS key FROM (SELECT key, unnest(range({n})) AS copy FROM ({keys}))"


def _quoted(s: str) -> str:
    return f"'{s}'"
