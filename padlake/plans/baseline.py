"""The published synthetic experiments at their sizes, for the benchmark: clustered keys in a domain of a million."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from padlake.functions.metadata import PRESETS
from padlake.functions.noise import ShiftedGeometric
from padlake.operators.bucket import buckets
from padlake.operators.frequency import key_freq, keyed, multi_key_max_freq
from padlake.operators.held import held
from padlake.operators.partition import PrivateScan, private_parts_precut
from padlake.plans.routes import SOURCE, Route
from padlake.sources import generators

DOMAIN = 1_000_000


def _freq(df: DataFrame, column: str) -> DataFrame:
    return key_freq(keyed(df, F.col(column), DOMAIN))


def same_key(spark: SparkSession, route: str) -> DataFrame:
    """Three tables of one key, 100k, 80k and 60k rows; route: a, b or c."""
    kind = {"a": "pipelined", "b": "repartitioned", "c": "uniform"}[route]
    budget, merges = PRESETS[f"same_key_{route}"]
    tables = generators.same_key_tables(spark, DOMAIN, 100_000, 80_000, 60_000)
    run = Route(f"same_key_{route}", kind, budget, merges, DOMAIN).same_key({n: _freq(t, "Key") for n, t in zip("ABC", tables)})
    return run.side.buckets


def fk(spark: SparkSession) -> DataFrame:
    """The chain T1(A, B), T2(B, C), T3(C, D) on B, then on C, 100k, 80k and 60k rows."""
    budget, merges = PRESETS["fk"]
    t1, t2, t3 = generators.fk_tables(spark, DOMAIN, 100_000, 80_000, 60_000)
    first, t2 = _freq(t1, "B"), held(t2)

    def rekey(joined: DataFrame) -> DataFrame:
        kept = t2.join(first.withColumnsRenamed({"key": "B", "freq": "times"}), "B")
        return kept.groupBy(F.col("C").alias("key")).agg(F.sum("times").cast("long").alias("freq"))

    route = Route("fk", "repartitioned", budget, merges, DOMAIN)
    return route.chain(first, _freq(t2, "B"), _freq(t3, "C"), rekey, multi_key_max_freq(t2, [F.col("B"), F.col("C")])).side.buckets


def two_way_uniform(spark: SparkSession) -> DataFrame:
    """Two tables, 100k and 80k rows, equal intervals."""
    budget, merges = PRESETS["two_way_c"]
    tables = generators.same_key_tables(spark, DOMAIN, 100_000, 80_000)
    return Route("two_way_c", "uniform", budget, merges, DOMAIN, True).same_key({n: _freq(t, "Key") for n, t in zip("AB", tables)}).side.buckets


def partition_and_pad(spark: SparkSession, domain: int = 100_000_000, rows: int = 1_000_000, eps: float = 1.0, delta: float = 1e-9, pieces: int = 8) -> DataFrame:
    """A million rows in a domain of 10**8, private intervals by the clamped scan, in pieces side by side, and padding; half the budget for each."""
    f = held(key_freq(keyed(generators.clustered_keys(spark, domain, rows), F.col("key"), domain)))
    scan = PrivateScan.clamped(eps / 2, delta / 2, domain)
    parts = private_parts_precut(f, scan, SOURCE, "large", pieces)
    return buckets(f, parts, domain, ShiftedGeometric(eps / 2, delta / 2), SOURCE, "large")


EXPERIMENTS = {
    "partition_and_pad": partition_and_pad,
    "synthetic_fk": fk,
    "synthetic_same_key_a": lambda spark: same_key(spark, "a"),
    "synthetic_same_key_b": lambda spark: same_key(spark, "b"),
    "synthetic_same_key_c": lambda spark: same_key(spark, "c"),
    "synthetic_two_way_c": two_way_uniform,
}
