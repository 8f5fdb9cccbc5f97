"""Profiles of tables: per column, per table, where extremes are, and densities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _numeric(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def profile(df: DataFrame) -> DataFrame:
    """(column, is_numeric, n_rows, n_distinct, low, high) of every column, in one aggregation; rows include nulls, distinct values don't.

    Exact distinct counts of many columns expand the rows once for each; for huge tables pass a projection.
    """
    numeric = set(_numeric(df))
    facts = [F.count("*").alias("n")]
    for k, c in enumerate(df.columns):
        facts.append(F.count_distinct(F.col(c)).alias(f"d{k}"))
        if c in numeric:
            facts += [F.min(c).cast("double").alias(f"l{k}"), F.max(c).cast("double").alias(f"h{k}")]
    none = F.lit(None).cast("double")
    rows = [F.struct(F.lit(c).alias("column"), F.lit(c in numeric).alias("is_numeric"), F.col("n").alias("n_rows"), F.col(f"d{k}").alias("n_distinct"),
                     (F.col(f"l{k}") if c in numeric else none).alias("low"), (F.col(f"h{k}") if c in numeric else none).alias("high")) for k, c in enumerate(df.columns)]
    return df.agg(*facts).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def table_summary(df: DataFrame, name: str) -> DataFrame:
    """One row (name, n_rows, n_columns, n_numeric, n_other)."""
    k = len(_numeric(df))
    return df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).cast("long").alias("n_columns"), F.lit(k).cast("long").alias("n_numeric"), F.lit(len(df.columns) - k).cast("long").alias("n_other"))


def extreme_locations(df: DataFrame, column: str, row: str, most: int = 5) -> DataFrame:
    """(extreme, value, n_rows, first_rows): smallest and largest value, how often, and the first rows that have it.

    ``row`` numbers the rows from 0, captured when they were read: a DataFrame has no order of its own.
    """
    if column not in df.columns:
        raise ValueError(f"no column {column}")
    if column not in _numeric(df):
        raise TypeError(f"{column} isn't numeric")
    ends = df.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    found = df.select(column, F.col(row).cast("long").alias("row")).crossJoin(F.broadcast(ends)).where((F.col(column) == F.col("low")) | (F.col(column) == F.col("high")))
    sides = F.array(*[F.when(F.col(column) == F.col(c), F.lit(n)) for c, n in (("low", "min"), ("high", "max"))])
    each = found.select(F.explode(sides).alias("extreme"), F.col(column).cast("double").alias("value"), "row").where("extreme IS NOT NULL")
    ranked = each.groupBy("extreme", "value").agg(F.count("*").alias("n_rows"))
    order = Window.partitionBy("extreme").orderBy("row")
    first = each.withColumn("at", F.row_number().over(order)).where(F.col("at") <= most).groupBy("extreme").agg(F.array_join(F.array_sort(F.collect_list("row")).cast("array<string>"), ",").alias("first_rows"))
    return ranked.join(first, "extreme")


def density(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """(bin, cnt) of ``bins`` equal bins between the column's extremes, nulls left out; the last has its right edge. Bins without rows have none."""
    x = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL")
    ends = x.agg(F.min("x").alias("low"), F.max("x").alias("high"))
    where = F.when(F.col("high") == F.col("low"), F.lit(0)).otherwise(F.least(F.floor((F.col("x") - F.col("low")) * bins / (F.col("high") - F.col("low"))), F.lit(bins - 1)))
    return x.crossJoin(F.broadcast(ends)).groupBy(where.cast("long").alias("bin")).agg(F.count("*").alias("cnt"))
