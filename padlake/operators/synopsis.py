"""Histograms of a numeric column and the private synopses made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from padlake.functions.noise import Keyed, exponential, negative_synopsis_noise, synopsis_noise, synopsis_noise_sql

BINS = 8


def count_where(df: DataFrame, column: str, value: object) -> DataFrame:
    """One row (n): rows whose column equals the value; null never does."""
    return df.where(F.col(column) == F.lit(value)).agg(F.count("*").alias("n"))


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """(bin, lo_edge, hi_edge, cnt): ``bins`` bins of whole-number width from the column's truncated minimum.

    The width is the range of the truncated extremes over ``bins``, rounded up; the last bin has its right edge, and
    values beyond that edge are in none. Empty bins have a row. A column of one value has it in the last bin.
    """
    x = df.select(F.col(column).cast("double").alias("x")).where("x IS NOT NULL AND NOT isnan(x)")
    edges = x.agg(F.min("x").cast("long").alias("low"), F.max("x").cast("long").alias("high"))
    edges = edges.where("low IS NOT NULL").select("low", F.ceil((F.col("high") - F.col("low")) / F.lit(bins)).cast("long").alias("width"))
    last = F.col("low") + F.col("width") * bins
    where = F.when(F.col("width") == 0, F.when(F.col("x") == F.col("low"), bins - 1)).when(F.col("x") == last, bins - 1).when((F.col("x") >= F.col("low")) & (F.col("x") < last), F.floor((F.col("x") - F.col("low")) / F.col("width")))
    counts = x.crossJoin(F.broadcast(edges)).groupBy(where.cast("long").alias("bin")).agg(F.count("*").alias("cnt"))
    every = edges.select("low", "width", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    return every.join(counts, "bin", "left").select("bin", (F.col("low") + F.col("bin") * F.col("width")).alias("lo_edge"), (F.col("low") + (F.col("bin") + 1) * F.col("width")).alias("hi_edge"), F.coalesce("cnt", F.lit(0)).cast("long").alias("cnt"))


def _uniforms(source: Keyed, tag: str, what: str) -> tuple[Column, Column]:
    return source.column(what, tag, F.col("bin"), "u"), source.column(what, tag, F.col("bin"), "v")


def noisy_histogram(hist: DataFrame, e: float, source: Keyed, tag: str) -> DataFrame:
    """(bin, cnt) with positive noise on every bin."""
    return hist.select("bin", (F.col("cnt") + synopsis_noise(*_uniforms(source, tag, "hist"), e)).alias("cnt"))


def noisy_histogram_negative(hist: DataFrame, e: float, source: Keyed, tag: str) -> DataFrame:
    """(bin, cnt) with negative noise on every bin, at least 0."""
    return hist.select("bin", F.greatest(F.col("cnt") + negative_synopsis_noise(*_uniforms(source, tag, "neg"), e), F.lit(0)).alias("cnt"))


def dp_indexes(hist: DataFrame, noisy: DataFrame) -> DataFrame:
    """(bin, lo, hi): positions of each bin in sorted order, from sums of noisy counts before and after it, within the true total."""
    total = hist.agg(F.sum("cnt").alias("c"))
    order = Window.orderBy("bin")
    up, down = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(0, Window.unboundedFollowing)
    return noisy.crossJoin(F.broadcast(total)).select("bin", F.greatest(F.col("c") - F.sum("cnt").over(down), F.lit(0)).alias("lo"), F.least(F.sum("cnt").over(up), F.col("c")).alias("hi"))


def cdf_indexes(positive: DataFrame, negative: DataFrame) -> DataFrame:
    """(bin, lo, hi): from the sums of the negative histogram before a bin and of the positive one up to it."""
    order = Window.orderBy("bin")
    up, before = order.rowsBetween(Window.unboundedPreceding, 0), order.rowsBetween(Window.unboundedPreceding, -1)
    total = positive.agg(F.sum("cnt").alias("c"))
    both = positive.crossJoin(F.broadcast(total)).join(negative.withColumnRenamed("cnt", "neg"), "bin")
    return both.select("bin", F.coalesce(F.sum("neg").over(before), F.lit(0)).alias("lo"), F.least(F.sum("cnt").over(up), F.col("c")).alias("hi"))


def noisy_max_frequency(df: DataFrame, column: str, e: float, source: Keyed, tag: str) -> DataFrame:
    """One row (max_freq): the largest frequency of a value, plus exponential noise, cut to a whole number. Noise comes after the maximum, as published."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("freq"))
    return counts.agg(F.max("freq").alias("m")).select(F.floor(F.coalesce("m", F.lit(0)) + exponential(source.column("maxfreq", tag), e)).cast("long").alias("max_freq"))


def synopsis(df: DataFrame, column: str, e: float, source: Keyed, tag: str, bins: int = BINS) -> DataFrame:
    """(bin, positive, negative, lo, hi, max_freq): the whole synopsis of a column; the table is scanned for its histogram and for its frequencies."""
    hist = histogram(df, column, bins)
    positive, negative = noisy_histogram(hist, e, source, tag), noisy_histogram_negative(hist, e, source, tag)
    indexes = cdf_indexes(positive, negative)
    both = positive.withColumnRenamed("cnt", "positive").join(negative.withColumnRenamed("cnt", "negative"), "bin").join(indexes, "bin")
    return both.crossJoin(F.broadcast(noisy_max_frequency(df, column, e, source, tag)))


# The same as DuckDB SQL


def histogram_sql(name: str, table: str, column: str, bins: int = BINS, where: str = "true") -> str:
    """Common table expressions that end in ``name`` (bin, lo_edge, hi_edge, cnt)."""
    return f"""
    {name}_x AS (SELECT {column}::DOUBLE AS x FROM {table} WHERE {column} IS NOT NULL AND {where}),
    {name}_edges AS (SELECT trunc(min(x))::BIGINT AS low, ceil((trunc(max(x)) - trunc(min(x))) / {bins})::BIGINT AS width FROM {name}_x),
    {name}_bins AS (SELECT k::BIGINT AS bin, low + k * width AS lo_edge, low + (k + 1) * width AS hi_edge, width FROM {name}_edges, (SELECT unnest(range({bins})) AS k)),
    {name} AS (
        SELECT bin, lo_edge::BIGINT AS lo_edge, hi_edge::BIGINT AS hi_edge, count(x)::BIGINT AS cnt
        FROM {name}_bins LEFT JOIN {name}_x ON x >= lo_edge AND (x < hi_edge OR (bin = {bins - 1} AND x = hi_edge)) GROUP BY bin, lo_edge, hi_edge)"""


def noisy_sql(hist: str, e: float, source: Keyed, tag: str, negative: bool = False) -> str:
    what = "neg" if negative else "hist"
    u, v = (source.sql(f"'{what}'", f"'{tag}'", "bin", f"'{x}'") for x in "uv")
    n = f"cnt + {synopsis_noise_sql(u, v, e, negative)}"
    return f"SELECT bin, {f'greatest({n}, 0)' if negative else n} AS cnt FROM {hist}"


CDF_SQL = """SELECT p.bin, coalesce(sum(n.cnt) OVER (ORDER BY p.bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS lo,
    least(sum(p.cnt) OVER (ORDER BY p.bin), sum(p.cnt) OVER ())::BIGINT AS hi FROM pos p JOIN neg n ON p.bin = n.bin"""


def max_frequency_sql(table: str, column: str, e: float, source: Keyed, tag: str) -> str:
    return f"SELECT floor(max(f) + -ln({source.sql(_q('maxfreq'), _q(tag))}) / {float(e)!r})::BIGINT AS max_freq FROM (SELECT count(*) AS f FROM {table} WHERE {column} IS NOT NULL GROUP BY {column})"


def _q(s: str) -> str:
    return f"'{s}'"
