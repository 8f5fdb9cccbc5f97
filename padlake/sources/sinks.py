"""Where results go: reports of bucket statistics and logs of cost events."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@contextmanager
def timed(seconds: dict[str, float], stage: str) -> Iterator[None]:
    """Adds the seconds of what is run within to those of ``stage``."""
    began = time.monotonic()
    try:
        yield
    finally:
        seconds[stage] = seconds.get(stage, 0.0) + time.monotonic() - began


def write_cost_log(events: DataFrame, path: str, seconds: dict[str, float] | None = None) -> None:
    """The events as lines of text, in one folder, replacing what was there: stage, kind, size.

    With ``seconds`` a line ``total`` for each kind and one for all kinds comes after them, and a line for each stage's
    seconds and one for their sum.
    """
    line = lambda *parts: F.concat_ws("\t", *[p.cast("string") for p in parts]).alias("value")
    kinds = events.rollup("kind").agg(F.sum("size").cast("long").alias("size"))
    lines = events.select(line(F.col("stage"), F.col("kind"), F.col("size")))
    if seconds is not None:
        lines = lines.union(kinds.where("size IS NOT NULL").select(line(F.lit("total"), F.coalesce("kind", F.lit("all")), F.col("size"))))
        times = [*seconds.items(), ("total", sum(seconds.values()))]
        lines = lines.union(events.sparkSession.createDataFrame([(f"{stage}\tseconds\t{s:.4f}",) for stage, s in times], "value string"))
    lines.write.mode("overwrite").text(path)


def report(name: str, summary: DataFrame, seconds: float | None = None) -> str:
    """A line of text on a bucket summary, whose one row is all that comes to the driver, and on how long it took."""
    r = summary.first()
    ratio = "-" if r.ratio is None else f"{r.ratio:.2f}x"
    size = "-" if r.mean_size is None else f"{r.mean_size:.1f}"
    took = "" if seconds is None else f", {seconds:.4f} s"
    return f"{name}: {r.n_buckets} buckets, {r.n_empty} empty, {r.n_real} real rows, {r.n_dummy} dummies, {ratio}, {size} rows a bucket{took}"


def join_report(name: str, summary: DataFrame, rows: DataFrame, seconds: float | None = None) -> str:
    """As report, with the first real row that comes."""
    sample = rows.limit(1).collect()
    return f"{report(name, summary, seconds)}; sample: {sample[0].asDict() if sample else 'none'}"
