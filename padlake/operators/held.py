"""What a run uses several times: histograms are kept in memory until the next run, metadata is written out."""

from __future__ import annotations

from pyspark import SparkContext
from pyspark.sql import DataFrame

from padlake.sources.scratch import shared_folder

_held: list[DataFrame] = []


def held(df: DataFrame) -> DataFrame:
    """``df``, cached until ``release``. What is evaluated after that is computed anew, to the same values: noise is keyed."""
    df = df.cache()
    _held.append(df)
    return df


def release() -> None:
    """Gives back what earlier runs of the live session hold."""
    while _held:
        df = _held.pop()
        if df.sparkSession.sparkContext is SparkContext._active_spark_context:
            df.unpersist()


def cut(df: DataFrame) -> DataFrame:
    """Interval lists, written to the shared checkpoint folder: each is used several times by what follows, whose plan would grow with every step."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
