"""Every query of the engine and the SQL it must equal."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from padlake.operators.held import release
from padlake.plans import join_queries, private_queries, source_queries, synopsis_queries, workload

PARTS = (workload, private_queries, join_queries, synopsis_queries, source_queries)


def _fresh(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """``f``, which first gives back what the query before it has kept in memory."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        release()
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _fresh(f) for part in PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLE.items()}
