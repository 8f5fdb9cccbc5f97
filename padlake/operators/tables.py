"""A keyed table with what is public about it, and plain joins of tables or files."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from padlake.functions.noise import Keyed, ShiftedGeometric
from padlake.operators.frequency import key_freq, max_freq


@dataclass(frozen=True)
class Table:
    """``rows`` have a long ``key`` in [1, domain]; a person changes at most ``sensitivity`` rows."""

    name: str
    rows: DataFrame
    domain: int
    sensitivity: int = 1

    def true_max_freq(self) -> int:
        """0 for an empty table."""
        return max_freq(key_freq(self.rows)).first().max_freq

    def noisy_max_freq(self, eps: float, delta: float, source: Keyed) -> int:
        """The true one plus shifted geometric noise of the table's sensitivity: never below the truth but for a chance of delta."""
        m = ShiftedGeometric(eps, delta, self.sensitivity)
        return self.true_max_freq() + m.noise_value(source.value("table", self.name, "u"), source.value("table", self.name, "v"))


def join_tables(left: DataFrame, right: DataFrame, key: str, left_where: dict[str, object] | None = None, right_where: dict[str, object] | None = None, how: str = "inner", null_keys_match: bool = False) -> DataFrame:
    """An equi-join of filtered tables; columns that both have get _x and _y.

    Null keys match nothing, as in SQL, or each other with ``null_keys_match``, as data frames in memory have it. How
    many rows there are is ``count()`` of the result.
    """
    filtered = lambda df, where: reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), (where or {}).items(), df)
    left, right = filtered(left, left_where), filtered(right, right_where)
    both = [c for c in left.columns if c in right.columns and c != key]
    left, right = left.withColumnsRenamed({c: f"{c}_x" for c in both}), right.withColumnsRenamed({c: f"{c}_y" for c in both})
    if not null_keys_match:
        return left.join(right, key, how)
    right = right.withColumnRenamed(key, "__key")
    joined = left.join(right, left[key].eqNullSafe(right["__key"]), how)
    rest = [c for c in joined.columns if c not in (key, "__key")]
    return joined.select(F.coalesce(key, "__key").alias(key), *rest)
