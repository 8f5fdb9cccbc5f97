"""Join metadata (a bound on key frequency, a sensitivity), how joins combine it, and how budgets are split."""

from __future__ import annotations

from dataclasses import dataclass

from padlake.functions.noise import Keyed, ShiftedGeometric


@dataclass(frozen=True)
class JoinMeta:
    a: int
    b: int = 1

    @classmethod
    def of_frequency(cls, max_freq: int | None, eps: float, delta: float, source: Keyed, tag: str) -> JoinMeta:
        """From the largest key frequency, noisily; (1, 1) for an empty table."""
        if not max_freq:
            return cls(1, 1)
        m = ShiftedGeometric(eps, delta)
        return cls(max(1, max_freq + m.two_sided_value(source.value("meta", tag, "u"), source.value("meta", tag, "v")) + m.k0), 1)

    def join(self, other: JoinMeta) -> JoinMeta:
        return JoinMeta(self.a * other.a, max(self.a * other.b, other.a * self.b))


def meta_sql(max_freq: str, eps: float, delta: float, source: Keyed, tag: str) -> str:
    """``a`` of a table as SQL, from an expression of its largest frequency."""
    m = ShiftedGeometric(eps, delta)
    noise = m.two_sided_sql(source.sql("'meta'", f"'{tag}'", "'u'"), source.sql("'meta'", f"'{tag}'", "'v'"))
    return f"CASE WHEN coalesce({max_freq}, 0) = 0 THEN 1 ELSE greatest(1, {max_freq} + {noise} + {m.k0}) END::BIGINT"


@dataclass(frozen=True)
class Budget:
    """eps and delta of a run: a share for metadata, the rest in equal shares."""

    eps: float
    delta: float
    meta_share: float
    shares: int

    @property
    def meta(self) -> tuple[float, float]:
        return self.eps * self.meta_share, self.delta * self.meta_share

    @property
    def stage(self) -> tuple[float, float]:
        return (self.eps - self.meta[0]) / self.shares, (self.delta - self.meta[1]) / self.shares


#: How each experiment splits its budget, and the intersections that make a batch.
PRESETS = {
    "two_way_a": (Budget(1.5, 1e-6, 0.50, 5), (2,)),
    "two_way_c": (Budget(1.5, 1e-6, 0.50, 3), (1,)),
    "fk": (Budget(1.0, 1e-6, 0.50, 6), (2, 3)),
    "same_key_a": (Budget(1.0, 1e-6, 0.50, 4), (2, 3)),
    "same_key_b": (Budget(1.0, 1e-6, 0.50, 6), (2, 3)),
    "same_key_c": (Budget(1.0, 1e-6, 0.50, 3), (1, 1)),
    "four_way": (Budget(1.0, 1e-6, 0.80, 7), (2, 3, 4)),
    "q3": (Budget(1.5, 1e-4, 0.80, 3), (2,)),
    "q5_a": (Budget(1.5, 1e-5, 0.65, 5), (2, 3)),
    "q5_b": (Budget(1.5, 1e-5, 0.50, 6), (2, 3)),
    "q5_c": (Budget(1.5, 1e-6, 0.50, 3), (1, 1)),
    "q6_a": (Budget(1.0, 1e-6, 0.50, 5), (2, 3)),
    "q6_b": (Budget(1.0, 1e-6, 0.50, 6), (2, 3)),
    "q6_c": (Budget(1.0, 1e-6, 0.50, 3), (1, 1)),
    "count_two_way": (Budget(1.0, 1e-6, 0.0, 5), (1,)),
    "count_three_way": (Budget(1.0, 1e-6, 0.90, 4), (2, 3)),
}
