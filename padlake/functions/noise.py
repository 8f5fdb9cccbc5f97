"""Noise mechanisms: their parameters, samplers as Column expressions, and the same samplers as DuckDB SQL.

A sampler takes uniforms in (0, 1). Keyed uniforms are a hash of a salt and a tag, so that a release is drawn once
however often Spark evaluates it, and another engine can draw the same; they are for tests and simulation, for who knows
the salt knows the noise. ``secure_uniforms`` draws on the driver instead, once.
"""

from __future__ import annotations

import hashlib
import math
import secrets
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_SPAN = 2.0**52


def _checked(delta: float) -> float:
    if not 0 < delta < 1:
        raise ValueError(f"delta must lie between 0 and 1, not {delta}")
    return delta


@dataclass(frozen=True)
class Keyed:
    """Uniforms from a salt and a tag, as a Column, in Python and as SQL."""

    salt: str = "padlake"

    def column(self, *tag: Column | str) -> Column:
        parts = [F.lit(self.salt), *(t if isinstance(t, Column) else F.lit(t) for t in tag)]
        digits = F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 13)
        return (F.conv(digits, 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(_SPAN)

    def value(self, *tag: object) -> float:
        return (int(hashlib.md5("|".join([self.salt, *map(str, tag)]).encode()).hexdigest()[:13], 16) + 0.5) / _SPAN

    def sql(self, *tag: str) -> str:
        """``tag``: SQL expressions; a literal is given in quotes."""
        return f"((('0x' || substr(md5(concat_ws('|', '{self.salt}', {', '.join(tag)})), 1, 13))::BIGINT + 0.5) / {_SPAN})"


def secure_uniforms(spark: SparkSession, n: int) -> DataFrame:
    """(id, u): n uniforms of the operating system's source, drawn on the driver once."""
    rng = secrets.SystemRandom()
    return spark.createDataFrame([(k, rng.random() or 0.5) for k in range(n)], "id long, u double")


@dataclass(frozen=True)
class ShiftedGeometric:
    """Two-sided geometric noise, shifted to be positive and clamped to [0, upper]: the mass beyond piles up at the ends."""

    eps: float
    delta: float
    sens: int = 1

    def __post_init__(self):
        _checked(self.delta)

    @property
    def k0(self) -> int:
        return math.ceil(self.sens / self.eps * math.log(2 / self.delta))

    @property
    def shift(self) -> int:
        return self.k0 + self.sens - 1

    @property
    def upper(self) -> int:
        return 2 * self.shift

    @property
    def p(self) -> float:
        return 1 - math.exp(-self.eps / self.sens)

    def two_sided(self, u: Column, v: Column) -> Column:
        one = lambda x: F.ceil(-F.log(x) * F.lit(float(self.sens)) / F.lit(float(self.eps)))
        return (one(u) - one(v)).cast("bigint")

    def noise(self, u: Column, v: Column) -> Column:
        return F.least(F.greatest(F.lit(self.shift) + self.two_sided(u, v), F.lit(0)), F.lit(self.upper)).cast("bigint")

    def two_sided_value(self, u: float, v: float) -> int:
        return math.ceil(-math.log(u) * float(self.sens) / self.eps) - math.ceil(-math.log(v) * float(self.sens) / self.eps)

    def noise_value(self, u: float, v: float) -> int:
        return min(max(self.shift + self.two_sided_value(u, v), 0), self.upper)

    def two_sided_sql(self, u: str, v: str) -> str:
        return two_sided_sql(u, v, repr(float(self.sens)), self.eps)

    def noise_sql(self, u: str, v: str) -> str:
        return f"least(greatest({self.shift} + {self.two_sided_sql(u, v)}, 0), {self.upper})::BIGINT"


def two_sided_sql(u: str, v: str, sens: str, eps: float) -> str:
    return f"(ceil(-ln({u}) * {sens} / {float(eps)!r}) - ceil(-ln({v}) * {sens} / {float(eps)!r}))::BIGINT"


def shifted_geometric_sql(sens: str, eps: float, delta: float, u: str, v: str) -> str:
    """The noise of a ShiftedGeometric whose sensitivity is an SQL expression."""
    shift = f"(ceil({sens} / {float(eps)!r} * ln(2 / {delta!r}))::BIGINT + {sens} - 1)"
    return f"least(greatest({shift} + {two_sided_sql(u, v, sens, eps)}, 0), 2 * {shift})::BIGINT"


@dataclass(frozen=True)
class Laplace:
    eps: float
    sens: float = 1.0

    @property
    def scale(self) -> float:
        return self.sens / self.eps

    def tail_bound(self, beta: float) -> float:
        return self.scale * math.log(1 / _checked(beta))

    def noise(self, u: Column) -> Column:
        return F.lit(-float(self.scale)) * F.signum(u - 0.5) * F.log(1 - 2 * F.abs(u - 0.5))

    def value(self, u: float) -> float:
        return -self.scale * math.copysign(1, u - 0.5) * math.log(1 - 2 * abs(u - 0.5)) if u != 0.5 else 0.0

    def values(self, u: np.ndarray) -> np.ndarray:
        return -self.scale * np.sign(u - 0.5) * np.log(1 - 2 * np.abs(u - 0.5))

    def noise_sql(self, u: str, scale: str | None = None) -> str:
        """``scale``: SQL of another scale than the mechanism's own."""
        return f"(-{scale or repr(float(self.scale))} * sign({u} - 0.5) * ln(1 - 2 * abs({u} - 0.5)))"

    def seal(self, load: float, threshold: float) -> float:
        """The chance that noise lifts ``load`` over ``threshold``."""
        d = threshold - load
        return 0.5 * math.exp(-d / self.scale) if d >= 0 else 1 - 0.5 * math.exp(d / self.scale)

    def seal_column(self, load: Column, threshold: Column) -> Column:
        d, s = threshold - load, F.lit(float(self.scale))
        return F.least(F.greatest(F.when(d >= 0, 0.5 * F.exp(-d / s)).otherwise(1 - 0.5 * F.exp(d / s)), F.lit(0.0)), F.lit(1.0))

    def seal_sql(self, load: str, threshold: str) -> str:
        d, s = f"({threshold} - {load})", repr(float(self.scale))
        return f"least(greatest(CASE WHEN {d} >= 0 THEN 0.5 * exp(-{d} / {s}) ELSE 1 - 0.5 * exp({d} / {s}) END, 0.0), 1.0)"


@dataclass(frozen=True)
class BoundedLaplace(Laplace):
    """Laplace noise clamped to +-bound."""

    delta: float = 1e-6

    def __post_init__(self):
        _checked(self.delta)

    @property
    def bound(self) -> float:
        return self.scale * math.log(1 / self.delta) + self.sens

    def noise(self, u: Column) -> Column:
        return F.least(F.greatest(super().noise(u), F.lit(-self.bound)), F.lit(self.bound))

    def value(self, u: float) -> float:
        return min(max(super().value(u), -self.bound), self.bound)

    def values(self, u: np.ndarray) -> np.ndarray:
        return np.clip(super().values(u), -self.bound, self.bound)

    def noise_sql(self, u: str, scale: str | None = None) -> str:
        return f"least(greatest({super().noise_sql(u, scale)}, {-self.bound!r}), {self.bound!r})"

    def seal(self, load: float, threshold: float) -> float:
        d = threshold - load
        return 0.0 if d >= self.bound else 1.0 if d <= -self.bound else super().seal(load, threshold)


#: Fixed values of the synopsis noise.
SYNOPSIS_BASE, SYNOPSIS_SHIFT = 2.713, 7


def _synopsis_geometric(u: Column, e: float) -> Column:
    return F.greatest(F.ceil(F.log(u) / F.lit(-e * math.log(SYNOPSIS_BASE))), F.lit(1)).cast("bigint")


def synopsis_noise(u: Column, v: Column, e: float) -> Column:
    """Positive noise on a bin."""
    return F.abs(_synopsis_geometric(u, e) - _synopsis_geometric(v, e) + SYNOPSIS_SHIFT)


def negative_synopsis_noise(u: Column, v: Column, e: float) -> Column:
    return -F.abs(_synopsis_geometric(u, e) - _synopsis_geometric(v, e) - SYNOPSIS_SHIFT)


def synopsis_noise_sql(u: str, v: str, e: float, negative: bool = False) -> str:
    one = lambda x: f"greatest(ceil(ln({x}) / {-e * math.log(SYNOPSIS_BASE)!r}), 1)::BIGINT"
    return f"-abs({one(u)} - {one(v)} - {SYNOPSIS_SHIFT})" if negative else f"abs({one(u)} - {one(v)} + {SYNOPSIS_SHIFT})"


def exponential(u: Column, e: float) -> Column:
    return -F.log(u) / F.lit(float(e))


def geometric_steps(u: float, p: float) -> int:
    """Trials until the first success, at least one."""
    if p >= 1:
        return 1
    return max(1, math.ceil(math.log(u) / (math.log(1 - p) if 1 - p < 1 else -p)))
