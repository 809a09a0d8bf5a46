"""Random numbers that depend on their place alone, distributions over them, and rounding.

A cell's random number is a function of (seed, table, column, row key, draw), so any
partitioning, retry or engine gives the same value. Each function has a ``_sql`` twin
in DuckDB's dialect, for oracles.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """Round to an integer, halves upwards."""
    return F.floor(x + 0.5)


def places(x: Column, digits: int) -> Column:
    """Round to so many digits, halves upwards."""
    return F.floor(x * 10**digits + 0.5) / 10**digits


def places_sql(x: str, digits: int) -> str:
    return f"(floor(({x}) * {10**digits} + 0.5) / {10**digits})"


def uniform(seed: int, table: str, column: str, row: Column, draw: int = 0) -> Column:
    """Uniform in [0, 1): 32 bits of the MD5 of its place."""
    place = F.concat_ws("|", F.lit(str(seed)), F.lit(table), F.lit(column), row.cast("string"), F.lit(str(draw)))
    return F.conv(F.substring(F.md5(place), 1, 8), 16, 10).cast("double") / 4294967296.0


def uniform_sql(seed: int, table: str, column: str, row: str, draw: int = 0) -> str:
    return f"(('0x' || substr(md5('{seed}|{table}|{column}|' || ({row}) || '|{draw}'), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"


def normal(u1: Column, u2: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Box-Muller."""
    return mean + sd * F.sqrt(-2 * F.log(F.greatest(u1, F.lit(1e-10)))) * F.cos(2 * math.pi * u2)


def normal_sql(u1: str, u2: str, mean: float = 0.0, sd: float = 1.0) -> str:
    return f"({mean}::DOUBLE + {sd}::DOUBLE * sqrt(-2 * ln(greatest({u1}, 1e-10))) * cos(2 * {math.pi!r}::DOUBLE * {u2}))"


def bounded(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def lognormal(u1: Column, u2: Column, mu: float, sigma: float) -> Column:
    return F.exp(normal(u1, u2, mu, sigma))


def lognormal_of(mean: float, sd: float) -> tuple[float, float]:
    """mu and sigma of the lognormal with this mean and standard deviation."""
    sigma2 = math.log(1 + (sd / mean) ** 2)
    return math.log(mean) - sigma2 / 2, math.sqrt(sigma2)


def exponential(u: Column, rate: float) -> Column:
    return -F.log(F.greatest(u, F.lit(1e-10))) / rate


def weibull(u: Column, shape: float, scale: float) -> Column:
    return scale * F.pow(-F.log(1 - u), F.lit(1 / shape))


def gamma(us: list[Column], scale: float) -> Column:
    """Of integer shape: a sum of one exponential for each draw."""
    return scale * sum((-F.log(F.greatest(u, F.lit(1e-10))) for u in us), F.lit(0.0))


def zipf_cumulative(n: int, s: float) -> list[float]:
    weights = [1 / k**s for k in range(1, n + 1)]
    total, at, out = sum(weights), 0.0, []
    for w in weights:
        at += w
        out.append(at / total)
    return out


def zipf(u: Column, n: int, s: float) -> Column:
    """Rank 1 to n of chance proportional to rank ** -s."""
    steps = F.array(*(F.lit(c) for c in zipf_cumulative(n, s)[:-1]))
    return (F.size(F.filter(steps, lambda c: c <= u)) + 1).cast("int")


def poisson_cumulative(mean: float) -> list[float]:
    """Chances of at most 0, 1, 2, ... events, to twelve standard deviations above the mean."""
    chance, at, out = math.exp(-mean), 0.0, []
    for k in range(int(mean + 12 * math.sqrt(mean) + 12)):
        at += chance
        out.append(at)
        chance *= mean / (k + 1)
    return out


def poisson(u: Column, mean: float) -> Column:
    """By the inverse cumulative distribution."""
    return F.size(F.filter(F.array(*map(F.lit, poisson_cumulative(mean))), lambda c: c <= u)).cast("int")


def long_tail(u: Column, low: int, high: int, skew: float = 2.0) -> Column:
    return F.floor(low + F.pow(u, F.lit(skew)) * (high - low)).cast("int")


def integer(u: Column, low: int, high: int) -> Column:
    """Uniform from low to high, both included."""
    return (low + F.floor(u * (high - low + 1))).cast("int")


def choice(u: Column, values: list) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (F.floor(u * len(values)) + 1).cast("int"))


def weighted(u: Column, weights: dict) -> Column:
    """A value by weight; the last one takes what rounding leaves."""
    total, at, out = float(sum(weights.values())), 0.0, None
    items = list(weights.items())
    for value, weight in items[:-1]:
        at += weight / total
        out = F.when(u < at, F.lit(value)) if out is None else out.when(u < at, F.lit(value))
    return F.lit(items[-1][0]) if out is None else out.otherwise(F.lit(items[-1][0]))


def weighted_sql(u: str, weights: dict) -> str:
    total, at, parts = float(sum(weights.values())), 0.0, []
    items = list(weights.items())
    for value, weight in items[:-1]:
        at += weight / total
        parts.append(f"WHEN {u} < {at!r}::DOUBLE THEN '{value}'")
    return f"CASE {' '.join(parts)} ELSE '{items[-1][0]}' END" if parts else f"'{items[0][0]}'"


def mulberry(seed: int, n: Column) -> Column:
    """Draw ``n`` (from 1) of the 32-bit mulberry generator: its state is seed + n * 0x6D2B79F5, so any draw is direct."""
    mask = F.lit(0xFFFFFFFF)

    def times(a: Column, b: Column) -> Column:
        # 32-bit product by 16-bit halves, which never leave 64 bits.
        low = a.bitwiseAND(F.lit(0xFFFF)) * b
        high = (F.shiftrightunsigned(a, 16) * b).bitwiseAND(F.lit(0xFFFF)) * 65536
        return (low.bitwiseAND(mask) + high).bitwiseAND(mask)

    state = (F.lit(seed) + times(n.cast("long"), F.lit(0x6D2B79F5).cast("long"))).bitwiseAND(mask)
    t = times(state.bitwiseXOR(F.shiftrightunsigned(state, 15)), state.bitwiseOR(F.lit(1)))
    t = t.bitwiseXOR((t + times(t.bitwiseXOR(F.shiftrightunsigned(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(mask))
    return t.bitwiseXOR(F.shiftrightunsigned(t, 14)) / 4294967296.0
