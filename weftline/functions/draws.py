"""Distributions over uniform draws, as expressions."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ranks of a Zipf distribution that are kept one by one; beyond, its tail is inverted in closed form.
MAX_RANKS = 20_000


def integer(u: Column, low: int, high: int) -> Column:
    """Uniform from low to high, both included."""
    return (F.floor(u * F.lit(float(high - low + 1))) + F.lit(low)).cast("long")


def number(u: Column, low: float, high: float) -> Column:
    return u * F.lit(float(high) - float(low)) + F.lit(float(low))


def pick(u: Column, values: list) -> Column:
    """Uniform from a short list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.floor(u * F.lit(float(len(values)))) + 1).cast("int"))


def weighted(u: Column, shares: dict) -> Column:
    """The first value whose running share is above u."""
    total, out, runs = float(sum(shares.values())), None, list(accumulate(shares.values()))
    for value, upto in list(zip(shares, runs, strict=True))[::-1]:
        out = F.lit(value) if out is None else F.when(u < F.lit(upto / total), F.lit(value)).otherwise(out)
    return out


def normal(u1: Column, u2: Column, mean: float = 0.0, sd: float = 1.0) -> Column:
    """Box-Muller."""
    return F.sqrt(F.lit(-2.0) * F.ln(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2) * F.lit(float(sd)) + F.lit(float(mean))


def exponential(u: Column, rate: float = 1.0) -> Column:
    return -F.ln(F.lit(1.0) - u) / F.lit(float(rate))


def zipf_shares(n: int, s: float) -> list[float]:
    """P(rank <= k) for k = 1 .. n."""
    runs = list(accumulate(1.0 / k**s for k in range(1, n + 1)))
    return [x / runs[-1] for x in runs]


def zipf(u: Column, n: int, s: float = 1.0) -> Column:
    """The first rank whose running share is at least u: by binary search in a constant array, of any number of ranks.

    The weights of ranks m + 1 to k beyond the array are the integral of x^-s from m + 1/2 to k + 1/2, right to 1 / (24 m^(s + 1)).
    """
    m = min(n, MAX_RANKS)
    head = sum(1.0 / k**s for k in range(1, m + 1))
    area = lambda a, b: math.log(b / a) if s == 1 else (b ** (1 - s) - a ** (1 - s)) / (1 - s)
    total = head + (area(m + 0.5, n + 0.5) if n > m else 0.0)
    shares = F.lit([x * head / total for x in zipf_shares(m, s)]) if m > 1 else F.array(F.lit(1.0))
    steps = [1 << k for k in range(max(1, m.bit_length()) - 1, -1, -1)]
    below = F.aggregate(F.array(*[F.lit(x) for x in steps]), F.lit(0), lambda at, step: F.when(F.coalesce(F.get(shares, at + step - 1) < u, F.lit(False)), at + step).otherwise(at))
    if n == m:
        return F.least(below + 1, F.lit(n)).cast("long")
    rest = u * F.lit(total) - F.lit(head)
    end = F.exp(rest) * F.lit(m + 0.5) if s == 1 else F.pow(rest * F.lit(1 - s) + F.lit((m + 0.5) ** (1 - s)), F.lit(1 / (1 - s)))
    far = F.greatest(F.lit(m + 1).cast("long"), F.least(F.ceil(end - 0.5).cast("long"), F.lit(n).cast("long")))
    return F.when(rest > 0, far).otherwise((below + 1).cast("long"))


def clamp(value: Column, low=None, high=None) -> Column:
    if low is not None:
        value = F.greatest(value, F.lit(low))
    return value if high is None else F.least(value, F.lit(high))
