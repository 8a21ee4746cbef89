"""Sizes of filters and their expected false-positive rates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def optimal_size(n: Column, p: Column) -> Column:
    """Bits for ``n`` elements at false-positive rate ``p``: ceil(-n ln p / (ln 2)^2)."""
    return F.ceil(-n * F.log(p) / F.pow(F.log(F.lit(2.0)), F.lit(2.0)))


def integer_hash_count(m: Column, n: Column) -> Column:
    """max(1, round half to even of m/n ln 2)."""
    return F.greatest(F.lit(1), F.bround(m / n * F.log(F.lit(2.0))).cast("int"))


def rational_hash_count(m: Column, n: Column) -> Column:
    """max(0.1, m/n ln 2)."""
    return F.greatest(F.lit(0.1), m / n * F.log(F.lit(2.0)))


def standard_rate(m: Column, n: Column, k: Column) -> Column:
    """(1 - e^(-kn/m))^k."""
    return F.pow(1 - F.exp(-k * n / m), k)


def rational_rate(m: Column, n: Column, k: Column) -> Column:
    """f^floor(k) (1 - (1 - f) frac(k)) with f = 1 - e^(-kn/m)."""
    f = 1 - F.exp(-k * n / m)
    return F.pow(f, F.floor(k).cast("double")) * (1 - (1 - f) * (k - F.floor(k)))


def rational_rate_simple(m: Column, n: Column, k: Column) -> Column:
    """(1 - e^(-kn/m))^k with fractional k."""
    return standard_rate(m, n, k)


def rational_rate_split(m: Column, n: Column, k: Column) -> Column:
    """(1 - e^(-floor(k) n/m))^floor(k) (1 - e^(-n/m))^frac(k)."""
    whole = F.floor(k).cast("double")
    return F.pow(1 - F.exp(-whole * n / m), whole) * F.pow(1 - F.exp(-n / m), k - whole)


def improvement_percent(before: Column, after: Column) -> Column:
    """(before - after) / before in percent; null where before is 0."""
    return F.when(before > 0, (before - after) / before * 100)
