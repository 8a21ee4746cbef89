"""Seeded 64-bit xxHash as built-in expressions, and the unsigned arithmetic that filters need.

Spark's ``xxhash64(a, b)`` hashes ``b`` with the hash of ``a`` as its seed, and the hash of one 8-byte number is
a bijection of that number.  So for each seed there is a number whose hash is that seed, and hashing the pair
is the seeded hash of the second column.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK = (1 << 64) - 1
#: The five odd multipliers of the 64-bit xxHash, and the seed that Spark's xxhash64 starts with.
P1 = 0x9E3779B185EBCA87
P2 = 0xC2B2AE3D27D4EB4F
P3 = 0x165667B19E3779F9
P4 = 0x85EBCA77C2B2AE63
P5 = 0x27D4EB2F165667C5
SPARK_SEED = 42


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _rotate(x: int, by: int) -> int:
    return ((x << by) | (x >> (64 - by))) & MASK


def _unshift(x: int, by: int) -> int:
    """The y with y ^ (y >> by) == x."""
    y = x
    for _ in range(64 // by):
        y = x ^ (y >> by)
    return y


def seed_number(seed: int) -> int:
    """The signed 64-bit number whose hash, from Spark's own seed, is ``seed``: the hash of a long run backwards."""
    h = _unshift(seed & MASK, 32)
    h = _unshift(h * pow(P3, -1, 1 << 64) & MASK, 29)
    h = _unshift(h * pow(P2, -1, 1 << 64) & MASK, 33)
    h = _rotate((h - P4) * pow(P1, -1, 1 << 64) & MASK, 64 - 27)
    h ^= SPARK_SEED + P5 + 8 & MASK
    h = _rotate(h * pow(P1, -1, 1 << 64) & MASK, 64 - 31)
    return _signed(h * pow(P2, -1, 1 << 64) & MASK)


def xxh64(item: Column | str, seed: int | Column) -> Column:
    """Seeded xxHash of a string or binary column as a signed long.  A seed column holds ``seed_number`` values."""
    item = F.col(item) if isinstance(item, str) else item
    seed = F.lit(seed_number(seed)).cast("long") if isinstance(seed, int) else seed
    return F.xxhash64(seed, item)


def unsigned_mod(h: Column, m: Column | int) -> Column:
    """A hash read as an unsigned number, modulo ``m``; exact for m below 2^31."""
    m = F.lit(m).cast("long") if isinstance(m, int) else m.cast("long")
    wrap = F.pmod((F.pmod(F.lit((1 << 63) - 1), m) + 1) * 2, m)
    return F.pmod(F.pmod(h, m) + F.when(h < 0, wrap).otherwise(F.lit(0)), m)


def unsigned_less(h: Column, bound: Column | int) -> Column:
    """h < bound for signed longs read as unsigned ones."""
    flip = F.lit(-(1 << 63)).cast("long")
    bound = F.lit(bound).cast("long") if isinstance(bound, int) else bound
    return h.bitwiseXOR(flip) < bound.bitwiseXOR(flip)


def activation_bound(p: float) -> int:
    """The smallest unsigned h with h / (2^64 - 1) >= p, as a signed long: hashes below it are activated."""
    lo, hi = 0, MASK
    while lo < hi:
        mid = (lo + hi) // 2
        if mid / MASK >= p:
            hi = mid
        else:
            lo = mid + 1
    return _signed(lo)
