import pytest
import xxhash
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sieveline.functions import hashing as H

WORDS = ["", "0", "7", "12", "999", "1234", "1000000", "abcdefgh", "é" * 5, "x" * 31, "y" * 32, "z" * 33, "long " * 500]
SEEDS = [0, 1, 2, 3, 17, 999, 0x12345678, 0x87654321, (1 << 63) + 5]


@pytest.mark.parametrize("seed", SEEDS)
def test_seeded_hash_is_xxhash(spark, seed):
    got = spark.createDataFrame([(w,) for w in WORDS], "w string").select("w", H.xxh64("w", seed).alias("h")).collect()
    assert all(r.h % (1 << 64) == xxhash.xxh64_intdigest(r.w, seed=seed) for r in got)


def test_unsigned_arithmetic(spark):
    hs = [0, 1, -1, (1 << 63) - 1, -(1 << 63), 123456789012345, -987654321098765]
    ms = [1, 2, 3, 10, 64, 12_345, (1 << 31) - 1]
    rows = [(h, m) for h in hs for m in ms]
    for r in spark.createDataFrame(rows, "h long, m long").select("*", H.unsigned_mod(F.col("h"), F.col("m")).alias("r")).collect():
        assert r.r == (r.h % (1 << 64)) % r.m
    got = spark.createDataFrame([(a, b) for a in hs for b in hs], "a long, b long").select("*", H.unsigned_less(F.col("a"), F.col("b")).alias("l"))
    assert all(r.l == (r.a % (1 << 64) < r.b % (1 << 64)) for r in got.collect())


@given(st.floats(0, 1, exclude_max=True))
def test_activation_bound_is_exact(p):
    b = H.activation_bound(p) % (1 << 64)
    assert b / H.MASK >= p
    assert b == 0 or (b - 1) / H.MASK < p
