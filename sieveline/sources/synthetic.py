"""Deterministic inputs that depend on row numbers only, so any partitioning gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def random_strings(spark: SparkSession, n: int, length: int = 10, seed: int = 0) -> DataFrame:
    """id, item: lower-case words of ``length`` letters."""
    letter = lambda i: F.char(F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i), F.lit(26)) + 97)
    return spark.range(n).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), letter), "").alias("item"))


def bernoulli_bits(spark: SparkSession, n: int, p: float, stream_id: str, seed: int = 0) -> DataFrame:
    """stream_id, pos, bit: bits that are 1 with probability ``p``."""
    share = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(1 << 30))
    return spark.range(n).select(F.lit(stream_id).alias("stream_id"), F.col("id").alias("pos"), (share < int(p * (1 << 30))).cast("tinyint").alias("bit"))


def square_with_hole(spark: SparkSession, size: int = 100) -> DataFrame:
    """id, height, width, y, x, c, v: a bright square of half the size with a hole of a fifth of it."""
    at = spark.range(size * size).select(F.expr(f"cast(id div {size} as int)").alias("y"), F.expr(f"cast(id % {size} as int)").alias("x"))
    a, b, c, d = size // 4, size * 3 // 4, size * 2 // 5, size * 3 // 5
    inside = lambda lo, hi: F.col("y").between(lo, hi - 1) & F.col("x").between(lo, hi - 1)
    v = F.when(inside(a, b) & ~inside(c, d), 255).otherwise(0)
    return at.select(F.lit("square").alias("id"), F.lit(size).alias("height"), F.lit(size).alias("width"), "y", "x", F.lit(0).alias("c"), v.alias("v"))


def shape_frames(spark: SparkSession, n: int = 5, size: int = 100) -> DataFrame:
    """video_id, frame_idx, height, width, channels, pixels: a rectangle and a circle that move with the frame."""
    frames = spark.range(n).select(F.col("id").cast("int").alias("frame_idx"))
    y, x = lambda i: F.floor(i / size), lambda i: i % size
    shift = F.col("frame_idx") * 2

    def pixel(i):
        rectangle = y(i).between(20, 60) & x(i).between(F.lit(20) + shift, F.lit(50) + shift)
        circle = (y(i) - 70) * (y(i) - 70) + (x(i) - 70) * (x(i) - 70) <= 225
        return F.array(F.when(rectangle, 255).otherwise(30), F.when(circle, 200).otherwise(30), F.lit(30) + F.col("frame_idx"))

    px = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), pixel))
    return frames.select(
        F.lit("shapes").alias("video_id"), "frame_idx", F.lit(size).alias("height"), F.lit(size).alias("width"), F.lit(3).alias("channels"), px.alias("pixels")
    )
