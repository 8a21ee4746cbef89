"""Whole videos: compress to containers with statistics, restore, verify, and show what differs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.config import VideoConfig
from ..sources import files
from . import frames, images, verify


def read_video(
    spark: SparkSession, path: str, max_frames: int = 0, target_fps: float | None = None, scale: float = 1.0, color_space: str = "BGR",
    fps: float | None = None, **raw: object,
) -> DataFrame:
    """Byte frames (``frames.FRAME``) of a Y4M or raw file: every step-th, the first ``max_frames`` of these, resized, BGR, RGB, YUV or GRAY.

    ``raw`` are the options of headerless files (width, height, format).  Without ``fps`` a Y4M file's own rate holds; a
    headerless one is not subsampled.  Each task reads a range of frames.
    """
    reader = spark.read.format("raw_video")
    files.register(spark)
    for name, value in raw.items():
        if value is not None:
            reader = reader.option(name, value)
    planes = reader.load(path)
    fps = fps or files.frame_rate(path)
    kept = images.sample(planes, fps or 0.0, target_fps if fps else None, max_frames)
    how = {"BGR": None, "RGB": "bgr2rgb", "YUV": "bgr2yuv", "GRAY": "bgr2gray"}[color_space.upper()]
    given = files.planes_to_bgr(kept)
    if how is None and scale == 1.0:
        return given
    px = with_pixels(given).drop("data")
    px = frames.resize(px, scale) if scale != 1.0 else px
    px = images.convert(px, how) if how else px
    return px.select("video_id", "frame_idx", "height", "width", "channels", "itemsize", images.to_binary(F.col("pixels")).alias("data"))


def compress_video(given: DataFrame, path: str | None = None, config: VideoConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """Blobs and statistics of frames (``frames.FRAME``); with ``path`` also a container a video in that folder.

    ``direct_yuv`` stores the planes of three-channel byte frames beside them, as YUV containers expect.
    """
    config = config or VideoConfig()
    if config.direct_yuv:
        px = images.with_planes(given.withColumn("pixels", images.from_binary(F.col("data"))))
        plane = lambda c: F.struct(F.col(f"yuv.{c}.h").alias("h"), F.col(f"yuv.{c}.w").alias("w"), images.to_binary(F.col(f"yuv.{c}.data")).alias("data"))
        yuv = F.when(F.col("yuv").isNotNull(), F.struct(F.col("yuv.format").alias("format"), plane("y").alias("y"), plane("u").alias("u"), plane("v").alias("v")))
        given = px.withColumn("yuv", yuv).drop("pixels")
    blobs = frames.compress(given, level=config.compression_level)
    if path is not None:
        files.register(given.sparkSession)
        frames.containers(blobs).write.format("frame_container").mode("append").save(path)
    return blobs, frames.statistics(blobs, config.color_space)


def decompress_video(spark: SparkSession, path: str | None = None, blobs: DataFrame | None = None) -> DataFrame:
    """Frames of the containers in ``path``, or of rows of blobs; neither raises ValueError."""
    if path is None and blobs is None:
        raise ValueError("a path or compressed frames are needed")
    return frames.decompress(files.read_containers(spark, path) if path is not None else blobs)


def with_pixels(given: DataFrame) -> DataFrame:
    """Frames of bytes with their values as an array, as verification and differences take them."""
    return given.withColumn("pixels", images.from_binary(F.col("data")))


def verify_lossless(original: DataFrame, restored: DataFrame) -> DataFrame:
    return verify.report(with_pixels(original), with_pixels(restored))


def verify_bit_exact(original: DataFrame, restored: DataFrame, most: int = 10) -> DataFrame:
    return verify.bit_exact(with_pixels(original), with_pixels(restored), most)


def diagnostics(original: DataFrame, restored: DataFrame, factor: int = 10) -> DataFrame:
    """video_id, frame_idx, pixels: differences times ``factor``, at most 255, for looking at."""
    o, r = with_pixels(original).alias("o"), with_pixels(restored).alias("r")
    d = F.zip_with("o.pixels", "r.pixels", lambda a, b: F.least(F.lit(255), F.abs(a - b) * factor))
    return o.join(r, ["video_id", "frame_idx"]).select("video_id", "frame_idx", d.alias("pixels"))


def verify_color_spaces(given: DataFrame, spaces: tuple[str, ...] = ("BGR", "RGB", "YUV")) -> DataFrame:
    """color_space, lossless, all_lossless of frames (..., pixels) taken through the codec in each colour space."""
    how = {"BGR": None, "RGB": "bgr2rgb", "YUV": "bgr2yuv"}
    out = None
    for space in spaces:
        px = images.convert(given, how[space]) if how[space] else given
        raw = px.select("video_id", "frame_idx", "height", "width", "channels", F.lit(1).alias("itemsize"), images.to_binary(F.col("pixels")).alias("data"))
        report = verify_lossless(raw, frames.decompress(frames.compress(raw))).select(F.lit(space).alias("color_space"), "lossless")
        out = report if out is None else out.union(report)
    return verify.by_color_space(out)
