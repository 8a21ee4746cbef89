"""Images and frames as arrays of pixel values, row-major with channels interleaved; colour conversion as integer expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Colour coefficients times 2^14 (blue, green, red to luma; differences to chroma; chroma back).
LUMA_B, LUMA_G, LUMA_R = 1868, 9617, 4899
TO_U, TO_V = 8061, 14369
B_FROM_U, G_FROM_U, G_FROM_V, R_FROM_V = 33292, -6472, -9519, 18678
HALF = 1 << 13


def _byte(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x)).cast("int")


def _scaled(x: Column) -> Column:
    return F.shiftright(x.cast("int") + HALF, 14)


def luma(b: Column, g: Column, r: Column) -> Column:
    return _scaled(b * LUMA_B + g * LUMA_G + r * LUMA_R)


def bgr_to_yuv(b: Column, g: Column, r: Column) -> tuple[Column, Column, Column]:
    y = luma(b, g, r)
    return y, _byte(_scaled((b - y) * TO_U) + 128), _byte(_scaled((r - y) * TO_V) + 128)


def yuv_to_bgr(y: Column, u: Column, v: Column) -> tuple[Column, Column, Column]:
    u, v = u - 128, v - 128
    return _byte(y + _scaled(u * B_FROM_U)), _byte(y + _scaled(u * G_FROM_U + v * G_FROM_V)), _byte(y + _scaled(v * R_FROM_V))


def _pixels(frames: DataFrame, convert) -> DataFrame:
    """``frames`` with pixels of three channels converted one by one."""
    n = F.size("pixels") / 3
    at = lambda i, c: F.element_at("pixels", (i * 3 + c + 1).cast("int"))
    px = F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: F.array(*convert(at(i, 0), at(i, 1), at(i, 2))))
    return frames.withColumn("pixels", F.flatten(px))


def convert(frames: DataFrame, how: str) -> DataFrame:
    """frames (..., channels, pixels) in another colour space: bgr2rgb, bgr2yuv, yuv2bgr, bgr2gray, gray2bgr."""
    if how in ("bgr2rgb", "rgb2bgr"):
        return _pixels(frames, lambda b, g, r: (r, g, b))
    if how == "bgr2yuv":
        return _pixels(frames, bgr_to_yuv)
    if how == "yuv2bgr":
        return _pixels(frames, yuv_to_bgr)
    if how == "bgr2gray":
        return _pixels(frames, lambda b, g, r: (luma(b, g, r),)).withColumn("channels", F.lit(1))
    if how == "gray2bgr":
        return frames.withColumn("pixels", F.flatten(F.transform("pixels", lambda v: F.array(v, v, v)))).withColumn("channels", F.lit(3))
    raise ValueError(f"unknown conversion {how!r}")


def gray(frames: DataFrame) -> DataFrame:
    """frames with ``gray``: the pixels themselves for one channel, luma of blue, green and red for three."""
    n = (F.size("pixels") / 3 - 1).cast("int")
    at = lambda i, c: F.element_at("pixels", (i * 3 + c + 1).cast("int"))
    three = F.transform(F.sequence(F.lit(0), n), lambda i: luma(at(i, 0), at(i, 1), at(i, 2)))
    return frames.withColumn("gray", F.when(F.col("channels") == 3, three).otherwise(F.col("pixels")))


def with_planes(frames: DataFrame) -> DataFrame:
    """Tags three-channel frames with ``yuv``: format and the planes y, u, v (h, w, data); null for others.

    The planes are views of the packed pixels, so they are never stored twice.
    """
    n = (F.size("pixels") / 3 - 1).cast("int")
    plane = lambda c: F.struct(
        F.col("height").alias("h"), F.col("width").alias("w"),
        F.transform(F.sequence(F.lit(0), n), lambda i: F.element_at("pixels", (i * 3 + c + 1).cast("int"))).alias("data"),
    )
    yuv = F.struct(F.lit("YUV444").alias("format"), plane(0).alias("y"), plane(1).alias("u"), plane(2).alias("v"))
    return frames.withColumn("yuv", F.when(F.col("channels") == 3, yuv))


def to_binary(pixels: Column) -> Column:
    """Bytes of an array of values 0..255."""
    return F.unhex(F.array_join(F.transform(pixels, lambda v: F.lpad(F.hex(v.cast("long")), 2, "0")), ""))


def from_binary(data: Column) -> Column:
    pairs = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    return F.transform(pairs, lambda h: F.conv(h, 16, 10).cast("int"))


def exploded(frames: DataFrame) -> DataFrame:
    """video_id, frame_idx, y, x, c, v: a row a value."""
    rows = frames.select("video_id", "frame_idx", "width", "channels", F.posexplode("pixels").alias("at", "v"))
    return rows.select(
        "video_id", "frame_idx", F.expr("cast(at div channels div width as int)").alias("y"),
        F.expr("cast(at div channels % width as int)").alias("x"), F.expr("cast(at % channels as int)").alias("c"), "v",
    )


def assembled(pixels: DataFrame, shape: DataFrame) -> DataFrame:
    """Frames from rows of values; ``shape`` has video_id, frame_idx, height, width, channels."""
    ordered = F.sort_array(F.collect_list(F.struct("y", "x", "c", "v")))["v"]
    return pixels.groupBy("video_id", "frame_idx").agg(ordered.alias("pixels")).join(shape, ["video_id", "frame_idx"])


def sample(frames: DataFrame, fps: float, target_fps: float | None = None, max_frames: int = 0) -> DataFrame:
    """Every step-th frame, step = max(1, fps / target to the nearest whole, half to even); then the first ``max_frames`` kept."""
    step = max(1, round(fps / target_fps)) if target_fps and target_fps < fps else 1
    kept = frames.where(F.col("frame_idx") % step == 0)
    # frames are numbered by step, so the first ones kept are those below a bound: no sort
    return kept.where(F.col("frame_idx") < max_frames * step) if max_frames > 0 else kept


def keyframes(frames: DataFrame, interval: int) -> DataFrame:
    """Adds is_keyframe and keyframe_idx, the last one at or before a frame."""
    return frames.withColumn("is_keyframe", F.col("frame_idx") % interval == 0).withColumn(
        "keyframe_idx", F.col("frame_idx") - F.col("frame_idx") % interval
    )
