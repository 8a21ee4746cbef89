"""Comparison of frame sequences: whole frames, channels, single values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import images


def frame_differences(original: DataFrame, restored: DataFrame) -> DataFrame:
    """video_id, frame_idx, same_shape, mean_diff, max_diff, n_diff; the last three are null where shapes differ."""
    cols = ["video_id", "frame_idx", "height", "width", "channels", "pixels"]
    o, r = original.select(*cols).alias("o"), restored.select(*cols).alias("r")
    both = o.join(r, (F.col("o.video_id") == F.col("r.video_id")) & (F.col("o.frame_idx") == F.col("r.frame_idx")), "full_outer")
    same = F.coalesce(
        (F.col("o.height") == F.col("r.height")) & (F.col("o.width") == F.col("r.width")) & (F.col("o.channels") == F.col("r.channels")), F.lit(False)
    )
    d = F.zip_with("o.pixels", "r.pixels", lambda a, b: F.abs(a - b))
    both = both.select(
        F.coalesce("o.video_id", "r.video_id").alias("video_id"), F.coalesce("o.frame_idx", "r.frame_idx").alias("frame_idx"),
        same.alias("same_shape"), F.when(same, d).alias("d"),
    )
    total = F.aggregate("d", F.lit(0).cast("long"), lambda s, x: s + x)
    return both.select(
        "video_id", "frame_idx", "same_shape", (total / F.size("d")).alias("mean_diff"), F.array_max("d").alias("max_diff"),
        F.when(F.col("same_shape"), F.size(F.filter("d", lambda x: x > 0))).alias("n_diff"),
    )


def report(original: DataFrame, restored: DataFrame) -> DataFrame:
    """One row a video: counts, whether all frames are equal, worst and mean difference, the first worst frame.

    avg_difference is the largest of the frames' mean differences; mean_difference is their mean.  Where the
    numbers of frames differ the video is not lossless and the other fields are null.
    """
    d = frame_differences(original, restored)
    a = original.groupBy("video_id").agg(F.count("*").alias("total_frames"))
    b = restored.groupBy("video_id").agg(F.count("*").alias("restored_frames"))
    worst = F.max(F.struct("mean_diff", (-F.col("frame_idx")).alias("first")))
    diff_frames = F.sort_array(F.collect_list(F.when(~F.col("same_shape") | (F.col("n_diff") > 0), F.col("frame_idx"))))
    per = d.groupBy("video_id").agg(
        F.count_if(F.col("same_shape") & (F.col("n_diff") == 0)).alias("exact"), worst.alias("worst"), F.avg("mean_diff").alias("mean"),
        F.max("max_diff").alias("max"), diff_frames.alias("diff_frames"),
    )
    both = a.join(b, "video_id", "full_outer").join(per, "video_id")
    fits = F.col("total_frames").eqNullSafe(F.col("restored_frames"))
    exact = fits & (F.col("exact") == F.col("total_frames"))
    return both.select(
        "video_id", F.coalesce("total_frames", F.lit(0)).alias("total_frames"), exact.alias("lossless"),
        F.when(fits, F.col("exact")).alias("exact_frame_matches"), F.when(fits, F.col("worst.mean_diff")).alias("avg_difference"),
        F.when(fits, F.col("mean")).alias("mean_difference"), F.when(fits, F.col("max")).alias("max_difference"),
        F.when(fits & ~exact, -F.col("worst.first")).alias("max_diff_frame"), F.when(fits, F.col("diff_frames")).alias("diff_frames"),
    )


def _values(original: DataFrame, restored: DataFrame) -> DataFrame:
    key = ["video_id", "frame_idx", "y", "x", "c"]
    o = images.exploded(original).withColumnRenamed("v", "original_value")
    r = images.exploded(restored).withColumnRenamed("v", "restored_value")
    return o.join(r, key)


def examples(original: DataFrame, restored: DataFrame, most: int = 10) -> DataFrame:
    """video_id, frame_idx, differences_found, rank, y, x, c, original_value, restored_value, difference.

    The first ``most`` differing values of each frame, in order of row, column and channel.
    """
    bad = _values(original, restored).where("original_value <> restored_value")
    frame = W.partitionBy("video_id", "frame_idx")
    rank = F.row_number().over(frame.orderBy("y", "x", "c"))
    bad = bad.withColumn("differences_found", F.count("*").over(frame)).withColumn("rank", rank).where(F.col("rank") <= most)
    return bad.select(
        "video_id", "frame_idx", "differences_found", "rank", "y", "x", "c", "original_value", "restored_value",
        F.abs(F.col("original_value") - F.col("restored_value")).alias("difference"),
    )


def bit_exact(original: DataFrame, restored: DataFrame, most: int = 10) -> DataFrame:
    """video_id, frame_idx, status, differences_found, examples: a row a frame of either side.

    status is equal, differs, shape (heights, widths or channels are unlike), missing (not restored) or extra (not in the
    original); the last two columns are null for the latter three.  examples are the first ``most`` differing values, in
    order of row, column and channel, each y, x, c, original_value, restored_value, difference.  Frames that occur more than
    once on a side are compared with all of the other's.
    """
    fields = ["height", "width", "channels", "pixels"]
    key = ["video_id", "frame_idx"]
    o = original.select(*key, F.struct(*fields).alias("o"))
    both = o.join(restored.select(*key, F.struct(*fields).alias("r")), key, "full_outer")
    same = F.lit(True)
    for f in fields[:3]:
        same = same & F.col(f"o.{f}").eqNullSafe(F.col(f"r.{f}"))
    here = F.col("o").isNotNull() & F.col("r").isNotNull() & same
    pair = F.zip_with("o.pixels", "r.pixels", lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    at = F.transform(pair, lambda v, i: F.struct(i.alias("i"), v["a"].alias("a"), v["b"].alias("b")))
    both = both.withColumn("d", F.when(here, F.filter(at, lambda v: ~v["a"].eqNullSafe(v["b"]))))
    status = (
        F.when(F.col("r").isNull(), "missing").when(F.col("o").isNull(), "extra").when(~same, "shape")
        .when(F.size("d") > 0, "differs").otherwise("equal")
    )
    row = F.col("o.width") * F.col("o.channels")
    found = F.transform(
        F.slice("d", 1, most),
        lambda v: F.struct(
            F.floor(v["i"] / row).cast("int").alias("y"), F.floor(v["i"] % row / F.col("o.channels")).cast("int").alias("x"),
            (v["i"] % F.col("o.channels")).cast("int").alias("c"), v["a"].alias("original_value"), v["b"].alias("restored_value"),
            F.abs(v["a"] - v["b"]).alias("difference"),
        ),
    )
    return both.select(*key, status.alias("status"), F.when(here, F.size("d")).alias("differences_found"), found.alias("examples"))


def channels(original: DataFrame, restored: DataFrame) -> DataFrame:
    """video_id, frame_idx, channel, avg_diff, max_diff, num_nonzero."""
    d = F.abs(F.col("original_value") - F.col("restored_value"))
    return _values(original, restored).groupBy("video_id", "frame_idx", F.col("c").alias("channel")).agg(
        F.avg(d).alias("avg_diff"), F.max(d).alias("max_diff"), F.count_if(d > 0).alias("num_nonzero")
    )


def by_color_space(reports: DataFrame) -> DataFrame:
    """all_lossless over rows (color_space, lossless) of several reports, with each space's own."""
    per = reports.groupBy("color_space").agg(F.bool_and("lossless").alias("lossless"))
    return per.withColumn("all_lossless", F.bool_and("lossless").over(W.partitionBy(F.lit(0))))
