"""Differences between consecutive frames: noise, threshold, mask, changed values, and putting them back."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import images


def noise_level(frames: DataFrame) -> DataFrame:
    """video_id, frame_idx, noise: population deviation of gray values from their 5 x 5 median, edges repeated."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            noise = []
            for h, w, g in zip(batch["height"], batch["width"], batch["gray"]):
                a = np.asarray(g, np.float64).reshape(h, w)
                near = np.lib.stride_tricks.sliding_window_view(np.pad(a, 2, mode="edge"), (5, 5))
                noise.append(float((a - np.median(near, axis=(2, 3))).std()))
            yield batch[["video_id", "frame_idx"]].assign(noise=noise)

    given = images.gray(frames).select("video_id", "frame_idx", "height", "width", "gray")
    return given.mapInPandas(run, "video_id string, frame_idx int, noise double")


def adaptive_threshold(noise: Column, tolerance: float = 10.0, least: float = 3.0, most: float = 30.0) -> Column:
    return F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), noise * tolerance))


def differences(frames: DataFrame, threshold: Column | float, any_channel: bool = False) -> DataFrame:
    """video_id, frame_idx, mask, density, changed for every frame that has a predecessor.

    mask is true where gray values differ by more than ``threshold`` (strictly; with ``any_channel`` any channel,
    for lossless differences at threshold 0); changed has (at, v) of all channels of masked pixels, at being the
    place in the frame's values.  Frames meet their predecessors by an equi-join on video and number.
    """
    threshold = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    now = images.gray(frames).alias("n")
    before = images.gray(frames).select("video_id", (F.col("frame_idx") + 1).alias("frame_idx"), "gray", "pixels").alias("p")
    both = now.join(before, ["video_id", "frame_idx"])
    both = both.withColumn("limit", threshold)
    if any_channel:
        n, c = (F.size("n.gray") - 1).cast("int"), F.col("channels")
        part = lambda a, i: F.slice(F.col(a), (i * c + 1).cast("int"), c)
        count = F.when(c == 3, (F.size("n.pixels") / 3 - 1).cast("int")).otherwise(n)
        mask = F.transform(
            F.sequence(F.lit(0), count),
            lambda i: F.exists(F.zip_with(part("n.pixels", i), part("p.pixels", i), lambda a, b: F.abs(a - b) > F.col("limit")), lambda x: x),
        )
    else:
        mask = F.zip_with("n.gray", "p.gray", lambda a, b: F.abs(a - b) > F.col("limit"))
    both = both.withColumn("mask", mask)
    places = F.filter(
        F.transform("n.pixels", lambda v, at: F.struct(at.alias("at"), v.alias("v"))),
        lambda x: F.element_at("mask", (F.expr("0") + F.floor(x["at"] / F.col("channels")) + 1).cast("int")),
    )
    ones = F.size(F.filter("mask", lambda m: m))
    return both.select(
        "video_id", "frame_idx", "height", "width", "channels", "mask", (ones / F.size("mask")).alias("density"), places.alias("changed")
    )


def mask_bits(diffs: DataFrame) -> DataFrame:
    """Masks as bit streams, one a frame, for the stream codec (variant "frames")."""
    rows = diffs.select(F.concat_ws("/", "video_id", F.col("frame_idx").cast("string")).alias("stream_id"), F.posexplode("mask").alias("pos", "bit"))
    return rows.select("stream_id", F.col("pos").cast("long").alias("pos"), F.col("bit").cast("tinyint").alias("bit"))


def apply_difference(base: DataFrame, diffs: DataFrame) -> DataFrame:
    """Frames with their changed values put in: ``base`` frames have the number of the frame they become.

    A frame whose number of changed values does not fit its mask stays as it is.
    """
    fits = F.size("changed") == F.size(F.filter("mask", lambda m: m)) * F.col("channels")
    new = diffs.where(fits).select("video_id", "frame_idx", "changed")
    both = base.join(new, ["video_id", "frame_idx"], "left")
    value = lambda at, late, v: F.struct(at.alias("at"), F.lit(late).alias("late"), v.cast("int").alias("v"))
    old = F.transform("pixels", lambda v, at: value(at, 0, v))
    late = F.transform("changed", lambda x: value(x["at"], 1, x["v"]))
    # of the old and the changed value of a place the last one in order stays; no row a value
    merged = F.transform(
        F.array(F.array_sort(F.concat(old, late))),
        lambda all_: F.transform(F.filter(all_, lambda x, i: F.coalesce(F.get(all_, i + 1)["at"] != x["at"], F.lit(True))), lambda x: x["v"]),
    )[0]
    return both.withColumn("pixels", F.when(F.col("changed").isNull(), F.col("pixels")).otherwise(merged)).drop("changed").select(base.columns)


def replay(first: DataFrame, diffs: DataFrame) -> DataFrame:
    """video_id, frame_idx, at, v of all frames: a first frame a video, then each value's last change up to a frame."""
    start = first.select("video_id", "frame_idx", F.posexplode("pixels").alias("at", "v"))
    change = diffs.select("video_id", "frame_idx", F.explode("changed").alias("x")).select("video_id", "frame_idx", "x.at", "x.v")
    every = diffs.select("video_id", "frame_idx").union(first.select("video_id", "frame_idx")).distinct()
    grid = every.join(start.select("video_id", "at"), "video_id")
    known = grid.join(start.unionByName(change), ["video_id", "frame_idx", "at"], "left")
    order = W.partitionBy("video_id", "at").orderBy("frame_idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    return known.select("video_id", "frame_idx", "at", F.last("v", ignorenulls=True).over(order).alias("v"))
