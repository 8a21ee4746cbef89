"""The frame codec: each frame compressed for itself, containers, statistics, blobs of coded streams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans import layouts
from .codec import Coded
from .filters import set_bits

FRAME = "video_id string, frame_idx int, height int, width int, channels int, itemsize int, data binary"
PLANE = "struct<h:int,w:int,data:binary>"
YUV = f"struct<format:string,y:{PLANE},u:{PLANE},v:{PLANE}>"


def compress(frames: DataFrame, keyframe: bool = False, level: int = 9) -> DataFrame:
    """video_id, frame_idx, original_size, blob of frames (``FRAME``, optionally with ``yuv`` planes as binaries).

    ``keyframe`` puts the byte 1 in front.  Rows are compressed where they are, Arrow batch by batch.
    """
    with_planes = "yuv" in frames.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            blobs = []
            for row in batch.itertuples(index=False):
                planes = None
                if with_planes and row.yuv is not None:
                    planes = (row.yuv["format"], [(row.yuv[c]["h"], row.yuv[c]["w"], bytes(row.yuv[c]["data"])) for c in "yuv"])
                blob = layouts.pack_frame(row.height, row.width, row.itemsize, bytes(row.data), planes, level)
                blobs.append((b"\x01" if keyframe else b"") + blob)
            yield pd.DataFrame({
                "video_id": batch["video_id"], "frame_idx": batch["frame_idx"], "original_size": batch["data"].map(len), "blob": blobs
            })

    return frames.mapInPandas(run, "video_id string, frame_idx int, original_size long, blob binary")


def decompress(blobs: DataFrame, keyframe: bool = False) -> DataFrame:
    """Frames (``FRAME`` and ``yuv``) of rows (video_id, frame_idx, blob); a blob of another type raises ValueError."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for video_id, frame_idx, blob in batch.itertuples(index=False):
                blob = bytes(blob)
                if keyframe:
                    if blob[:1] != b"\x01":
                        raise ValueError("only key frames can be decoded on their own")
                    blob = blob[1:]
                f = layouts.unpack_frame(blob)
                yuv = None
                if f["planes"]:
                    yuv = {"format": f["format"], **{c: {"h": h, "w": w, "data": d} for c, (h, w, d) in zip("yuv", f["planes"])}}
                out.append((video_id, frame_idx, f["height"], f["width"], f["channels"], f["itemsize"], f["data"], yuv))
            yield pd.DataFrame(out, columns=["video_id", "frame_idx", "height", "width", "channels", "itemsize", "data", "yuv"])

    return blobs.select("video_id", "frame_idx", "blob").mapInPandas(run, f"{FRAME}, yuv {YUV}")


def containers(blobs: DataFrame) -> DataFrame:
    """video_id, container: all frames of a video in order.  A container is one value, so a video's blobs meet in one task;
    frames that are only to be kept are better written as rows."""

    def run(batch: pd.DataFrame) -> pd.DataFrame:
        ordered = batch.sort_values("frame_idx")
        return pd.DataFrame({"video_id": ordered["video_id"].iloc[:1], "container": [layouts.pack_container([bytes(b) for b in ordered["blob"]])]})

    return blobs.groupBy("video_id").applyInPandas(run, "video_id string, container binary")


def from_containers(df: DataFrame, name: str = "video_id", content: str = "container") -> DataFrame:
    """video_id, frame_idx, blob of every frame; wrong magic or no frame raises ValueError."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for video_id, blob in batch.itertuples(index=False):
                found = layouts.unpack_container(bytes(blob))
                yield pd.DataFrame({"video_id": video_id, "frame_idx": range(len(found)), "blob": found})

    return df.select(F.col(name).alias("video_id"), F.col(content).alias("container")).mapInPandas(
        run, "video_id string, frame_idx int, blob binary"
    )


def statistics(blobs: DataFrame, color_space: str = "BGR") -> DataFrame:
    """video_id, frame_count, original_size, compressed_size (with container), compression_ratio, space_savings, keyframes, keyframe_ratio, color_space."""
    n = F.count("*")
    size = F.sum(F.octet_length("blob")) + 8 + n * 4
    per = blobs.groupBy("video_id").agg(n.alias("frame_count"), F.sum("original_size").alias("original_size"), size.cast("long").alias("compressed_size"))
    ratio = F.when(F.col("original_size") > 0, F.col("compressed_size") / F.col("original_size"))
    return per.select(
        "*", ratio.alias("compression_ratio"), (1 - ratio).alias("space_savings"), F.col("frame_count").alias("keyframes"),
        F.lit(1.0).alias("keyframe_ratio"), F.lit(color_space).alias("color_space"),
    )


def resize(frames: DataFrame, scale: float) -> DataFrame:
    """frames (..., height, width, channels, pixels) resized bilinearly with pixel centres aligned; sizes are cut to whole numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for h, w, c, px in zip(batch["height"], batch["width"], batch["channels"], batch["pixels"]):
                a = np.asarray(px, np.float64).reshape(h, w, c)
                nh, nw = max(1, int(h * scale)), max(1, int(w * scale))

                def axis(n, m):
                    at = np.clip((np.arange(n) + 0.5) * m / n - 0.5, 0, m - 1)
                    lo = np.floor(at).astype(int)
                    return lo, np.minimum(lo + 1, m - 1), at - lo

                (y0, y1, fy), (x0, x1, fx) = axis(nh, h), axis(nw, w)
                rows = a[y0] * (1 - fy)[:, None, None] + a[y1] * fy[:, None, None]
                both = rows[:, x0] * (1 - fx)[None, :, None] + rows[:, x1] * fx[None, :, None]
                out.append((nh, nw, np.clip(np.rint(both), 0, 255).astype(int).ravel().tolist()))
            yield batch.assign(height=[o[0] for o in out], width=[o[1] for o in out], pixels=[o[2] for o in out])

    return frames.mapInPandas(run, frames.schema)


def stream_blobs(coded: Coded, lengths: DataFrame | None = None, depth: int = 0, shape: tuple[int, ...] | None = None) -> DataFrame:
    """stream_id, blob, size, exact_k of coded streams: the text layout, or with ``shape`` the image layout.

    ``lengths`` (stream_id, length) has the texts' lengths in characters.  Streams that are not coded keep their
    bits in the filter's place, with no witness.
    """
    idx = set_bits(coded.words)
    on = idx.groupBy("filter_id").agg(F.collect_list("idx").alias("on")).withColumnRenamed("filter_id", "stream_id")
    rawon = coded.raw.where("bit = 1").groupBy("stream_id").agg(F.collect_list("pos").alias("raw_on"))
    wit = coded.witness.groupBy("stream_id").agg(F.sort_array(F.collect_list(F.struct("rank", "bit")))["bit"].cast("array<int>").alias("witness"))
    rows = coded.plan.join(on, "stream_id", "left").join(rawon, "stream_id", "left").join(wit, "stream_id", "left")
    rows = rows.join(lengths, "stream_id", "left") if lengths is not None else rows.withColumn("length", F.lit(0))
    rows = rows.select("stream_id", "n", "p", "k", "l", "coded", "on", "raw_on", "witness", F.col("length").cast("int").alias("length"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                bits = np.zeros(r.l if r.coded else r.n, np.uint8)
                at = r.on if r.coded else r.raw_on
                if at is not None:
                    bits[np.asarray(at, int)] = 1
                witness = [] if r.witness is None else r.witness
                if shape is not None:
                    blob = layouts.pack_image(bits, witness, r.p, r.n, r.k, shape)
                else:
                    blob = layouts.pack_text(bits, witness, r.p, r.n, r.k, r.length, depth)
                out.append((r.stream_id, blob, len(blob), r.k))
            yield pd.DataFrame(out, columns=["stream_id", "blob", "size", "exact_k"])

    return rows.mapInPandas(run, "stream_id string, blob binary, size long, exact_k double")
