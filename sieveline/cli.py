"""Command line: ``python -m sieveline.cli compress|decompress|verify|synthetic``."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import frames, images, video
from .plans.config import VideoConfig
from .sources import files, synthetic


def _frames(spark: SparkSession, args) -> DataFrame:
    """Colour frames of a Y4M or raw file, named after it."""
    raw = {name: getattr(args, name) for name in ("width", "height", "format")}
    df = video.read_video(spark, args.input, args.max_frames, args.target_fps, args.scale, args.color_space, args.fps, **raw)
    return df.withColumn("video_id", F.regexp_extract("video_id", r"([^/]+?)(\.[^./]*)?$", 1))


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sieveline")
    commands = parser.add_subparsers(dest="command", required=True)
    for name in ("compress", "verify"):
        p = commands.add_parser(name)
        p.add_argument("input")
        p.add_argument("--width", type=int)
        p.add_argument("--height", type=int)
        p.add_argument("--format")
        p.add_argument("--max-frames", type=int, default=0)
        p.add_argument("--fps", type=float)
        p.add_argument("--target-fps", type=float)
        p.add_argument("--scale", type=float, default=1.0)
        p.add_argument("--color-space", default="BGR", choices=["BGR", "RGB", "YUV", "GRAY"])
    commands.choices["compress"].add_argument("output")
    commands.choices["verify"].add_argument("--examples", type=int, default=10)
    p = commands.add_parser("decompress")
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--images", action="store_true", help="PNG files instead of rows")
    p = commands.add_parser("synthetic")
    p.add_argument("output")
    p.add_argument("--frames", type=int, default=5)
    p.add_argument("--size", type=int, default=100)
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("sieveline").getOrCreate()
    if args.command == "compress":
        _, stats = video.compress_video(_frames(spark, args), args.output, VideoConfig(color_space=args.color_space))
        stats.show(truncate=False)
        return 0
    if args.command == "decompress":
        back = video.decompress_video(spark, args.input)
        if args.images:
            name = F.concat_ws("-", F.regexp_extract("video_id", r"([^/]+?)(\.[^./]*)?$", 1), F.lpad(F.col("frame_idx").cast("string"), 8, "0"))
            files.write_images(back.withColumn("id", name), args.output)
        else:
            back.write.parquet(args.output)
        return 0
    if args.command == "synthetic":
        made = synthetic.shape_frames(spark, args.frames, args.size)
        made = made.select("video_id", "frame_idx", "height", "width", "channels", F.lit(1).alias("itemsize"), images.to_binary(F.col("pixels")).alias("data"))
        video.compress_video(made, args.output)[1].show(truncate=False)
        return 0
    given = _frames(spark, args)
    restored = frames.decompress(frames.compress(given))
    report = video.verify_lossless(given, restored)
    report.show(truncate=False)
    lossless = report.agg(F.bool_and("lossless")).first()[0]
    if not lossless:
        video.verify_bit_exact(given, restored, args.examples).where("status <> 'equal'").show(truncate=False)
    return 0 if lossless else 1


if __name__ == "__main__":
    raise SystemExit(main())
