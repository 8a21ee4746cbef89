"""Coded streams from and to single binary values: texts, images and masks of frame differences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import bits as B
from ..functions.hashing import activation_bound, seed_number
from ..plans import layouts
from ..plans.config import CODEC_SEEDS
from . import codec, diff, filters
from .frames import stream_blobs

UNPACK = {"text": layouts.unpack_text, "image": layouts.unpack_image, "diff": layouts.unpack_diff}


def coded_from_blobs(blobs: DataFrame, layout: str = "text", variant: str = "stream") -> codec.Coded:
    """Streams of rows (stream_id, blob, exact_k); exact_k null: the blob's own k in single precision.

    A blob without witness holds the stream's bits themselves.
    """
    seeds = [seed_number(s) for s in CODEC_SEEDS[variant]]
    columns = [c.split()[0] for c in codec.PLAN.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for stream_id, blob, exact in batch.itertuples(index=False):
                f = UNPACK[layout](bytes(blob))
                coded = len(f["witness"]) > 0
                k = f["k"] if pd.isna(exact) else exact
                on = np.flatnonzero(f["filter"]).tolist()
                plan = (stream_id, f["n"], 0, f["p"], k, len(f["filter"]) if coded else 0, coded, int(k), activation_bound(k - int(k)), *seeds)
                out.append((*plan, on, f["witness"].astype(int).tolist()))
            yield pd.DataFrame(out, columns=[*columns, "on", "w"])

    given = blobs.select("stream_id", "blob", F.col("exact_k").cast("double"))
    rows = given.mapInPandas(run, f"{codec.PLAN}, on array<long>, w array<int>").persist()
    plan = rows.select(*columns)
    at = rows.where("coded").select(F.col("stream_id").alias("filter_id"), F.explode("on").alias("idx"))
    words = filters.merge_words(at.select("filter_id", F.shiftright("idx", 6).alias("word_no"), F.expr("shiftleft(1L, cast(idx % 64 as int))").alias("word")))
    witness = rows.select("stream_id", F.posexplode("w").alias("rank", "bit")).select("stream_id", F.col("rank").cast("long").alias("rank"), F.col("bit").cast("tinyint").alias("bit"))
    on = rows.where("not coded").select("stream_id", F.explode("on").alias("pos"), F.lit(1).cast("tinyint").alias("one"))
    every = rows.where("not coded and n > 0").select("stream_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("pos"))
    raw = every.join(on, ["stream_id", "pos"], "left").select("stream_id", "pos", F.coalesce("one", F.lit(0)).cast("tinyint").alias("bit"))
    return codec.Coded(plan, words, witness, raw)


def compress_texts(df: DataFrame, stream_id: str, text: str, bit_depth: int = 0) -> DataFrame:
    """stream_id, blob, size, exact_k, length of each text; depth 8 is ASCII and loses other characters."""
    d = df.select(F.col(stream_id).cast("string").alias("stream_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    d = d.withColumn("data", B.text_bytes(F.col("t"), bit_depth))
    plan = codec.plan(B.binary_density(d, "stream_id", F.col("data")))
    coded = codec.compress(B.binary_to_bits(d, "stream_id", F.col("data")), plan_=plan)
    lengths = d.select("stream_id", F.length("t").alias("length"))
    return stream_blobs(coded, lengths, bit_depth).join(lengths, "stream_id")


def decompress_texts(blobs: DataFrame, bit_depth: int = 0) -> DataFrame:
    """stream_id, text of rows that ``compress_texts`` made; cut to their lengths in characters."""
    data = B.bits_to_binary(codec.decompress(coded_from_blobs(blobs)))
    back = blobs.select("stream_id", "length").join(data, "stream_id", "left")
    return back.select("stream_id", F.coalesce(F.left(B.binary_to_text(F.col("data"), bit_depth), F.col("length")), F.lit("")).alias("text"))


def compress_images(image: DataFrame, height: int, width: int, threshold: int = 127) -> DataFrame:
    """stream_id, blob, size, exact_k of images (pixels as for ``binarize_image``); only which pixels are bright is kept."""
    return stream_blobs(codec.compress(B.binarize_image(image, threshold)), shape=(height, width))


def decompress_images(blobs: DataFrame) -> DataFrame:
    """stream_id, pos, v of images: 0 or 255."""
    out = codec.decompress(coded_from_blobs(blobs, "image"))
    return out.select("stream_id", "pos", (F.col("bit").cast("int") * 255).alias("v"))


def diff_records(diffs: DataFrame) -> DataFrame:
    """stream_id, blob, ratio, exact_k of frame differences: coded mask and compressed changed values (as bytes).

    ratio is the record's bits over the mask's bits and those of the values.
    """
    coded = codec.compress(diff.mask_bits(diffs), "frames")
    mask = stream_blobs(coded)
    values = diffs.select(F.concat_ws("/", "video_id", F.col("frame_idx").cast("string")).alias("stream_id"), F.col("changed")["v"].alias("values"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for stream_id, blob, k, values in batch.itertuples(index=False):
                f = layouts.unpack_text(bytes(blob))
                record = layouts.pack_diff(f["filter"], f["witness"], f["p"], f["n"], k, np.asarray(values, np.uint8).tobytes(), len(values))
                bits = f["n"] + 8 * len(values)
                out.append((stream_id, record, 8 * len(record) / bits if bits else None, k))
            yield pd.DataFrame(out, columns=["stream_id", "blob", "ratio", "exact_k"])

    both = mask.join(values, "stream_id").select("stream_id", "blob", "exact_k", "values")
    return both.mapInPandas(run, "stream_id string, blob binary, ratio double, exact_k double")


def read_diff_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Masks (stream_id, pos, bit) and changed values (stream_id, rank, v), values read as bytes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"stream_id": batch["stream_id"], "values": [layouts.unpack_diff(bytes(b))["values"].astype(int).tolist() for b in batch["blob"]]})

    values = records.select("stream_id", "blob").mapInPandas(run, "stream_id string, values array<int>")
    return codec.decompress(coded_from_blobs(records, "diff", "frames")), values.select("stream_id", F.posexplode("values").alias("rank", "v"))
