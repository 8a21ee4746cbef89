"""Texts, predicates and images as bit streams (stream_id, pos, bit), most significant bit of a byte first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def text_bytes(text: Column, bit_depth: int = 0) -> Column:
    """Bytes of a text: depth 8 is ASCII with "?" for each other code point, any other depth UTF-8."""
    if bit_depth == 8:
        text = F.regexp_replace(text, r"[^\x00-\x7F]", "?")
    return F.encode(text, "UTF-8")


def count_ones(data: Column) -> Column:
    """Set bits of a binary column, seven bytes at a time as one number: no row a bit."""

    def counted(d: Column) -> Column:
        starts = F.when(F.octet_length(d) > 0, F.sequence(F.lit(1), F.octet_length(d), F.lit(7))).otherwise(F.array().cast("array<int>"))
        seven = lambda at: F.bit_count(F.conv(F.hex(F.substring(d, at, F.lit(7))), 16, 10).cast("long"))
        return F.when(d.isNotNull(), F.aggregate(starts, F.lit(0).cast("long"), lambda n, at: n + seven(at)))

    # a one-element array binds the bytes, which the inner function would otherwise make again for every step
    return F.transform(F.array(data), counted)[0]


def binary_density(df: DataFrame, stream_id: str, data: Column) -> DataFrame:
    """stream_id, n, ones, p of one stream a row; p is null for an empty one."""
    n, ones = (F.octet_length(data) * 8).cast("long"), count_ones(data)
    return df.select(
        F.col(stream_id).cast("string").alias("stream_id"), n.alias("n"), ones.alias("ones"), F.when(n > 0, ones / n).alias("p")
    )


def binary_to_bits(df: DataFrame, stream_id: str, data: Column) -> DataFrame:
    """stream_id, pos, bit of every byte; meant for streams that are found worth coding."""
    pairs = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
    rows = df.select(F.col(stream_id).cast("string").alias("stream_id"), F.posexplode(pairs).alias("at", "hex"))
    byte = F.conv("hex", 16, 10).cast("int")
    rows = rows.select("stream_id", "at", byte.alias("byte"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("j"))
    return rows.select(
        "stream_id", (F.col("at").cast("long") * 8 + F.col("j")).alias("pos"), F.getbit(F.col("byte"), 7 - F.col("j")).cast("tinyint").alias("bit")
    )


def predicate_bits(df: DataFrame, stream_id: Column, pos: Column, bit: Column) -> DataFrame:
    """A bit stream a group: position and truth of a predicate."""
    return df.select(stream_id.cast("string").alias("stream_id"), pos.cast("long").alias("pos"), bit.cast("tinyint").alias("bit"))


def bits_to_binary(bits: DataFrame) -> DataFrame:
    """stream_id, data: bytes of each stream, zero bits filling the last one."""
    byte = F.sum(F.expr("shiftleft(cast(bit as int), cast(7 - pos % 8 as int))")).cast("int")
    rows = bits.groupBy("stream_id", F.expr("pos div 8").alias("at")).agg(byte.alias("byte"))
    ordered = F.sort_array(F.collect_list(F.struct("at", F.lpad(F.hex("byte"), 2, "0").alias("hex"))))
    return rows.groupBy("stream_id").agg(F.unhex(F.array_join(ordered["hex"], "")).alias("data"))


def binary_to_text(data: Column, bit_depth: int = 0) -> Column:
    """Text of bytes; what is no character becomes U+FFFD (depth 8: each byte above 127)."""
    if bit_depth == 8:
        pairs = F.regexp_extract_all(F.hex(data), F.lit(".."), F.lit(0))
        return F.array_join(
            F.transform(pairs, lambda h: F.when(h >= "80", F.lit("�")).otherwise(F.char(F.conv(h, 16, 10).cast("long")))), ""
        )
    return F.make_valid_utf8(data.cast("string"))


def binarize_image(image: DataFrame, threshold: int = 127) -> DataFrame:
    """stream_id, pos, bit from pixels (id, width, y, x, c, v): channel mean cut to a whole number, above threshold."""
    gray = image.groupBy("id", "width", "y", "x").agg(F.floor(F.avg("v")).alias("g"))
    return gray.select(
        F.col("id").cast("string").alias("stream_id"),
        (F.col("y").cast("long") * F.col("width") + F.col("x")).alias("pos"),
        (F.col("g") > threshold).cast("tinyint").alias("bit"),
    )
