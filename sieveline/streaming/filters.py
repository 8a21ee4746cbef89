"""Filters that grow with a stream: the bit-or of words is monotone, so it is an ordinary streaming aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.filters import indices


def stream_words(items: DataFrame, filters: DataFrame, kind: str | None = None) -> DataFrame:
    """filter_id, word_no, word of a stream of (filter_id, item), for output mode update or complete.

    ``filters`` is a static table of parameters, broadcast if Spark finds it small.  State holds one number a word that has a bit.
    """
    idx = items.join(filters, "filter_id").select("filter_id", F.explode(indices(F.col("item"), kind)).alias("idx"))
    word = F.expr("shiftleft(1L, cast(idx % 64 as int))")
    return idx.groupBy("filter_id", F.shiftright("idx", 6).alias("word_no")).agg(F.bit_or(word).alias("word"))


def windowed_words(items: DataFrame, filters: DataFrame, time: str, size: str, late: str, kind: str | None = None) -> DataFrame:
    """A filter a time window, dropped from state once the watermark has passed it; output mode append or update."""
    idx = items.withWatermark(time, late).join(filters, "filter_id")
    idx = idx.select(time, "filter_id", F.explode(indices(F.col("item"), kind)).alias("idx"))
    word = F.expr("shiftleft(1L, cast(idx % 64 as int))")
    return idx.groupBy(F.window(time, size).alias("window"), "filter_id", F.shiftright("idx", 6).alias("word_no")).agg(F.bit_or(word).alias("word"))
