"""Chat formatting: collapse cumulative snapshots of a conversation, then render the maximal ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import materialize, null_safe_hash

BLOCK = 1024


def prefix_hashes(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, turn, blk, n, prefix, last: for each distinct logged turn the hash of all turns up to it.

    A turn's own hash covers turn number, role and text; a prefix's hash is their running xor (two 64-bit
    seeds) together with their number.  Sums are two-level, by blocks of turn numbers, so a conversation of
    any length is spread over tasks; there is one row a block in the second level.
    """
    t = turns.select(
        "conv_id",
        "turn",
        F.floor(F.coalesce(F.col("turn"), F.lit(-1)) / block).alias("blk"),
        "role",
        F.xxhash64("text").alias("th"),
        null_safe_hash("turn", "role", "text", seed=1).alias("h1"),
        null_safe_hash("turn", "role", "text", seed=2).alias("h2"),
    ).distinct()
    blocks = t.groupBy("conv_id", "blk").agg(
        F.bit_xor("h1").alias("b1"), F.bit_xor("h2").alias("b2"), F.count("*").alias("bn")
    )
    by_block = W.partitionBy("conv_id").orderBy("blk")
    up = by_block.rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select(
        "conv_id",
        "blk",
        *[F.coalesce(f(c).over(up), F.lit(0)).alias(c) for f, c in ((F.bit_xor, "b1"), (F.bit_xor, "b2"), (F.sum, "bn"))],
        F.lead("blk").over(by_block).isNull().alias("last_blk"),
    )
    order = W.partitionBy("conv_id", "blk").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "th", "h1")
    run = order.rowsBetween(W.unboundedPreceding, W.currentRow)
    t = t.select(
        "conv_id",
        "turn",
        "blk",
        F.bit_xor("h1").over(run).alias("x1"),
        F.bit_xor("h2").over(run).alias("x2"),
        F.count("*").over(run).alias("i"),
        F.lead("h1").over(order).isNull().alias("last_here"),
    ).alias("t")
    b = blocks.alias("b")
    joined = t.join(b, F.col("t.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("t.blk") == F.col("b.blk")))
    n = F.col("i") + F.col("bn")
    return joined.select(
        "t.conv_id",
        "turn",
        "t.blk",
        n.alias("n"),
        F.struct(
            F.col("x1").bitwiseXOR(F.col("b1")).alias("x1"), F.col("x2").bitwiseXOR(F.col("b2")).alias("x2"), n.alias("n")
        ).alias("prefix"),
        (F.col("last_here") & F.col("last_blk")).alias("last"),
    )


def maximal_conversations(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that are no proper prefix of another one.

    Of conversations that are equal throughout, the smallest conv_id stays (null first).
    """
    p = materialize(prefix_hashes(turns, block), "chat-prefixes")
    whole = p.where("last").groupBy("prefix").agg(
        F.min(F.struct(F.col("conv_id"))).alias("c"), F.count("*").alias("n_copies")
    )
    within = p.where(~F.col("last")).select("prefix").distinct()
    kept = whole.join(within, "prefix", "left_anti")
    return kept.select(F.col("c.conv_id").alias("conv_id"), F.col("prefix.n").alias("n_turns"), "n_copies")


def render(turns: DataFrame, kept: DataFrame, block: int = BLOCK, begin: str = "<|im_start|>", end: str = "<|im_end|>") -> DataFrame:
    """conv_id, part, n_turns, n_copies, rendered: one row a conversation and block of ``block`` turn numbers.

    A turn is ``begin`` role newline text ``end`` newline; null role or text is empty.  Turns are in order of
    turn number (null first), then role (null first), then hash of the text.
    """
    t, k = turns.alias("t"), kept.alias("k")
    own = t.join(k, F.col("t.conv_id").eqNullSafe(F.col("k.conv_id"))).select(
        "t.conv_id",
        F.floor(F.coalesce(F.col("t.turn"), F.lit(-1)) / block).alias("part"),
        "k.n_turns",
        "k.n_copies",
        F.struct("t.turn", "t.role", F.xxhash64("t.text").alias("th"), "t.text").alias("x"),
    )
    piece = F.transform(
        F.sort_array(F.collect_set("x")),
        lambda x: F.concat(
            F.lit(begin), F.coalesce(x["role"], F.lit("")), F.lit("\n"), F.coalesce(x["text"], F.lit("")), F.lit(end + "\n")
        ),
    )
    return own.groupBy("conv_id", "part", "n_turns", "n_copies").agg(F.array_join(piece, "").alias("rendered"))


def format_chats(turns: DataFrame, block: int = BLOCK) -> DataFrame:
    """conv_id, n_turns, n_copies, rendered: snapshots collapsed, then a row for each conversation that stays.

    Blocks of ``block`` turn numbers are rendered apart (``render``) and joined in order, so only a conversation's own
    text meets in one row.

    Repeated rows of a log (same conversation, turn, role and text) count once.  Null ids form one
    conversation; null turns sort first; null role or text equals only null.  Empty table: no rows.  Only
    conv_id, turn, role and text are read.
    """
    turns = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    parts = render(turns, maximal_conversations(turns, block), block)
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("part", "rendered"))), lambda p: p["rendered"])
    return parts.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_join(ordered, "").alias("rendered"))
