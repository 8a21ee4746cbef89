"""Lossless coding of bit streams: a fractional-hash filter of the ones, and witness bits that tell its errors."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.hashing import activation_bound, seed_number
from ..plans.config import CODEC_SEEDS, DENSITY_THRESHOLD, LEAST_DENSITY, LEAST_HASHES
from . import filters

PLAN = (
    "stream_id string, n long, ones long, p double, k double, l long, coded boolean, floor_k int, bound long, s1 long, s2 long, sa long"
)
#: Positions of a block in the two-level count of witness ranks.
BLOCK = 1 << 16


def optimal_params(n: int, p: float) -> tuple[float, int]:
    """Hash functions and filter bits for ``n`` bits of density ``p``; (0, 0) where coding cannot help.

    k = log2((1 - p) (ln 2)^2 / p); the filter's size comes from k before it is raised to the least allowed.
    """
    if not p > LEAST_DENSITY or p >= DENSITY_THRESHOLD:
        return 0.0, 0
    ln2 = math.log(2)
    k = math.log2((1 - p) * ln2**2 / p)
    if math.isnan(k) or k <= 0:
        return 0.0, 0
    return max(LEAST_HASHES, k), max(1, int(p * n * k * (1 / ln2)))


def plan(density: DataFrame, variant: str = "stream") -> DataFrame:
    """One row a stream from (stream_id, n, ones): everything that coding and decoding need, k in full precision.

    Streams that are empty, too sparse or too dense are not coded; frame masks also where the filter is as long
    as the stream.  Runs on one row a stream, in Python for exact logarithms and thresholds.
    """
    seeds = [seed_number(s) for s in CODEC_SEEDS[variant]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for stream_id, n, ones in batch.itertuples(index=False):
                p = ones / n if n else 0.0
                k, l = optimal_params(int(n), p)  # noqa: E741
                coded = l > 0 and not (variant == "frames" and l >= n)
                k, l = (k, l) if coded else (0.0, 0)  # noqa: E741
                out.append((stream_id, n, ones, p, k, l, coded, int(k), activation_bound(k - int(k)), *seeds))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in PLAN.split(", ")])

    return density.select("stream_id", "n", "ones").mapInPandas(run, PLAN)


def density(bits: DataFrame) -> DataFrame:
    """stream_id, n, ones, p of streams with at least one bit."""
    d = bits.groupBy("stream_id").agg(F.count("*").alias("n"), F.sum(F.col("bit").cast("long")).alias("ones"))
    return d.withColumn("p", F.col("ones") / F.col("n"))


def _as_filters(plan_: DataFrame) -> DataFrame:
    return plan_.where("coded").select(
        F.col("stream_id").alias("filter_id"), F.lit("rational").alias("kind"), F.col("l").alias("m"), "floor_k", "bound", "s1", "s2", "sa"
    )


@dataclass
class Coded:
    """A set of coded streams: parameters, filter words, witness (stream_id, rank, bit), bits of streams left as they are."""

    plan: DataFrame
    words: DataFrame
    witness: DataFrame
    raw: DataFrame
    bits: int | None = None  # of all filters together
    n_coded: int | None = None
    passed: DataFrame | None = None  # the witness's bits by stream_id, without their order

    def summary(self) -> DataFrame:
        """stream_id, n, ones, p, k, l, witness_len, ratio of bits after to bits before; headers do not count."""
        w = (self.witness if self.passed is None else self.passed).groupBy("stream_id").agg(F.count("*").alias("w"))
        length = F.coalesce("w", F.lit(0))
        ratio = F.when(F.col("coded"), (F.col("l") + length) / F.col("n")).otherwise(F.lit(1.0))
        return self.plan.join(w, "stream_id", "left").select(
            "stream_id", "n", "ones", "p", "k", "l", length.alias("witness_len"), ratio.alias("ratio")
        )


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds rank by position among a stream's rows: counts of blocks are summed in order, rows within a block."""
    rows = rows.withColumn("block", F.expr(f"pos div {BLOCK}"))
    blocks = rows.groupBy("stream_id", "block").agg(F.count("*").alias("held"))
    before = W.partitionBy("stream_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    blocks = blocks.select("stream_id", "block", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("stream_id", "block").orderBy("pos")) - 1
    return rows.withColumn("inside", inside).join(blocks, ["stream_id", "block"]).withColumn("rank", F.col("before") + F.col("inside")).drop("block", "before", "inside")


def compress(bits: DataFrame, variant: str = "stream", plan_: DataFrame | None = None) -> Coded:
    """Code all streams of ``bits`` (stream_id, pos, bit; positions 0..n-1) in one job.

    The ones of a stream go into a filter; the witness is the stream's bits, in order, wherever the filter
    passes.  ``plan_`` may come from a cheaper count of the ones; it is kept so that its numbers are the same
    for coding and decoding.
    """
    plan_ = (plan(density(bits), variant) if plan_ is None else plan_).persist()
    found = plan_.agg(F.coalesce(F.sum("l"), F.lit(0)).alias("l"), F.count("*").alias("all"), F.count_if("coded").alias("coded")).first()
    total, n_coded = found["l"], found["coded"]
    f = _as_filters(plan_)
    coded = plan_.select("stream_id", "coded")
    # a row a stream, coded or not
    known = bits.join(F.broadcast(coded) if found["all"] <= filters.BROADCAST_FILTERS else coded, "stream_id")
    items = known.where("coded").select(F.col("stream_id").alias("filter_id"), F.col("pos").cast("string").alias("item"), "pos", "bit")
    words = filters.build(items.where("bit = 1").select("filter_id", "item"), f, "rational")
    passed = filters.probe(items, f, words, "rational", total, n_coded).where("passes")
    passed = passed.select(F.col("filter_id").alias("stream_id"), "pos", "bit")
    witness = _ranked(passed).select("stream_id", "rank", "bit")
    raw = known.where("not coded").select("stream_id", "pos", "bit")
    return Coded(plan_, words, witness, raw, total, n_coded, passed)


def decompress(coded: Coded) -> DataFrame:
    """stream_id, pos, bit of all streams: where the filter passes the next witness bit, elsewhere 0."""
    starts = coded.plan.where("coded").select(
        F.col("stream_id").alias("filter_id"), "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(BLOCK).cast("long"))).alias("start")
    )
    pos = starts.select("filter_id", F.explode(F.sequence("start", F.least(F.col("n"), F.col("start") + BLOCK) - 1)).alias("pos"))
    items = pos.withColumn("item", F.col("pos").cast("string"))
    probed = filters.probe(items, _as_filters(coded.plan), coded.words, "rational", coded.bits, coded.n_coded)
    probed = probed.select(F.col("filter_id").alias("stream_id"), "pos", "passes")
    found = _ranked(probed.where("passes").select("stream_id", "pos")).join(coded.witness, ["stream_id", "rank"], "left")
    off = probed.where("not passes").select("stream_id", "pos", F.lit(0).cast("tinyint").alias("bit"))
    return found.select("stream_id", "pos", "bit").unionByName(off).unionByName(coded.raw)


def mismatches(bits: DataFrame, decoded: DataFrame) -> DataFrame:
    """stream_id, mismatches: positions where two sets of streams differ or only one has a bit."""
    a, b = bits.alias("a"), decoded.alias("b")
    both = a.join(b, (F.col("a.stream_id") == F.col("b.stream_id")) & (F.col("a.pos") == F.col("b.pos")), "full_outer")
    bad = F.count_if(~F.col("a.bit").eqNullSafe(F.col("b.bit")))
    return both.groupBy(F.coalesce("a.stream_id", "b.stream_id").alias("stream_id")).agg(bad.alias("mismatches"))
