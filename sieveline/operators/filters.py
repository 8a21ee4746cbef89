"""Membership filters with whole or fractional numbers of hash functions, many at once.

A filter is a row of parameters (``params``) and its bits as 64-bit words (filter_id, word_no, word).  Building is
one aggregate with map-side partial sums; probing meets the words by a broadcast of packed arrays where all
filters together are small, and by a join on (filter_id, word_no) otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import activation_bound, seed_number, unsigned_less, unsigned_mod, xxh64
from ..plans.config import CODEC_SEEDS, FilterSpec

#: Bits of all filters together up to which their words are packed into arrays and broadcast: 8 MB.
BROADCAST_BITS = 1 << 26
BROADCAST_FILTERS = 100_000

PARAMS = (
    "filter_id string, kind string, m long, k double, floor_k int, p_activation double, bound long, s1 long, s2 long, sa long"
)


def params_row(spec: FilterSpec) -> tuple:
    """The row of a filter.  Standard: seeds 0..k-1, k cut to a whole number.  Rational: double hashing with two
    seeds and one for activation; membership filters take ceil(k) for it, codec filters a fixed one."""
    floor_k = int(spec.k)
    if spec.kind == "standard" and floor_k > STANDARD_HASHES:
        raise ValueError(f"a standard filter has at most {STANDARD_HASHES} hash functions")
    frac = 0.0 if spec.kind == "standard" else spec.k - floor_k
    s1, s2, sa = spec.seeds or (0, 1, -(-spec.k // 1))
    return (
        spec.filter_id, spec.kind, spec.m, float(spec.k), floor_k, frac, activation_bound(frac),
        seed_number(int(s1)), seed_number(int(s2)), seed_number(int(sa)),
    )


def params(spark: SparkSession, specs: Iterable[FilterSpec]) -> DataFrame:
    return spark.createDataFrame([params_row(s) for s in specs], PARAMS)


def indices(item: Column, kind: str | None = None) -> Column:
    """Bit indices of an item under the filter of its row, in order of the hash functions.

    ``kind`` fixes the sort of filter where all rows have the same, so that only its hashes are computed.
    """
    m = F.col("m")
    double = lambda: F.transform(
        F.sequence(F.lit(0), F.col("floor_k")),
        lambda i: F.pmod(unsigned_mod(xxh64(item, F.col("s1")), m) + i * unsigned_mod(xxh64(item, F.col("s2")), m), m),
    )
    active = unsigned_less(xxh64(item, F.col("sa")), F.col("bound"))
    rational = F.slice(double(), F.lit(1), F.col("floor_k") + F.when(active, 1).otherwise(0))
    if kind == "rational":
        return rational
    # one seed a hash function: the numbers whose hashes are 0, 1, 2, ...
    seeds = F.array(*[F.lit(seed_number(s)).cast("long") for s in range(STANDARD_HASHES)])
    standard = F.transform(F.slice(seeds, F.lit(1), F.col("floor_k")), lambda s: unsigned_mod(xxh64(item, s), m))
    return standard if kind == "standard" else F.when(F.col("kind") == "standard", standard).otherwise(rational)


#: Most hash functions of a standard filter.
STANDARD_HASHES = 64


def build(items: DataFrame, filters: DataFrame, kind: str | None = None, n_filters: int | None = None) -> DataFrame:
    """filter_id, word_no, word of filters holding ``items`` (filter_id, item); repeated items change nothing.

    ``n_filters`` is the number of filters; null: unknown.  Up to ``BROADCAST_FILTERS`` of them are broadcast, whatever sizes Spark
    expects: exploded items look smaller than they are and would be broadcast instead.
    """
    if n_filters is not None and n_filters <= BROADCAST_FILTERS:
        filters = F.broadcast(filters)
    idx = items.join(filters, "filter_id").select("filter_id", F.explode(indices(F.col("item"), kind)).alias("idx"))
    return merge_words(
        idx.select("filter_id", F.shiftright("idx", 6).alias("word_no"), F.expr("shiftleft(1L, cast(idx % 64 as int))").alias("word"))
    )


def merge_words(words: DataFrame) -> DataFrame:
    """Union of filters: words of the same place are joined bit by bit; adding is merging with a small filter."""
    return words.groupBy("filter_id", "word_no").agg(F.bit_or("word").alias("word"))


def set_bits(words: DataFrame) -> DataFrame:
    """filter_id, idx of all set bits."""
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("word"), i) == 1))
    return words.select("filter_id", "word_no", at.alias("b")).select("filter_id", (F.col("word_no") * 64 + F.col("b")).alias("idx"))


def bit_counts(filters: DataFrame, words: DataFrame) -> DataFrame:
    """filter_id, bits_set of every filter, also of empty ones."""
    n = words.groupBy("filter_id").agg(F.sum(F.bit_count("word")).cast("long").alias("bits_set"))
    return filters.select("filter_id").join(n, "filter_id", "left").select("filter_id", F.coalesce("bits_set", F.lit(0)).alias("bits_set"))


def packed(filters: DataFrame, words: DataFrame) -> DataFrame:
    """``filters`` with all words of a filter as one dense array, for filters that fit in memory together."""
    zero = filters.select(
        "filter_id", F.explode(F.sequence(F.lit(0).cast("long"), F.shiftright(F.col("m") - 1, 6))).alias("word_no"), F.lit(0).cast("long").alias("word")
    )
    dense = merge_words(words.select("filter_id", "word_no", "word").unionByName(zero))
    arrays = dense.groupBy("filter_id").agg(F.sort_array(F.collect_list(F.struct("word_no", "word"))).alias("w"))
    return filters.join(arrays.select("filter_id", F.col("w.word").alias("words")), "filter_id")


def _has(idx: Column) -> Column:
    return F.getbit(F.element_at("words", (F.shiftright(idx, 6) + 1).cast("int")), (idx % 64).cast("int")) == 1


def probe(
    items: DataFrame, filters: DataFrame, words: DataFrame, kind: str | None = None, bits: int | None = None, n_filters: int | None = None
) -> DataFrame:
    """``items`` (filter_id, item, ...) with ``passes``: whether the filter of the row may hold the item.

    ``bits`` is the number of bits of all filters together and ``n_filters`` their number; null: found first.  Up to
    ``BROADCAST_BITS`` bits (8 MB) and ``BROADCAST_FILTERS`` filters (about 10 MB of parameters) the words travel as packed
    arrays in one broadcast and items are not shuffled; beyond either items are numbered, their indices joined with the words, and the bits joined again by ``bool_and``,
    by merges, since the words and the items that fail can be many more than Spark expects.
    A filter without hash functions for an item lets it pass.
    """
    if bits is None or n_filters is None:
        found = filters.agg(F.coalesce(F.sum("m"), F.lit(0)).alias("m"), F.count("*").alias("n")).first()
        bits, n_filters = found["m"] if bits is None else bits, found["n"]
    if bits <= BROADCAST_BITS and n_filters <= BROADCAST_FILTERS:
        full = packed(filters, words).select("filter_id", "kind", "m", "floor_k", "bound", "s1", "s2", "sa", "words")
        both = items.join(F.broadcast(full), "filter_id")
        return both.withColumn("passes", F.forall(indices(F.col("item"), kind), _has)).select(*items.columns, "passes")
    # a row's own bytes and number name it: rows that are equal have equal answers
    distinct = items.select("filter_id", "item").distinct()
    filters = F.broadcast(filters) if n_filters <= BROADCAST_FILTERS else filters
    idx = distinct.join(filters, "filter_id").select("filter_id", "item", F.explode(indices(F.col("item"), kind)).alias("idx"))
    idx = idx.withColumn("word_no", F.shiftright("idx", 6))
    found = idx.join(words.hint("merge"), ["filter_id", "word_no"], "left")
    bit = F.coalesce(F.getbit(F.col("word"), (F.col("idx") % 64).cast("int")), F.lit(0)) == 1
    failed = found.groupBy("filter_id", "item").agg(F.bool_and(bit).alias("ok")).where("not ok")
    out = items.join(failed.hint("merge"), ["filter_id", "item"], "left")
    return out.withColumn("passes", F.col("ok").isNull()).select(*items.columns, "passes")


def codec_specs(rows: Iterable[tuple[str, int, float]], variant: str = "stream") -> list[FilterSpec]:
    """Codec filters (stream, bits, hash functions) with the fixed seeds of a variant."""
    return [FilterSpec(s, "rational", m, k, CODEC_SEEDS[variant]) for s, m, k in rows]
