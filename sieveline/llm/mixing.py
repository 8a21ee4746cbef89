"""Mixing sources to target weights by weighted fair queueing; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buckets_for, materialize, null_safe_hash, row_keys, sums_before, word_count

SEED = 20_011


def source_targets(sizes: DataFrame, max_epochs: int = 3, weight_cycle: int = 3, share: float = 1.0) -> DataFrame:
    """(source, size) rows -> one row a source: rank, weight, source_size, target.

    Sources are ranked by code point with null last; weights run 1, 2, ..., ``weight_cycle`` and repeat.  The
    budget is ``share`` of all sizes, dealt by weight; a target stops at ``max_epochs`` times its source's
    size and what is above goes to the others by weight.  Water level: with sources ordered by cap / weight,
    the capped ones are a prefix, so one ordered window finds it.  The windows see one row a source.
    """
    one = W.partitionBy(F.lit(0))
    s = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"), F.count("*").alias("source_rows"))
    s = s.withColumn("rank", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    s = s.withColumn("weight", (F.col("rank") % weight_cycle + 1).cast("double"))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_epochs)
    by_level = one.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = by_level.rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.withColumn("budget", F.sum("source_size").over(one).cast("double") * share)
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("all_weight", F.sum("weight").over(one))
        .withColumn("level", (F.col("budget") - F.col("cap_before")) / (F.col("all_weight") - F.col("weight_before")))
        .withColumn("open", F.col("level") * F.col("weight") <= F.col("cap"))
        .withColumn("water", F.min(F.when(F.col("open"), F.struct(F.col("cap") / F.col("weight"), "rank", "level"))).over(one)["level"])
    )
    target = F.when(F.col("water").isNull(), F.col("cap")).otherwise(
        F.least("cap", F.col("water") * F.col("weight"))
    )
    return s.select("source", "rank", "weight", "source_size", "source_rows", "budget", target.alias("target"))


def mix_entries(
    docs: DataFrame,
    size: Column | None = None,
    max_epochs: int = 3,
    weight_cycle: int = 3,
    share: float = 1.0,
    seed: int = SEED,
    rows_per_bucket: int = 1024,
) -> tuple[DataFrame, DataFrame]:
    """All rows of ``docs``, and the mix itself: a row for each pass of a document that the mix takes from.

    Rows: k1, k2, copy_no, doc_id, source, size, source_size, target.  The mix: k1, k2, copy_no, pass, finish, size,
    begin (words of the mix before it, so begin is its order) and taken.  k1 and k2 are ``row_keys``: fully repeated
    rows share them and are numbered by copy_no.

    Each source's documents are put in a seeded order; a document's virtual finish time is the source's
    cumulative size up to it divided by the source's target, and goes on over up to ``max_epochs`` passes.
    All entries are then sorted by finish time and cut where their sizes reach the budget; the entry at the
    cut is taken in part.  Sums over an order are two-level: the order's key range is cut into buckets, one
    number a bucket is summed in order, and rows are summed within their bucket only, so a source that holds
    most rows is spread like any other.
    """
    words = word_count(F.col("text")) if size is None else F.coalesce(size, F.lit(0)).cast("long")
    rows = docs.select(*row_keys(docs), F.col("doc_id"), F.col("source"), words.alias("size"))
    # equal rows are counted first, then numbered: copies get places of their own in the order
    rows = rows.groupBy("k1", "k2", "doc_id", "source", "size").agg(F.count("*").alias("n"))
    rows = rows.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    rows = rows.withColumn("h", null_safe_hash("k1", "k2", "copy_no", seed=seed))
    rows = materialize(rows, "mix-rows")
    n_bins = buckets_for(rows.count(), rows_per_bucket)
    sources = source_targets(rows.select("source", "size"), max_epochs, weight_cycle, share)
    sources = materialize(sources, "mix-sources").withColumnRenamed("source", "s_source")

    # a source's order is cut where its own rows ask for it: 2^bits equal ranges of the hash
    bits = F.ceil(F.log2(F.greatest(F.lit(1.0), F.col("source_rows") / rows_per_bucket))).cast("int")
    bucket = F.call_function("shiftrightunsigned", F.shiftrightunsigned("h", 1), 63 - bits)
    rows = rows.join(sources, rows["source"].eqNullSafe(sources["s_source"]), "inner").drop("s_source")
    rows = rows.withColumn("b", bucket)
    blocks = sums_before(rows.groupBy("rank", "b").agg(F.sum("size").alias("sum")), ["rank"], "b", "sum")
    inside = W.partitionBy("rank", "b").orderBy(F.shiftrightunsigned("h", 1), "h", "k1", "k2", "copy_no")
    rows = rows.withColumn("upto", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)))
    rows = rows.join(blocks.select("rank", "b", "before"), ["rank", "b"]).withColumn("upto", F.col("upto") + F.col("before"))

    # the passes in which the document may start before its source's target is reached
    start = F.col("upto") - F.col("size")
    passes = F.filter(
        F.sequence(F.lit(0), F.lit(max_epochs - 1)),
        lambda e: (F.col("size") > 0) & ((start + e * F.col("source_size")).cast("double") < F.col("target")),
    )
    key = ["k1", "k2", "copy_no"]
    info = ["doc_id", "source", "size", "source_size", "target"]
    rows = materialize(rows.select(*key, *info, "rank", "h", "budget", "upto", passes.alias("passes")), "mix-order")
    entries = rows.withColumn("pass", F.explode("passes")).drop("passes")
    entries = entries.withColumn("finish", (F.col("upto") + F.col("pass") * F.col("source_size")) / F.col("target"))
    entries = entries.withColumn("bin", F.least(F.floor(F.col("finish") * n_bins), F.lit(n_bins)).cast("long"))
    bins = sums_before(entries.groupBy("bin").agg(F.sum("size").alias("sum")), [], "bin", "sum")
    by_finish = W.partitionBy("bin").orderBy("finish", "rank", "pass", "h", "k1", "k2", "copy_no")
    entries = entries.withColumn("sofar", F.sum("size").over(by_finish.rowsBetween(W.unboundedPreceding, W.currentRow)))
    entries = entries.join(bins.select("bin", "before"), "bin")
    entries = entries.withColumn("begin", (F.col("sofar") + F.col("before") - F.col("size")).cast("long"))
    left = F.col("budget") - F.col("begin")
    entries = entries.withColumn("taken", F.least(F.col("size"), F.greatest(F.lit(0), F.round(left).cast("long"))).cast("long"))
    return rows.select(*key, *info), entries.where("taken > 0").select(*key, "pass", "finish", "size", "begin", "taken")


def mix(docs: DataFrame, size: Column | None = None, max_epochs: int = 3, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, begins: a row for each row of ``docs``.

    taken is the sum over the document's passes in the mix (``mix_entries``), begins the places in the mix where they
    start, in words from 0: the order of the mix.

    Null text or ``size``: 0.  Null source: a source of its own, ranked last.  Null ids and fully repeated
    rows are rows like others: copies are counted, numbered and shuffled apart.  Empty table: no rows.
    Other columns tell rows apart and are ignored otherwise, whatever their names.
    """
    rows, entries = mix_entries(docs, size, max_epochs, **options)
    key, info = ["k1", "k2", "copy_no"], ["doc_id", "source", "size", "source_size", "target"]
    none = [F.lit(None).cast("int").alias("pass"), F.lit(None).cast("long").alias("begin"), F.lit(0).cast("long").alias("taken")]
    blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in info]
    both = rows.select(*key, *info, *none).union(entries.select(*key, *blank, "pass", "begin", "taken"))
    of_pass = [F.max(F.when(F.col("pass") == e, F.col("begin"))).alias(f"b{e}") for e in range(max_epochs)]
    out = both.groupBy(*key).agg(*[F.max(c).alias(c) for c in info], F.sum("taken").cast("long").alias("taken"), *of_pass)
    return out.select(*info, "taken", F.array_compact(F.array(*[f"b{e}" for e in range(max_epochs)])).alias("begins"))
