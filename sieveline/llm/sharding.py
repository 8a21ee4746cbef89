"""Sharding by a two-pass external shuffle; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_rows, buckets_for, materialize, new_path, null_safe_hash, once_each, row_keys, sums_before

SEED = 40_009


def shuffled(docs: DataFrame, n_shards: int = 8, seed: int = SEED, bucket_bytes: int = 8 << 20) -> DataFrame:
    """row, shard, slot: whole records, scattered, shuffled and dealt.

    A pass over row hashes counts records, repeated ones among them, and bytes.  Pass 1 of the shuffle then scatters
    whole records into buckets of about ``bucket_bytes`` of text by a seeded hash, so a bucket fits in memory at any
    input size; copies of a fully repeated row have hashes of their own.  Pass 2 gives every bucket its Fisher-Yates
    shuffle (Spark's ``shuffle`` of the bucket's array in hash order, one seeded generator a partition, buckets of a
    partition in order: reruns and recomputed tasks agree) and numbers all records along the buckets.  The numbers are
    cut into ``n_shards`` runs of equal length: counts are at most one apart.  slot is the place in the shard, from 0.

    Null text: no bytes.  Null ids and fully repeated rows are records of their own.  Empty table: no rows.
    All columns travel in row, whatever their names.
    """
    size = F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 64
    light = docs.select(*row_keys(docs), size.cast("long").alias("size"))
    light = materialize(light.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.max("size").alias("size")), "shard-keys")
    all_ = light.agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("size")).alias("bytes")).first()
    total = all_["n"] or 0
    n_buckets = buckets_for(all_["bytes"] or 0, bucket_bytes)
    copies = F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy_no")
    at = F.pmod(null_safe_hash("k1", "k2", "copy_no", seed=seed), F.lit(n_buckets)).alias("bucket")

    repeated = materialize(light.where("n > 1").select("k1", "k2", "n"), "shard-repeated")
    rows = once_each(as_rows(docs), repeated.select("k1", "k2"))
    if not repeated.isEmpty():
        few = repeated.count() <= 500_000  # 16 MB
        rows = rows.join(F.broadcast(repeated) if few else repeated, ["k1", "k2"], "left").withColumn("n", F.coalesce("n", F.lit(1)))
        rows = rows.select("k1", "k2", copies, "row")
    else:
        rows = rows.withColumn("copy_no", F.lit(1))
    scattered = rows.withColumn("bucket", at).repartition(min(n_buckets, 20_000), "bucket")
    full = scattered.groupBy("bucket").agg(F.collect_list(F.struct("k1", "k2", "copy_no", "row")).alias("r"))

    def by_key(x, y):
        less = lambda c: F.when(x[c] < y[c], -1).when(x[c] > y[c], 1)
        return F.coalesce(less("k1"), less("k2"), less("copy_no"), F.lit(0))

    full = full.withColumn("r", F.array_sort("r", by_key))
    mixed = full.sortWithinPartitions("bucket").select("bucket", F.shuffle("r", F.lit(seed)).alias("r"))
    sizes = light.select("k1", "k2", copies).groupBy(at).agg(F.count("*").alias("n"))
    sizes = materialize(sums_before(sizes, [], "bucket", "n").select("bucket", "before"), "shard-buckets")
    sizes = F.broadcast(sizes) if n_buckets <= 500_000 else sizes  # 8 MB
    placed = mixed.join(sizes, "bucket").select("before", F.posexplode("r").alias("i", "x"))
    placed = placed.select("x.row", (F.col("before") + F.col("i")).alias("place"))
    placed = placed.withColumn("shard", F.expr(f"place * {n_shards}L div {max(total, 1)}L").cast("int"))
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return placed.select("row", "shard", (F.col("place") - first).cast("long").alias("slot"))


def write_shards(docs: DataFrame, path: str, n_shards: int = 8, seed: int = SEED, bucket_bytes: int = 8 << 20) -> None:
    """Write whole rows of ``docs`` to ``path``/shard=K, several files a shard where it is large; slot gives their order.

    A column of ``docs`` that is called shard or slot is written with an underscore after its name.
    """
    out = shuffled(docs, n_shards, seed, bucket_bytes)
    cols = [F.col("row")[c].alias(_free(c, docs.columns)) for c in docs.columns]
    out.select(*cols, "shard", "slot").write.partitionBy("shard").parquet(path)


def _free(name: str, names: list[str]) -> str:
    if name.lower() not in ("shard", "slot"):
        return name
    while name.lower() in ("shard", "slot", *[n.lower() for n in names]):
        name += "_"
    return name


def shard(docs: DataFrame, n_shards: int = 8, seed: int = SEED, bucket_bytes: int = 8 << 20, path: str | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of the records in the shards that it writes and reads back.

    Law ``rows``: counts at most one apart; grown_shard is null (law ``key`` only).  size is bytes of the text plus one
    (null text: one).  The shards stay in ``path``, a new folder of the shared one unless given.
    """
    path = path or new_path(docs.sparkSession, "shards")
    write_shards(docs, path, n_shards, seed, bucket_bytes)
    return digests(docs.sparkSession, path)


def digests(spark: SparkSession, path: str) -> DataFrame:
    # the files' own schema is asked for: a table without rows has no file
    found = spark.read.schema("doc_id long, text string, slot long, shard int").parquet(path)
    text = F.coalesce(F.col("text"), F.lit(""))
    return found.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.lit("rows").alias("law"),
        F.col("shard").cast("int").alias("shard"),
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
