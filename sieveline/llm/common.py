"""Shared pieces: materialised tables in the cluster's shared folder, hashing, components, table access."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; a temporary one only where it is unset (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        jsc = spark.sparkContext._jsc.sc()
        if jsc.getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="sieveline-"))
        found = jsc.getCheckpointDir().get()
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[str] = []


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    _written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, first: int = 0, keep: int = 0) -> int:
    """Delete the tables this session has written from the ``first`` on, but for the last ``keep``; call it when results that
    read them are written.  Returns how many there are still, to be the next call's ``first``."""
    last = max(first, len(_written) - keep)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in _written[first:last]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    del _written[first:last]
    return len(_written)


def null_safe_hash(*cols: Column | str, seed: int = 0) -> Column:
    """64-bit hash that tells a null from a missing column: Spark's own skips nulls."""
    parts: list[Column] = [F.lit(seed)]
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        parts += [c.isNull(), c]
    return F.xxhash64(*parts)


def row_keys(df: DataFrame) -> list[Column]:
    """k1, k2: two 64-bit hashes of all columns of a row, so that equal keys mean equal rows."""
    kinds = {f.name: f.dataType.typeName() for f in df.schema}
    cols = [F.map_entries(_named(c)) if kinds[c] == "map" else _named(c) for c in df.columns]
    return [null_safe_hash(*cols, seed=i).alias(f"k{i}") for i in (1, 2)]


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def as_rows(df: DataFrame) -> DataFrame:
    """k1, k2, row: a row travels as one value, so its columns may have any names."""
    return df.select(*row_keys(df), F.struct(*[_named(c) for c in df.columns]).alias("row"))


def once_each(rows: DataFrame, repeated: DataFrame, broadcast_rows: int = 500_000) -> DataFrame:
    """``rows`` (k1, k2, row) with one of each group of equal ones; ``repeated`` (k1, k2; written) are their keys.

    Only rows that are repeated are shuffled, one a task at most.  The keys are broadcast where they are at most
    ``broadcast_rows`` (16 MB).
    """
    n = repeated.count()
    if n == 0:
        return rows
    repeated = F.broadcast(repeated) if n <= broadcast_rows else repeated
    many = rows.join(repeated, ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("row").alias("row"))
    return rows.join(repeated, ["k1", "k2"], "left_anti").unionByName(many)


def word_count(text: Column) -> Column:
    """Number of maximal runs of characters other than space and x09-x0D; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def buckets_for(rows: int, per_bucket: int) -> int:
    return max(1, -(-rows // per_bucket))


_releases: dict[str, Callable[[], None]] = {}


def in_worker(run: Callable, name: str, release: Callable[[], None] | None = None) -> Callable:
    """A function for ``mapInArrow`` that keeps its Python worker small, and to one thread.

    Caches that other operators left in the worker are dropped when it starts; ``release`` empties the operator's
    own ones, which otherwise serve its next task there.  Free memory goes back to the system at the end.
    """

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        take_over(name, release)
        one_thread()
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def take_over(name: str, release: Callable[[], None] | None) -> None:
    for other in [n for n in _releases if n != name]:
        _releases.pop(other)()
    if release is not None:
        _releases[name] = release


def one_thread() -> None:
    """Numpy's matrix products in this worker use one thread: a task has one core, and helpers wait for work by spinning."""
    for path in (Path(np.__file__).parent.parent / "numpy.libs").glob("*openblas*"):
        lib = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_set_num_threads64_", "openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads"):
            if hasattr(lib, name):
                getattr(lib, name)(1)
                break


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def sums_before(blocks: DataFrame, part: list[str], order: str, amount: str, group: int = 1024) -> DataFrame:
    """Adds ``before``, the sum of ``amount`` over blocks with a smaller whole number ``order`` in the same part.

    Two levels: groups of neighbouring blocks are summed in order, blocks within their group only, so the one
    ordered pass over a part sees 1/``group`` of its blocks.
    """
    b = blocks.withColumn("_group", F.floor(F.col(order) / group))
    sums = b.groupBy(*part, "_group").agg(F.sum(amount).alias("_sum"))
    over = W.partitionBy(*part) if part else W.partitionBy(F.lit(0))
    before = over.orderBy("_group").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.select(*part, "_group", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_base"))
    inside = W.partitionBy(*part, "_group").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    b = b.withColumn("before", F.coalesce(F.sum(amount).over(inside), F.lit(0))).join(sums, [*part, "_group"])
    return b.withColumn("before", F.col("before") + F.col("_base")).drop("_group", "_base")


def key_runs(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Rows with equal first ``n_keys`` integer columns, from batches in which they stand together."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in range(n_keys)], axis=1)
        at = 0
        for end in [*(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1), len(keys)]:
            now = tuple(keys[at].tolist())
            if now != last and held:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(at, end - at))
            last, at = now, end
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def local_roots(near: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id that each row reaches over a matrix of links."""
    root = ids.copy()
    while True:
        lower = np.minimum(root, np.where(near, root[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (lower == root).all():
            return root
        root = lower


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) links -> (node, component) with component the smallest node reachable.

    Alternating large-star and small-star rounds on the edge table; each round is a grouped aggregate and a
    join, its edges are written to the shared folder, and only one number a round reaches the driver.  The
    large star of a hub is dealt by an aggregate and a join (AQE splits the hub's rows), never by collecting
    neighbours into one row.
    """
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a <> b")
    e = materialize(
        e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges"
    )

    def mark(x: DataFrame):
        row = x.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        return row["n"], row["s"]

    seen = mark(e)
    if seen[0] == 0:
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        # large star: every larger neighbour of u is linked to the smallest of u and its neighbours
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (
            both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        ).distinct()
        # small star: u and its smaller neighbours are linked to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v")))
        ).distinct()
        e = materialize(small, "cc-edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
