"""Embedding near-duplicates by spherical-cap filters with structured random product codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, key_runs, local_roots, materialize

SEED = 70_001


def _sphere(dim: int, cells: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Inner products of a fixed unit vector with a random one, and their probabilities."""
    if dim == 1:
        return np.array([-1.0, 1.0]), np.array([0.5, 0.5])
    angle = (np.arange(cells) + 0.5) * math.pi / cells
    weight = np.sin(angle) ** (dim - 2)
    return -np.cos(angle), weight / weight.sum()


class Plan:
    """How deep the caps are and how many directions there are, from the number of vectors and the threshold.

    A cap holds about ``per_cap`` unrelated vectors of ``n``; a vector lies in about ``caps`` caps, so many that
    two vectors at exactly the threshold miss each other with probability ``miss`` if caps were independent,
    times ``spare`` because those of a product code are not quite.
    """

    def __init__(self, n: int, dim: int, cosine: float, per_cap: int = 64, miss: float = 1e-5, spare: float = 2.0, codes: int = 12):
        self.dim, self.cosine, self.codes = dim, cosine, codes
        share = min(0.02, per_cap / max(n, 1))
        # the cap: the least inner product that this share of directions reaches
        s, p = _sphere(dim)
        above = np.cumsum(p[::-1])[::-1]
        self.least = float(s[np.flatnonzero(above <= share)[0]]) if (above <= share).any() else float(s[-1])
        # of the directions whose cap holds a vector, those whose cap also holds one at the threshold
        inside = s >= self.least
        v, q = _sphere(max(1, dim - 1), 500)
        other = cosine * s[inside][:, None] + math.sqrt(1 - cosine**2) * np.sqrt(1 - s[inside] ** 2)[:, None] * v[None, :]
        both = float(((other >= self.least) @ q) @ p[inside] / p[inside].sum())
        both = min(max(both, 0.05), 0.999)
        self.caps = math.ceil(spare * math.log(miss) / math.log(1 - both))
        # vectors of fewer caps are compared with all others
        self.few = max(1, self.caps // 6)
        per_code = self.caps / share / codes
        # words of few components cannot share a vector's length evenly: no structure there
        self.blocks = 1 if dim < 16 else max(2, math.ceil(math.log2(max(per_code, 2)) / 12))
        self.size = max(2, math.ceil(per_code ** (1 / self.blocks)))
        self.cap_number = np.int32 if codes * self.size**self.blocks < 2**31 else np.int64
        self.cuts = [round(i * dim / self.blocks) for i in range(self.blocks + 1)]

    def books(self) -> list[list[np.ndarray]]:
        """Code words of each code and block, unit vectors from a fixed seed, alike on all workers."""
        out = []
        for code in range(self.codes):
            rng = np.random.default_rng([SEED, code, self.dim])
            book = []
            for i in range(self.blocks):
                w = rng.standard_normal((self.size, self.cuts[i + 1] - self.cuts[i]))
                book.append(w / np.linalg.norm(w, axis=1, keepdims=True))
            out.append(book)
        return out

    def rotation(self) -> np.ndarray:
        """A random rotation from a fixed seed: after it, length is shared among the blocks alike for any kind of vectors."""
        q, r = np.linalg.qr(np.random.default_rng([SEED, self.dim, 1]).standard_normal((self.dim, self.dim)))
        return q * np.where(np.diag(r) < 0, -1.0, 1.0)

    def decode(self, products: list[np.ndarray]) -> np.ndarray:
        """Indexes of all code words whose inner product with a vector exceeds the cap, from its block products.

        Blocks are joined one by one; a beginning stays only if the best of the other blocks can complete it.
        """
        need = self.least * math.sqrt(self.blocks)
        best = [p.max() for p in products]
        rest = [sum(best[i + 1 :]) for i in range(self.blocks)]
        keep = np.flatnonzero(products[0] >= need - rest[0])
        sums, index = products[0][keep], keep
        for i in range(1, self.blocks):
            order = np.argsort(-products[i])
            falling = products[i][order]
            counts = np.searchsorted(-falling, -(need - rest[i] - sums), side="right")
            at = np.repeat(np.arange(len(sums)), counts)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(counts) - counts, counts)
            sums, index = sums[at] + falling[inner], index[at] * self.size + order[inner]
        return index


def _unit(rows: np.ndarray) -> np.ndarray:
    big = np.abs(rows).max(axis=1, keepdims=True)
    rows = rows / big
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


#: Bits of a vector's signature, and how many standard deviations beyond the mean a pair at the threshold may differ in.
SIGNATURE, SPREAD = 256, 6.0


def _rows(batch: pa.RecordBatch, column: int, dim: int) -> np.ndarray:
    return np.asarray(batch.column(column).flatten(), np.float64).reshape(-1, dim)


def cap_members(classes: DataFrame, plan: Plan) -> DataFrame:
    """cap, vec_id, signature: a row for each cap that holds a vector; the signature is its sides of random planes.

    A vector of fewer than ``plan.few`` caps has one row, its cap is -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, per_code, turn = plan.books(), plan.size**plan.blocks, plan.rotation()
        planes = np.random.default_rng([SEED, plan.dim]).standard_normal((plan.dim, SIGNATURE))
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                u = _unit(_rows(batch, 1, plan.dim)) @ turn
                products = [
                    [u[:, plan.cuts[i] : plan.cuts[i + 1]] @ book[i].T for i in range(plan.blocks)] for book in books
                ]
                caps = [
                    np.concatenate([plan.decode([p[r] for p in products[c]]) + c * per_code for c in range(plan.codes)])
                    for r in range(len(u))
                ]
                caps = [c if len(c) >= plan.few else np.array([-1]) for c in caps]
                take = pa.array(np.repeat(np.arange(len(u)), [len(c) for c in caps]))
                sides = pa.array([b.tobytes() for b in np.packbits(u @ planes > 0, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(caps).astype(np.int64)), batch.column(0).take(take), sides.take(take)],
                    names=["cap", "vec_id", "signature"],
                )

    return classes.select("vec_id", "embedding").mapInArrow(run, "cap long, vec_id long, signature binary")


def _in_blocks(entries: DataFrame, block: int) -> DataFrame:
    """Entries by (cap, i, j): blocks of a cap meet each other, rows of a pair of blocks stand together.

    A cap of one block has the pair (0, 0).  own is a row's block.  Only caps of several blocks need their size:
    where these are at most 200,000 (5 MB) they are broadcast, otherwise entries are shuffled to meet them.
    """
    sizes = entries.groupBy("cap").agg(F.count("*").alias("held")).where(F.col("held") > block)
    large = materialize(sizes.select("cap", F.ceil(F.col("held") / block).cast("int").alias("blocks")), "caps-large")
    if large.count() <= 200_000:
        large = F.broadcast(large)
    e = entries.join(large, "cap", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    e = e.withColumn("own", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    e = e.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = [c for c in entries.columns if c != "cap"]
    e = e.select("cap", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", *rest)
    return e.repartition("cap", "i", "j").sortWithinPartitions("cap", "i", "j")


def promising(members: DataFrame, plan: Plan, block: int) -> DataFrame:
    """vec_id, caps: for vectors that may have a link, the caps in which another one's signature is near enough.

    Signatures of vectors at the threshold differ in a binomial number of bits; a pair is passed over only beyond
    ``SPREAD`` deviations.  Only what is left needs its components sent to its caps.
    """
    p = math.acos(plan.cosine) / math.pi
    most = SIGNATURE * p + SPREAD * math.sqrt(SIGNATURE * p * (1 - p))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (cap, i, j), t in key_runs(batches, 3):
            side, ids = t.column(3).to_numpy(), t.column(4).to_numpy()
            bits = np.unpackbits(np.frombuffer(b"".join(t.column(5).to_pylist()), np.uint8).reshape(len(ids), -1), axis=1)
            x = bits.astype(np.float32) * 2 - 1
            near = x @ x.T >= SIGNATURE - 2 * most
            np.fill_diagonal(near, False)
            if i != j:
                near &= side[:, None] != side[None, :]
            hit = near.any(axis=1)
            if hit.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(hit.sum(), cap), pa.int64()), pa.array(ids[hit], pa.int64())], names=["cap", "vec_id"])

    found = _in_blocks(members, block).mapInArrow(run, "cap long, vec_id long")
    return found.groupBy("vec_id").agg(F.collect_set("cap").alias("caps"))


def cap_entries(classes: DataFrame, plan: Plan, number: type = np.float64) -> DataFrame:
    """cap, vec_id, copies, vector, caps from (vec_id, copies, embedding, caps): a row a cap, components as ``number``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                x = _rows(batch, 2, plan.dim).astype(number)
                caps = [np.sort(np.array(c, np.int64)) for c in batch.column(3).to_pylist()]
                take = pa.array(np.repeat(np.arange(len(caps)), [len(c) for c in caps]))
                vectors = pa.array([v.tobytes() for v in x], pa.binary())
                lists = pa.array([c.astype(plan.cap_number).tobytes() for c in caps], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(caps)), batch.column(0).take(take), batch.column(1).take(take), vectors.take(take), lists.take(take)],
                    names=["cap", "vec_id", "copies", "vector", "caps"],
                )

    return classes.select("vec_id", "copies", "embedding", "caps").mapInArrow(
        run, "cap long, vec_id long, copies long, vector binary, caps binary"
    )


def lone_links(lone: DataFrame, classes: DataFrame, plan: Plan, chunk: int = 16_384) -> DataFrame:
    """vec_id, n, root: links of vectors of few caps (vec_id, copies, embedding; written) with all of ``classes``, exactly.

    ``chunk`` of them at a time go to the workers.  Two lone vectors meet twice; each counts the other once.
    """
    spark = classes.sparkSession
    out = spark.createDataFrame([], "vec_id long, n long, root long")
    n = lone.count()
    chunks = -(-n // chunk)
    part = lone.withColumn("chunk", F.pmod(F.xxhash64("embedding"), F.lit(max(chunks, 1))))
    for k in range(chunks):
        t = part.where(F.col("chunk") == k).select("vec_id", "copies", "embedding").toArrow()
        rows = np.asarray(t.column(2).combine_chunks().flatten(), np.float64).reshape(-1, plan.dim)
        sent = spark.sparkContext.broadcast((t.column(0).to_numpy(), t.column(1).to_numpy(), rows))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            lone_ids, lone_copies, lone_rows = sent.value
            lone_units = _unit(lone_rows) if len(lone_rows) else lone_rows
            for whole in batches:
                for at in range(0, whole.num_rows, 512):
                    batch = whole.slice(at, 512)
                    x, ids = _rows(batch, 2, plan.dim), batch.column(0).to_numpy()
                    copies, is_lone, u = batch.column(1).to_numpy(), batch.column(3).to_numpy(zero_copy_only=False), _unit(x)
                    for a in range(0, len(lone_ids), 512):
                        near = u @ lone_units[a : a + 512].T >= plan.cosine
                        own_ids, own_copies = lone_ids[a : a + 512], lone_copies[a : a + 512]
                        for i, j in np.argwhere(near & (ids[:, None] == own_ids[None, :])):
                            near[i, j] = not np.array_equal(x[i], lone_rows[a + j])
                        r, c = near.any(axis=1), near.any(axis=0)
                        if not r.any():
                            continue
                        both = near[r][:, c].astype(np.int64)
                        links = np.concatenate([both @ own_copies[c], both.T @ np.where(is_lone[r], 0, copies[r])])
                        square = np.zeros((sum(both.shape),) * 2, bool)
                        square[: len(both), len(both) :] = both
                        square |= square.T
                        members = np.concatenate([ids[r], own_ids[c]])
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(v, pa.int64()) for v in (members, links, local_roots(square, members))], names=["vec_id", "n", "root"]
                        )

        out = out.union(classes.select("vec_id", "copies", "embedding", "lone").mapInArrow(run, "vec_id long, n long, root long"))
    return out


def _compare(key: tuple, ids, copies, side, x, caps, cosine: float):
    """Link counts and local roots of one block pair of a cap: a pair counts in its smallest shared cap only."""
    cap, i, j = key
    u = _unit(x)
    near = u @ u.T >= cosine
    np.fill_diagonal(near, False)
    if i != j:
        near &= side[:, None] != side[None, :]
    hit = near.any(axis=1)
    if not hit.any():
        return None
    near, ids, copies, caps = near[hit][:, hit], ids[hit], copies[hit], [c for c, h in zip(caps, hit) if h]
    smaller = [c[c < cap] for c in caps]
    flat = np.concatenate(smaller)
    first = near
    if len(flat):
        names, column = np.unique(flat, return_inverse=True)
        # caps that only one of these vectors lies in are no pair's
        held = np.zeros((len(ids), len(names)), np.float32)
        held[np.repeat(np.arange(len(ids)), [len(s) for s in smaller]), column] = 1
        held = held[:, held.sum(axis=0) > 1]
        first = near & (held @ held.T == 0)
    links = first.astype(np.int64) @ copies
    return ids, links, local_roots(near, ids)


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, block: int = 512, per_cap: int = 64) -> DataFrame:
    """vec_id, n_links, component_id, kept: a row for each row of ``vectors`` (vec_id, embedding).

    Equal vectors are one class with a number of copies.  Each class goes to all caps that hold it, found by
    list decoding, first as a short signature only.  Where another signature of a cap is near enough, both go there
    with their components: vectors of a cap are compared in double precision, blocks of ``block`` with blocks, so a
    cap that holds a third of all vectors is spread over tasks and nothing is capped.  A pair that shares
    several caps counts in the smallest only, and pairs are never written: a block pair gives a count and a
    local root a vector.  Vectors are rotated at random first, so that their kind (padded, sparse, of few directions)
    does not matter; one that falls in too few caps all the same is compared with all (``lone_links``).  Pairs below ``cosine`` are never linked; pairs at it are found with the recall that
    ``Plan`` states, higher ones surely.

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing.  Vectors of
    unlike length never meet.  Null ids: a row of its own, linked with nothing.  Rows that repeat an id count as
    vectors of their own.  Empty table: no rows.  Only vec_id and embedding are read.
    """
    spark = vectors.sparkSession
    # components of single precision travel as such and are compared as doubles all the same
    number = np.float32 if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else np.float64
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    e = F.col("embedding")
    good = F.col("vec_id").isNotNull() & e.isNotNull() & F.coalesce(
        F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False)
    )
    rows = v.withColumn("good", good)
    classes = rows.where("good").groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies"))
    classes = materialize(classes, "caps-classes")
    parts = []
    for dim, n in [tuple(r) for r in classes.groupBy(F.size("embedding").alias("dim")).count().collect()]:
        plan = Plan(n, dim, cosine, per_cap)
        own = classes.where(F.size("embedding") == dim)
        members = materialize(cap_members(own, plan), "caps-members")
        lone = members.where("cap < 0").select("vec_id").distinct().withColumn("lone", F.lit(True))
        lone = materialize(own.join(lone, "vec_id", "left").withColumn("lone", F.coalesce("lone", F.lit(False))), "caps-lone")
        parts.append(lone_links(lone.where("lone"), lone, plan))
        maybe = promising(members.where("cap >= 0"), plan, block)
        entries = cap_entries(own.join(materialize(maybe, "caps-promising"), "vec_id"), plan, number)
        parts.append(_links(materialize(entries, "caps-entries"), plan, number, block))
    found = spark.createDataFrame([], "vec_id long, n long, root long")
    for p in parts:
        found = found.union(p)
    found = materialize(found, "caps-links")
    counts = found.groupBy("vec_id").agg(F.sum("n").alias("n"))
    comps = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    c = classes.join(counts, "vec_id", "left").join(comps.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    c = c.select(
        F.col("embedding").alias("ce"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "vec_id").alias("component_id"),
    )
    out = rows.withColumn("je", F.when(F.col("good"), F.col("embedding"))).join(c, F.col("je") == F.col("ce"), "left")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _links(entries: DataFrame, plan: Plan, number: type, block: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, t in key_runs(batches, 3):
            x = np.frombuffer(b"".join(t.column(6).to_pylist()), number).reshape(-1, plan.dim).astype(np.float64)
            caps = [np.frombuffer(b, plan.cap_number) for b in t.column(7).to_pylist()]
            got = _compare(key, t.column(4).to_numpy(), t.column(5).to_numpy(), t.column(3).to_numpy(), x, caps, plan.cosine)
            if got is not None:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in got], names=["vec_id", "n", "root"])

    return _in_blocks(entries, block).mapInArrow(run, "vec_id long, n long, root long")
