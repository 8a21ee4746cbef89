"""MinHash near-duplicates with bottom-k sketches of one hash function and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, in_worker, key_runs, local_roots, materialize

WORD_CACHE = 1 << 16
_words: dict[bytes, int] = {}


def _word_hash(word: bytes) -> int:
    h = _words.get(word)
    if h is None:
        if len(_words) >= WORD_CACHE:
            _words.clear()
        h = _words[word] = xxhash.xxh3_64_intdigest(word)
    return h


def release() -> None:
    """Drops this worker's word hashes; called by name, so that the worker's own ones go."""
    _words.clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Distinct hashes of a text's word shingles, sorted as unsigned numbers.

    A-Z are lower-cased; words are runs of other characters than space and x09-x0D.  Fewer words than
    ``width``: the whole sequence as one shingle; none: an empty set.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_word_hash, words), np.uint64, len(words))
    width = min(width, len(words))
    n = len(words) - width + 1
    out = np.full(n, width, np.uint64)
    for i in range(width):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out)


def sketches(docs: DataFrame, width: int, k: int) -> DataFrame:
    """doc_id, n_shingles, g1, g2, sketch: the k smallest hashes, and two hashes of the whole set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):  # bounds the sets in memory
                batch = whole.slice(at, 1024)
                n, g1, g2, values, ends = [], [], [], [], [0]
                for text in batch.column(1):
                    s = shingle_set(text.as_py(), width)
                    raw = memoryview(s).cast("B") if len(s) else b""
                    n.append(len(s))
                    g1.append(xxhash.xxh3_64_intdigest(raw, 1) - 2**63)
                    g2.append(xxhash.xxh3_64_intdigest(raw, 2) - 2**63)
                    values.append(s[:k].view(np.int64).copy())  # a copy, or the whole set would stay
                    ends.append(ends[-1] + min(k, len(s)))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).cast(pa.int64()),
                        pa.array(n, pa.int64()),
                        pa.array(g1, pa.int64()),
                        pa.array(g2, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(values))),
                    ],
                    names=["doc_id", "n_shingles", "g1", "g2", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(in_worker(run, "minhash", release), "doc_id long, n_shingles long, g1 long, g2 long, sketch array<long>"
    )


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, shingles of whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):  # bounds the sets in memory
                batch = whole.slice(at, 256)
                sets = [shingle_set(t.as_py(), width).view(np.int64) for t in batch.column(1)]
                ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).cast(pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets)))],
                    names=["doc_id", "shingles"],
                )

    return docs.select("doc_id", "text").mapInArrow(in_worker(run, "minhash", release), "doc_id long, shingles array<long>")


def inverted_lists(reps: DataFrame, threshold: float, slack: float, k: int) -> DataFrame:
    """value, doc_id, n: the lists a document must share one of with any document it may link to.

    Two sketches that pass the estimate share at least ``need`` values, so they share one among the
    k - need + 1 values of a document that are rarest over all sketches.  Values of one sketch only are
    rarest and need no list; very common ones come last, so a passage that many documents share lists only
    documents that are made of little else.
    """
    values = reps.select("doc_id", "n_shingles", F.explode("sketch").alias("value"))
    common = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    shared = values.join(common, "value")
    held = F.least(F.col("n_shingles"), F.lit(k))
    # a sketch that is the whole set, as are those of its possible partners, needs no allowance
    part = F.when(F.col("n_shingles") <= int(k * threshold), F.lit(threshold)).otherwise(F.lit(threshold - slack))
    per = shared.groupBy("doc_id", "n_shingles").agg(F.array_sort(F.collect_list(F.struct("df", "value"))).alias("v"))
    room = (held - F.ceil(held * part - 1e-9) + 1 - (held - F.size("v"))).cast("int")
    per = per.select("doc_id", F.col("n_shingles").alias("n"), "v", room.alias("room")).where("room > 0")
    return per.select(F.explode(F.slice("v", F.lit(1), F.col("room"))).alias("x"), "doc_id", "n").select("x.value", "doc_id", "n")


def salted(lists: DataFrame, most: int = 2048) -> tuple[DataFrame, DataFrame]:
    """``lists`` with a salt, and (value, parts; written) of the lists of over ``most`` documents, which are cut in ``parts`` by it.

    So whatever meets a list by (value, salt) is dealt over many tasks.  These values are at most one in ``most`` rows;
    they are broadcast where they are at most 200,000 (4 MB).
    """
    held = lists.groupBy("value").agg(F.count("*").alias("n")).where(F.col("n") > most)
    long_ = materialize(held.select("value", F.ceil(F.col("n") / most).cast("int").alias("parts")), "minhash-long")
    known = F.broadcast(long_) if long_.count() <= 200_000 else long_
    salt = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.col("parts"))).cast("int")
    return lists.join(known, "value", "left").withColumn("salt", salt).drop("parts"), known


def _for_salts(of_value: DataFrame, long_: DataFrame) -> DataFrame:
    """Rows of one a value, once for each part of its list."""
    salts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("salt")
    return of_value.join(long_, "value", "left").select(*of_value.columns, salts)


def estimated(pairs: DataFrame, reps: DataFrame, threshold: float, slack: float, k: int) -> DataFrame:
    """Pairs (a, b) whose union sketch leaves a similarity of ``threshold`` possible; exact if both sketches are whole sets."""
    sk = reps.select("doc_id", "sketch", F.col("n_shingles").alias("n"))
    p = pairs.join(sk.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"), F.col("n").alias("nb")), "b")
    p = p.join(sk.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"), F.col("n").alias("na")), "a")
    # hashes are ordered as unsigned numbers: flip the sign for Spark's order
    flip = lambda c: F.transform(c, lambda x: x.bitwiseXOR(F.lit(-(2**63)).cast("long")))
    whole = F.greatest("na", "nb") <= k
    union = F.array_sort(F.array_union(flip(F.col("sa")), flip(F.col("sb"))))
    union = F.when(whole, union).otherwise(F.slice(union, 1, k))  # of whole sets, the whole union
    both = F.array_intersect(F.array_intersect(flip(F.col("sa")), flip(F.col("sb"))), F.col("u"))
    p = p.withColumn("u", union)
    part = F.when(whole, F.lit(threshold)).otherwise(F.lit(threshold - slack))
    return p.where(F.size(both) >= F.size("u") * part - 1e-9).select("a", "b")


def verified(pairs: DataFrame, docs: DataFrame, width: int, num: int, den: int, broadcast_ids: int = 1_000_000) -> DataFrame:
    """Pairs (a, b) with den * |A and B| >= num * |A or B| on full sets, made from whole texts."""
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "minhash-ids")
    sets = materialize(full_sets(_wanted(docs, ids, broadcast_ids), width), "minhash-sets")
    p = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb")), "b")
    p = p.join(sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa")), "a")
    shared = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - F.col("shared")
    p = p.withColumn("shared", shared)
    return p.where(F.col("shared") * den >= union * num).select("a", "b")


def _wanted(docs: DataFrame, ids: DataFrame, broadcast_ids: int) -> DataFrame:
    """Documents with an id in ``ids`` (unique, written), one row an id; 8 MB of ids at most are broadcast."""
    ids = F.broadcast(ids) if ids.count() <= broadcast_ids else ids
    return docs.join(ids, "doc_id", "left_semi").dropDuplicates(["doc_id"])


def compared_in_blocks(
    left: DataFrame, docs: DataFrame, width: int, num: int, den: int, block: int = 256, broadcast_ids: int = 1_000_000
) -> DataFrame:
    """Links (a, b) among members of long open lists (value, doc_id, c): full sets, compared block by block.

    Lists that share documents make a family.  In a family the largest component needs no comparison within;
    all other members are compared with everyone, blocks of ``block`` documents with blocks.  A block pair
    counts shared shingles by a product of incidence matrices over shingles that at least two of its documents
    hold, and gives each linked document its local root, so no pair is ever written.
    """
    tie = left.groupBy("value").agg(F.min("doc_id").alias("lo"))
    families = connected_components(left.join(tie, "value").select(F.col("doc_id").alias("a"), F.col("lo").alias("b")))
    m = left.select("doc_id", "c").distinct().join(families.toDF("doc_id", "family"), "doc_id")
    m = materialize(m, "minhash-families")
    per = m.groupBy("family", "c").agg(F.count("*").alias("held"))
    per = per.groupBy("family").agg(F.max(F.struct("held", "c")).alias("big"), F.sum("held").alias("all"))
    per = per.select(
        "family",
        F.col("big.c").alias("big"),
        F.ceil(F.col("big.held") / block).cast("int").alias("nb"),
        F.ceil((F.col("all") - F.col("big.held")) / block).cast("int").alias("ns"),
    ).where("ns > 0")
    m = m.join(per, "family").withColumn("large", F.col("c") == F.col("big"))
    own = F.pmod(F.xxhash64("doc_id"), F.when(F.col("large"), F.col("nb")).otherwise(F.col("ns"))).cast("int")
    m = m.withColumn("own", own)
    to_small = F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda i: F.struct(
        F.lit(0).alias("kind"), F.least("own", i).alias("i"), F.greatest("own", i).alias("j")))
    to_large = F.transform(F.sequence(F.lit(0), F.col("nb") - 1), lambda i: F.struct(F.lit(1).alias("kind"), F.col("own").alias("i"), i.alias("j")))
    from_large = F.transform(F.sequence(F.lit(0), F.col("ns") - 1), lambda i: F.struct(F.lit(1).alias("kind"), i.alias("i"), F.col("own").alias("j")))
    at = F.explode(F.when(F.col("large"), from_large).otherwise(F.concat(to_small, to_large)))
    m = m.select("family", "doc_id", "c", at.alias("at"))
    sets = full_sets(_wanted(docs, materialize(m.select("doc_id").distinct(), "minhash-ids"), broadcast_ids), width)
    m = m.join(materialize(sets, "minhash-sets"), "doc_id").select("family", "at.kind", "at.i", "at.j", "doc_id", "c", "shingles")
    m = m.repartition("family", "kind", "i", "j").sortWithinPartitions("family", "kind", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, t in key_runs(batches, 4):
            ids, comps = t.column(4).to_numpy(), t.column(5).to_numpy()
            if (comps == comps[0]).all():
                continue
            sets = t.column(6).combine_chunks()
            sizes = np.diff(sets.offsets.to_numpy())
            row = np.repeat(np.arange(len(ids)), sizes)
            names, column, held = np.unique(np.asarray(sets.flatten()), return_inverse=True, return_counts=True)
            shared = np.flatnonzero(held > 1)
            place = np.full(len(names), -1)
            place[shared] = np.arange(len(shared))
            column = place[column]
            both = np.zeros((len(ids), len(ids)), np.float32)
            for start in range(0, len(shared), 4096):
                here = (column >= start) & (column < start + 4096)
                x = np.zeros((len(ids), min(4096, len(shared) - start)), np.float32)
                x[row[here], column[here] - start] = 1
                both += x @ x.T
            both = both.astype(np.int64)
            near = both * den >= (sizes[:, None] + sizes[None, :] - both) * num
            near &= ids[:, None] != ids[None, :]
            hit = near.any(axis=1)
            if hit.any():
                roots = local_roots(near[hit][:, hit], ids[hit])
                yield pa.RecordBatch.from_arrays([pa.array(ids[hit], pa.int64()), pa.array(roots, pa.int64())], names=["a", "b"])

    return m.mapInArrow(in_worker(run, "minhash", release), "a long, b long").where("a <> b")


def near_duplicates(
    docs: DataFrame,
    width: int = 5,
    num: int = 80,
    den: int = 100,
    k: int = 64,
    slack: float = 0.25,
    star_rounds: int = 2,
    short_list: int = 16,
    list_part: int = 2048,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: a row for each row of ``docs``.

    Documents are linked where den * |A and B| >= num * |A or B| on their sets of word shingles; a component's
    id is its smallest doc_id, and that document is kept.

    1. One pass over the texts makes bottom-k sketches of one hash function; documents with equal sets are one
       class from here on, represented by the smallest id.
    2. Inverted lists of the rarest retained values (``inverted_lists``) bring possible partners together.
    3. Star rounds: each list's members are compared with one center, by union sketch, then on full sets.
       Verified links make components; a list whose members are all of one component is done.  Large groups
       of near copies end here, with about one comparison a document.
    4. What is left: pairs of different components that still share a list of at most ``short_list`` documents
       are compared one by one; longer lists are compared in blocks (``compared_in_blocks``).  Pairs within a
       component need no comparison: they are linked already.

    Nothing is capped or dropped.  A link at exactly the threshold passes the sketch filter with probability
    1 - 5e-6 or more (k = 64, slack 0.25: binomial tails 4.2e-6 at 0.8, 6.3e-7 at 0.85), higher ones nearly always; sets of at most k * threshold shingles exactly.

    Null or empty text: an empty set, linked with nothing.  Null ids link with nothing (component null).
    Rows that repeat an id are one document if their texts are equal; ids are expected to be unique otherwise.
    Empty table: no rows.  Only doc_id and text are read.
    """
    docs = docs.select("doc_id", "text")
    threshold = num / den
    d = materialize(sketches(docs, width, k), "minhash-sketches")
    classes = (
        d.where("n_shingles > 0 and doc_id is not null").groupBy("g1", "g2").agg(F.min("doc_id").alias("rep"))
    )
    classes = materialize(classes, "minhash-classes")
    reps = d.join(classes.select(F.col("rep").alias("doc_id"), "g1", "g2"), ["doc_id", "g1", "g2"], "left_semi")
    reps = materialize(reps.select("doc_id", "n_shingles", "sketch").dropDuplicates(["doc_id"]), "minhash-reps")
    lists, long_values = salted(materialize(inverted_lists(reps, threshold, slack, k), "minhash-lists"), list_part)
    lists = materialize(lists, "minhash-salted")

    spark = docs.sparkSession
    links = spark.createDataFrame([], "a long, b long")
    comps = spark.createDataFrame([], "node long, component long")
    sizes_fit = (F.col("na") * num <= F.col("nb") * den) & (F.col("nb") * num <= F.col("na") * den)
    for r in range(star_rounds + 1):
        c = comps.select(F.col("node").alias("doc_id"), "component")
        m = lists.join(c, "doc_id", "left").select("value", "salt", "doc_id", "n", F.coalesce("component", "doc_id").alias("c"))
        open_ = m.groupBy("value").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min(F.struct(F.xxhash64("doc_id", F.lit(r)), "doc_id", "n", "c")).alias("m"), F.count("*").alias("held"))
        open_ = open_.where("lo < hi")
        if r < star_rounds:
            center = open_.select("value", F.col("m.doc_id").alias("a"), F.col("m.n").alias("na"), F.col("m.c").alias("ca"))
            both = m.join(_for_salts(center, long_values), ["value", "salt"])
            pairs = both.select("a", "na", "ca", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
            pairs = pairs.where("ca <> cb")
        else:
            left = materialize(m.join(_for_salts(open_.select("value", "held"), long_values), ["value", "salt"]), "minhash-open")
            long_ = left.where(F.col("held") > short_list)
            links = links.union(materialize(compared_in_blocks(long_, docs, width, num, den), "minhash-links"))
            left = left.where(F.col("held") <= short_list)
            x = left.select("value", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("c").alias("ca"))
            y = left.select("value", F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("c").alias("cb"))
            pairs = x.join(y, "value").where("ca < cb")
        pairs = pairs.where(sizes_fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = materialize(estimated(pairs, reps, threshold, slack, k), "minhash-candidates")
        found = materialize(verified(pairs, docs, width, num, den), "minhash-links")
        links = links.union(found)
        comps = materialize(connected_components(links), "minhash-components")
    of_class = classes.join(comps, classes["rep"] == comps["node"], "left").select(
        "g1", "g2", F.coalesce("component", "rep").alias("component")
    )
    linked = F.col("n_shingles") > 0
    out = d.select("doc_id", "n_shingles", "g1", "g2").join(of_class, ["g1", "g2"], "left")
    component = F.when(linked & F.col("doc_id").isNotNull(), F.col("component")).otherwise(F.col("doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
