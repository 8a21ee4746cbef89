"""Document fingerprints by invertible Bloom lookup sketches; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import buckets_for, materialize

#: A paragraph is a line; a line of more than 32 words is cut into runs of 32, so long lines have several.
PARAGRAPH = r"(?:[^\s]+[^\S\n]*+){1,32}"


def paragraphs(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs, sorted; lines of white space have none."""
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PARAGRAPH), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(parts, lambda p: F.xxhash64(p))))


def _check(key: Column) -> Column:
    return F.xxhash64(F.lit(7919), key)


def _placed(keys: Column, width: int, salt: int) -> Column:
    """Keys with their check and three cells, one in each third of a sketch of 3 * ``width`` cells."""

    def place(k: Column) -> Column:
        h = F.xxhash64(F.lit(salt), k)
        part = lambda shift: F.pmod(F.shiftright(h, shift), F.lit(width)).cast("int")
        return F.struct(k.alias("k"), _check(k).alias("c"), part(0).alias("a"), (part(20) + width).alias("b"), (part(40) + 2 * width).alias("d"))

    return F.transform(keys, place)


def sketch(keys: Column, width: int, salt: int) -> Column:
    """3 * ``width`` cells; a cell has the number, xor of keys and xor of checks of the keys put into it."""

    def cell(placed: Column, j: Column) -> Column:
        zero = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
        here = F.filter(placed, lambda p: (p["a"] == j) | (p["b"] == j) | (p["d"] == j))
        return F.aggregate(
            here,
            zero,
            lambda s, p: F.struct((s["n"] + 1).alias("n"), s["k"].bitwiseXOR(p["k"]).alias("k"), s["c"].bitwiseXOR(p["c"]).alias("c")),
        )

    cells = lambda placed: F.transform(F.sequence(F.lit(0), F.lit(3 * width - 1)), lambda j: cell(placed, j))
    # a one-element array binds the placed keys once for all cells
    return F.transform(F.array(_placed(keys, width, salt)), cells)[0]


def subtract(a: Column, b: Column) -> Column:
    """Cell-wise difference: keys that both hold cancel out."""
    return F.zip_with(
        a, b,
        lambda x, y: F.struct((x["n"] - y["n"]).alias("n"), x["k"].bitwiseXOR(y["k"]).alias("k"), x["c"].bitwiseXOR(y["c"]).alias("c")),
    )


def peel(cells: Column, width: int, salt: int, rounds: int = 12) -> Column:
    """Number of keys that a difference sketch gives away, or null where it does not come empty.

    A cell with one key (number 1 or -1 and a fitting check) gives it away; all such keys leave all their
    cells, round by round.
    """
    def pure(now: Column) -> Column:
        found = F.filter(now, lambda c: (F.abs(c["n"]) == 1) & (_check(c["k"]) == c["c"]))
        h = lambda k: F.xxhash64(F.lit(salt), k)
        part = lambda k, shift: F.pmod(F.shiftright(h(k), shift), F.lit(width)).cast("int")
        return F.array_distinct(
            F.transform(
                found,
                lambda c: F.struct(
                    c["k"].alias("k"), c["c"].alias("c"), part(c["k"], 0).alias("a"), (part(c["k"], 20) + width).alias("b"),
                    (part(c["k"], 40) + 2 * width).alias("d"), c["n"].alias("n"),
                ),
            )
        )

    def without(now: Column, keys: Column) -> Column:
        return F.transform(
            now,
            lambda c, j: F.aggregate(
                F.filter(keys, lambda p: (p["a"] == j) | (p["b"] == j) | (p["d"] == j)),
                c,
                lambda s, p: F.struct((s["n"] - p["n"]).alias("n"), s["k"].bitwiseXOR(p["k"]).alias("k"), s["c"].bitwiseXOR(p["c"]).alias("c")),
            ),
        )

    def step(state: Column, _: Column) -> Column:
        return F.when(F.size(state["new"]) == 0, state).otherwise(
            F.transform(
                F.array(without(state["cells"], state["new"])),
                lambda now: F.struct(
                    now.alias("cells"), pure(now).alias("new"),
                    F.concat(state["out"], F.transform(state["new"], lambda p: p["k"])).alias("out"),
                ),
            )[0]
        )

    start = F.struct(cells.alias("cells"), pure(cells).alias("new"), F.array().cast("array<bigint>").alias("out"))
    done = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    empty = lambda s: F.forall(s["cells"], lambda c: (c["n"] == 0) & (c["k"] == 0) & (c["c"] == 0))
    return F.transform(F.array(done), lambda s: F.when(empty(s), F.size(s["out"])))[0]


def as_text(cells: Column, n_keys: Column) -> Column:
    """A sketch as text: the number of keys, then number:key of each cell in hexadecimal."""
    return F.concat_ws(
        ".", n_keys.cast("string"), F.array_join(F.transform(cells, lambda c: F.concat_ws(":", F.hex(c["n"].cast("long")), F.hex(c["k"]))), "-")
    )


def _solve(a: Column, b: Column, first_width: int, attempts: int) -> Column:
    """Number of keys in one of two small sets only: larger sketches until one peels to nothing."""
    tries = []
    for i in range(attempts):
        width, salt = first_width * 4**i, 101 + i
        tries.append(peel(subtract(sketch(a, width, salt), sketch(b, width, salt)), width, salt))
    return F.coalesce(*tries, F.raise_error(F.lit("a difference sketch did not peel")).cast("int"))


def in_groups(a: Column, b: Column, per_group: int = 6, attempts: int = 5) -> Column:
    """Number of keys that only one of two versions has, by sketches of groups of about ``per_group`` keys.

    Keys are dealt by two hashes to a square of groups, a group being a sketch of its own; one that does not
    peel is made again with four times the cells and another salt.  An expression for the few pairs whose
    one large sketch failed.
    """
    side = F.greatest(F.lit(1), F.ceil(F.sqrt((F.size(a) + F.size(b)) / per_group)).cast("int"))
    row = lambda k: F.pmod(F.shiftright(_check(k), 8), side)
    col = lambda k: F.pmod(F.shiftright(_check(k), 36), side)

    def of_row(i: Column) -> Column:
        both = F.struct(F.filter(a, lambda k: row(k) == i).alias("a"), F.filter(b, lambda k: row(k) == i).alias("b"))
        return F.transform(
            F.array(both),
            lambda s: F.aggregate(
                F.sequence(F.lit(0), side - 1),
                F.lit(0),
                lambda n, j: n + _solve(F.filter(s["a"], lambda k: col(k) == j), F.filter(s["b"], lambda k: col(k) == j), 8, attempts),
            ),
        )[0]

    return F.aggregate(F.sequence(F.lit(0), side - 1), F.lit(0), lambda n, i: n + of_row(i))


def likeness(a: Column, b: Column, diff: Column) -> Column:
    """Shared paragraphs over all paragraphs of two versions; two without any are alike."""
    both = F.size(a) + F.size(b)
    return F.when(both == 0, F.lit(1.0)).otherwise((both - diff).cast("double") / (both + diff).cast("double"))


def _constants(values: list, kind: str = "bigint") -> Column:
    """An array literal, made in one call."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def _at_most(values: list[int], x: Column) -> Column:
    """Place of the largest of ascending ``values`` that is not above x, by halving; 0 below all."""
    given = _constants(values)
    steps = _constants([1 << i for i in reversed(range(len(values).bit_length()))], "int")

    def halve(at: Column, step: Column) -> Column:
        further = F.least(at + step, F.lit(len(values) - 1))
        return F.when(F.get(given, further) <= x, further).otherwise(at)

    return F.aggregate(steps, F.lit(0), halve)


def even_ranges(docs: DataFrame, rows_per_bucket: int, most: int = 8192) -> tuple[Column, Column]:
    """Number of a row's range of (doc_id, th), ascending; ranges hold about ``rows_per_bucket`` rows each.

    Up to ``most`` quantiles of the ids bound segments; an id that spans several of them, and null ids, which come
    first, are cut by their text hashes th.  Where that many segments are too few, each is cut into ranges of equal
    width.  Only the quantiles reach the driver.  The number is an expression over doc_id, th
    and _i, the second expression returned: a row's segment.
    """
    count = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids")).first()
    segments = min(most, buckets_for(count["ids"], rows_per_bucket))
    subs = buckets_for(count["ids"], rows_per_bucket * segments)
    by_hash = (F.shiftright("th", 33) + (1 << 30)) / float(1 << 31)  # from 0 to 1, in the hashes' order
    blank = buckets_for(count["n"] - count["ids"], rows_per_bucket)
    of_null = F.floor(by_hash * blank).cast("long") - blank
    if not count["ids"]:
        return of_null, F.lit(0)
    at = [i / segments for i in range(segments + 1)]
    found = docs.agg(F.percentile_approx("doc_id", at, 8 * segments).alias("q"), F.min("doc_id").alias("lo")).first()
    values: list[int] = []
    hot: list[int] = []
    for q in [found["lo"], *found["q"][:-1]]:
        if values and q == values[-1]:
            hot[-1] += 1
        elif not values or q > values[-1]:
            values.append(q)
            hot.append(-1 if not values[1:] else 0)  # the least id stands in the list twice
    hot = [max(h, 0) * subs for h in hot]
    base = [0]
    for h in hot:
        base.append(base[-1] + h + subs)
    widths = [float(max(1, b - a)) for a, b in zip(values, [*values[1:], found["q"][-1] + 1])]
    i = _at_most(values, F.col("doc_id"))
    of = lambda xs, kind="bigint": F.get(_constants(xs, kind), F.col("_i"))
    inside = F.least(F.floor((F.col("doc_id").cast("double") - of(values, "double")) / of(widths, "double") * subs).cast("long"), F.lit(subs - 1))
    cut = F.when((F.col("doc_id") == of(values)) & (of(hot) > 0), F.floor(by_hash * of(hot)).cast("long")).otherwise(of(hot) + inside)
    return F.when(F.col("doc_id").isNull(), of_null).otherwise(of(base[:-1]) + cut), i


def next_document(docs: DataFrame, rows_per_bucket: int = 1024) -> DataFrame:
    """bucket, rid, doc_id, text, keys, n_chars, next_text, next_keys: documents beside their next by descending doc_id.

    keys are a text's paragraph digests, rid numbers the rows of a bucket.

    Ids are cut into ranges of about equal numbers of rows (``even_ranges``); the first document of a range also goes,
    as a ghost, to the range before it, the very first one to the last range.  So texts are shuffled once and a
    neighbour is found within its range.  The table of first ids has one row a range; it is broadcast only where its
    number of rows is at most 100,000.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    docs = docs.withColumn("th", F.xxhash64("text"))
    bucket, i = even_ranges(docs, rows_per_bucket)
    docs = docs.withColumn("_i", i).withColumn("b", bucket).drop("_i")
    key = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "th").alias("key")
    docs = docs.select("text", "b", key)
    firsts = docs.groupBy("b").agg(F.max("key").alias("top"))
    # the next range above that holds a document: within groups of ranges, then between groups, then around the end
    firsts = firsts.withColumn("g", F.floor(F.col("b") / 1024))
    groups = firsts.groupBy("g").agg(F.min("b").alias("lowest"))
    every = W.partitionBy(F.lit(0))
    groups = groups.select(
        "g", F.coalesce(F.lead("lowest").over(every.orderBy("g")), F.min("lowest").over(every)).alias("above")
    )
    up = F.lead("b").over(W.partitionBy("g").orderBy("b"))
    firsts = firsts.withColumn("up", up).join(groups, "g").select(F.col("b").alias("fb"), F.col("top").alias("top"), F.coalesce("up", "above").alias("ghost_of"))
    firsts = materialize(firsts, "fingerprint-firsts")
    if firsts.count() <= 100_000:
        firsts = F.broadcast(firsts)
    ghost = F.when(F.col("key") == F.col("top"), F.col("ghost_of"))
    dealt = docs.join(firsts, F.col("b") == F.col("fb")).select(
        F.explode(
            F.array_compact(
                F.array(
                    F.struct(F.col("b").alias("bucket"), F.lit(False).alias("ghost")),
                    F.when(ghost.isNotNull(), F.struct(ghost.alias("bucket"), F.lit(True).alias("ghost"))),
                )
            )
        ).alias("at"),
        "key",
        "text",
    )
    dealt = dealt.select("at.bucket", "at.ghost", "key", "text").repartition("bucket")
    order = W.partitionBy("bucket").orderBy("ghost", F.col("key").desc())
    dealt = dealt.withColumn("keys", paragraphs(F.col("text")))
    out = dealt.select(
        "*",
        F.row_number().over(order).alias("rid"),
        F.lead("text").over(order).alias("next_text"),
        F.lead("keys").over(order).alias("next_keys"),
    ).where(~F.col("ghost"))
    n_chars = F.length("text").cast("long").alias("n_chars")
    return out.select("bucket", "rid", F.col("key.doc_id").alias("doc_id"), "text", "keys", n_chars, "next_text", "next_keys")


def peeled(pairs: DataFrame, passes: int = 6) -> DataFrame:
    """bucket, pid, diff for rows that also have key arrays ``a`` and ``b``: the larger sketches.

    A pair's sketch has three parts of 2^m cells, at least twice as many each as both versions have keys.  It
    is kept as a table of its cells that hold anything: keys of ``a`` add to their cells and keys of ``b``
    subtract, so shared keys cancel in the aggregate.  A pass looks at one part, where a key has one cell
    only: keys of pure cells are counted and leave their other two cells.  diff is null where cells remain.
    Each step is a grouped sum within the bucket's partition, without a shuffle.
    """
    size = F.size("a") + F.size("b")
    m = F.ceil(F.log2(F.greatest(F.lit(16), size * 2).cast("double"))).cast("long")
    signed = F.concat(
        F.transform("a", lambda k: F.struct(k.alias("k"), F.lit(1).alias("n"))),
        F.transform("b", lambda k: F.struct(k.alias("k"), F.lit(-1).alias("n"))),
        F.array(F.struct(F.lit(None).cast("long").alias("k"), F.lit(0).alias("n"))),  # so that each pair has a row
    )
    none = F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(0).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
    # a cell's number holds m, the part, and the place in the part
    place = lambda i, m, k="k": f"(({m}) << 48) | ({i}L << 46) | ((xxhash64(17L, {k}) >>> {20 * i}) & ((1L << cast({m} AS int)) - 1))"
    keys = pairs.select("bucket", "pid", m.alias("m"), F.explode(signed).alias("x")).select("bucket", "pid", "m", "x.k", "x.n")
    into = F.array(*[F.struct(F.expr(place(i, "m")).alias("cell"), "n", "k", _check(F.col("k")).alias("c")) for i in range(3)])
    cells = keys.select("bucket", "pid", F.explode(F.when(F.col("k").isNull(), F.array(none)).otherwise(into)).alias("x"))

    def merged(x: DataFrame) -> DataFrame:
        g = x.select("bucket", "pid", "x.*").groupBy("bucket", "pid", "cell").agg(
            F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c")
        )
        return g.where((F.col("cell") == -1) | (F.col("n") != 0) | (F.col("k") != 0))

    cells = merged(cells)
    one = F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
    for i in [p % 3 for p in range(passes)]:
        pure = (F.expr("(cell >> 46) & 3") == i) & (F.abs("n") == 1) & (_check(F.col("k")) == F.col("c"))
        leave = [F.struct(F.expr(place(j, "cell >> 48")).alias("cell"), (-F.col("n")).alias("n"), "k", "c") for j in range(3) if j != i]
        out = F.when(pure, F.array(*leave, one)).otherwise(F.array(F.struct("cell", "n", "k", "c")))
        cells = merged(cells.select("bucket", "pid", F.explode(out).alias("x")))
    found = cells.groupBy("bucket", "pid").agg(F.sum(F.when(F.col("cell") == -1, F.col("n"))).alias("d"), F.count_if(F.col("cell") >= 0).alias("left"))
    return found.select("bucket", "pid", F.when(F.col("left") == 0, F.coalesce("d", F.lit(0)).cast("int")).alias("diff"))


def fingerprint(keys: Column, width: int = 4) -> Column:
    """struct(keys, cells, text): a text's paragraph digests, their sketch, and that as a string."""
    made = F.transform(F.array(keys), lambda k: F.struct(k.alias("keys"), sketch(k, width, 1).alias("cells")))[0]
    return F.transform(
        F.array(made), lambda s: F.struct(s["keys"].alias("keys"), s["cells"].alias("cells"), as_text(s["cells"], F.size(s["keys"])).alias("text"))
    )[0]


def edited_text() -> Column:
    """text with its last floor(n/2) code points replaced by as many first ones of next_text."""
    half = F.floor(F.col("n_chars") / 2).cast("int")
    kept = F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int"))
    return F.concat(kept, F.substring(F.col("next_text"), F.lit(1), half))


def compare_with_edits(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next: a row a document.

    A document's edited text has its last floor(n/2) code points replaced by as many first ones of the next
    document (by descending doc_id, then text hash; after the last comes the first; a lone document is its own
    neighbour).  A fingerprint is the sketch of the text's paragraphs in 3 * ``width`` cells; likeness is shared
    over all distinct paragraphs, from the number of keys that subtracting and peeling two sketches recovers.
    Where these do not peel, larger sketches do (``peeled``), and where one of those fails, larger ones again
    in groups (``difference``).

    Null text is empty: no paragraphs, alike to any other text without.  Null ids come last.  Repeated rows
    are rows like others.  Empty table: no rows.  Only doc_id and text are read.
    """
    d = next_document(docs).withColumn("edited", edited_text()).withColumn("edited_keys", paragraphs(F.col("edited")))
    versions = F.array(
        F.struct(F.lit(0).alias("which"), F.col("edited_keys").alias("b")), F.struct(F.lit(1).alias("which"), F.col("next_keys").alias("b"))
    )
    pairs = d.select("bucket", "rid", F.col("keys").alias("a"), F.explode(versions).alias("v"))
    pairs = pairs.select("bucket", (F.col("rid") * 2 + F.col("v.which")).cast("long").alias("pid"), "a", "v.b")
    found = peeled(pairs).groupBy("bucket", F.expr("pid div 2").alias("rid")).agg(
        F.max(F.when(F.col("pid") % 2 == 0, F.col("diff"))).alias("diff_edited"),
        F.max(F.when(F.col("pid") % 2 == 1, F.col("diff"))).alias("diff_next"),
    )
    wide = d.select(
        "bucket",
        "rid",
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("keys"), width).alias("own"),
        fingerprint(F.col("edited_keys"), width).alias("edited"),
        "next_keys",
    ).alias("w")
    f = found.alias("f")
    on = (F.col("w.bucket") == F.col("f.bucket")) & (F.col("w.rid") == F.col("f.rid"))
    d = wide.join(f, on)

    def near(b: Column, cells: Column, larger: str) -> Column:
        a, sa = F.col("own.keys"), F.col("own.cells")
        first = peel(subtract(sa, cells), width, 1)
        return likeness(a, b, F.coalesce(first, F.col(larger), in_groups(a, b)))

    return d.select(
        "w.doc_id",
        "n_chars",
        "edited_sha256",
        F.col("own.text").alias("fingerprint"),
        F.col("edited.text").alias("edited_fingerprint"),
        near(F.col("edited.keys"), F.col("edited.cells"), "diff_edited").alias("near_edited"),
        near(F.col("next_keys"), sketch(F.col("next_keys"), width, 1), "diff_next").alias("near_next"),
    )
