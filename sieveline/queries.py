"""The library's own queries over the test tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import bits, theory
from .operators import blobs, codec, diff, filters, fpr, frames, images, verify, video
from .oracle_hash import hashes
from .sources import files, synthetic
from .plans.config import DENSITY_THRESHOLD, LEAST_DENSITY, FilterSpec

#: Filters of the membership queries.
M, K_STANDARD, K_RATIONAL = 12_000, 5, 4.3
SWEEP_K = [0.4, 1.0, 1.5, 2.5, 3.7, 5.0, 6.25]
SWEEP_M = [4_000, 8_000, 12_000, 16_000]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- inputs ------------------------------------------------------------------------------------------------


def event_streams(spark, sf_dir) -> DataFrame:
    """A bit stream an event type: position event_id, bit whether the event is of that type."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type")
    kinds = e.select(F.col("event_type").alias("stream_id")).distinct()
    return kinds.crossJoin(e).select("stream_id", F.col("event_id").alias("pos"), (F.col("event_type") == F.col("stream_id")).cast("tinyint").alias("bit"))


def event_density(spark, sf_dir) -> DataFrame:
    """The streams' densities from one grouped count of the events, without making a bit."""
    e = table(spark, sf_dir, "events")
    per = e.groupBy(F.col("event_type").alias("stream_id")).agg(F.count("*").alias("ones"))
    return per.crossJoin(e.agg(F.count("*").alias("n"))).select("stream_id", "n", "ones", (F.col("ones") / F.col("n")).alias("p"))


def coded_events(spark, sf_dir) -> codec.Coded:
    return codec.compress(event_streams(spark, sf_dir), plan_=codec.plan(event_density(spark, sf_dir)))


def members(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("item"))


def strangers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000).cast("string").alias("item"))


def embedding_frames(spark, sf_dir) -> DataFrame:
    """Embeddings as 8 x 8 frames of one video, ordered by vec_id."""
    v = F.transform("embedding", lambda x: F.floor((x.cast("double") + 1) * 127.5 + 0.5).cast("int"))
    return table(spark, sf_dir, "embeddings").select(
        F.lit("emb").alias("video_id"), F.col("vec_id").cast("int").alias("frame_idx"), F.lit(8).alias("height"), F.lit(8).alias("width"),
        F.lit(1).alias("channels"), v.alias("pixels"),
    )


def color_frames(spark, sf_dir) -> DataFrame:
    """Three embeddings a frame as its blue, green and red values."""
    f = embedding_frames(spark, sf_dir)
    part = lambda c: f.where(F.col("frame_idx") % 3 == c).select(F.expr("frame_idx div 3").cast("int").alias("frame_idx"), F.col("pixels").alias(f"p{c}"))
    three = part(0).join(part(1), "frame_idx").join(part(2), "frame_idx")
    zipped = F.flatten(F.transform(F.arrays_zip("p0", "p1", "p2"), lambda z: F.array(z["p0"], z["p1"], z["p2"])))
    return three.select(
        F.lit("emb").alias("video_id"), "frame_idx", F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit(3).alias("channels"), zipped.alias("pixels")
    )


def edited_frames(spark, sf_dir) -> DataFrame:
    """Frames with planted edits: in every fifth frame all values whose place is divisible by 7 grow by their place modulo 5."""
    f = embedding_frames(spark, sf_dir)
    edit = F.transform("pixels", lambda v, i: F.when(i % 7 == 0, v + i % 5).otherwise(v))
    return f.withColumn("pixels", F.when(F.col("frame_idx") % 5 == 0, edit).otherwise(F.col("pixels")))


def binary_frames(spark, sf_dir) -> DataFrame:
    f = color_frames(spark, sf_dir)
    return f.select("video_id", "frame_idx", "height", "width", "channels", F.lit(1).alias("itemsize"), images.to_binary(F.col("pixels")).alias("data"))


# --- filters -----------------------------------------------------------------------------------------------


def stream_density(spark, sf_dir):
    return event_density(spark, sf_dir).select("stream_id", "n", "ones", F.round("p", 9).alias("p"))


def optimal_params(spark, sf_dir):
    grid = spark.range(1, 400).select(F.concat(F.lit("grid"), F.col("id")).alias("stream_id"), F.lit(100_000).cast("long").alias("n"), (F.col("id") * 100).alias("ones"))
    d = event_density(spark, sf_dir).select("stream_id", "n", "ones").unionByName(grid)
    return codec.plan(d).select("stream_id", "n", "ones", F.round("k", 9).alias("k"), "l")


def filter_sizing(spark, sf_dir):
    g = spark.sql("SELECT n, p FROM VALUES (100), (1000), (10000), (100000) AS a(n) CROSS JOIN VALUES (0.1D), (0.01D), (0.001D) AS b(p)")
    g = g.withColumn("m", theory.optimal_size(F.col("n"), F.col("p")).cast("long"))
    return g.select(
        "n", "p", "m", theory.integer_hash_count(F.col("m"), F.col("n")).alias("k_integer"),
        F.round(theory.rational_hash_count(F.col("m"), F.col("n")), 9).alias("k_rational"),
    )


def _grid(spark):
    return spark.range(1, 101).select((F.col("id") / 10).alias("k"), F.lit(1000).alias("m"), F.lit(100).alias("n"))


def fpr_theory_standard(spark, sf_dir):
    return _grid(spark).select("k", F.round(theory.standard_rate(F.col("m"), F.col("n"), F.col("k")), 9).alias("rate"))


def fpr_theory_rational(spark, sf_dir):
    m, n, k = F.col("m"), F.col("n"), F.col("k")
    return _grid(spark).select(
        "k", F.round(theory.rational_rate(m, n, k), 9).alias("rate"), F.round(theory.rational_rate_simple(m, n, k), 9).alias("rate_simple"),
        F.round(theory.rational_rate_split(m, n, k), 9).alias("rate_split"),
    )


STANDARD, RATIONAL = FilterSpec("f", "standard", M, K_STANDARD), FilterSpec("f", "rational", M, K_RATIONAL)


def _bits(spark, sf_dir, spec):
    f = filters.params(spark, [spec])
    words = filters.build(members(spark, sf_dir).select(F.lit("f").alias("filter_id"), "item"), f, spec.kind, 1)
    return f, words


def std_filter_bits(spark, sf_dir):
    return filters.set_bits(_bits(spark, sf_dir, STANDARD)[1]).select("idx")


def rational_filter_bits(spark, sf_dir):
    return filters.set_bits(_bits(spark, sf_dir, RATIONAL)[1]).select("idx")


def _membership(spark, sf_dir, spec):
    f, words = _bits(spark, sf_dir, spec)
    items = members(spark, sf_dir).union(strangers(spark, sf_dir)).select(F.lit("f").alias("filter_id"), "item")
    return filters.probe(items, f, words, spec.kind, spec.m).select("item", "passes")


def std_membership(spark, sf_dir):
    return _membership(spark, sf_dir, STANDARD)


def rational_membership(spark, sf_dir):
    return _membership(spark, sf_dir, RATIONAL)


def no_false_negatives(spark, sf_dir):
    both = [(k, _bits(spark, sf_dir, s)) for k, s in (("standard", STANDARD), ("rational", RATIONAL))]
    out = None
    for kind, (f, words) in both:
        items = members(spark, sf_dir).select(F.lit("f").alias("filter_id"), "item")
        one = filters.probe(items, f, words, kind, M).agg(F.count_if(~F.col("passes")).alias("missed"), F.count("*").alias("tested"))
        one = one.select(F.lit(kind).alias("kind"), "missed", "tested")
        out = one if out is None else out.union(one)
    return out


def fpr_compare(spark, sf_dir):
    a = members(spark, sf_dir)
    r = fpr.measure(a, a.union(strangers(spark, sf_dir)), [FilterSpec("standard", "standard", M, K_STANDARD), FilterSpec("rational", "rational", M, K_RATIONAL)], spark)
    return r.select("filter_id", "bits_set", "false_positives", "tested", F.round("rate", 9).alias("rate"))


def fpr_sweep_k(spark, sf_dir):
    r = fpr.sweep_hashes(members(spark, sf_dir), strangers(spark, sf_dir), M, SWEEP_K, spark)
    return r.select("kind", "k", "bits_set", F.round("rate", 9).alias("rate"))


def fpr_sweep_m(spark, sf_dir):
    r = fpr.sweep_sizes(members(spark, sf_dir), strangers(spark, sf_dir), SWEEP_M, 1500, spark)
    return r.select("kind", "m", "bits_set", F.round("rate", 9).alias("rate"))


# --- codec -------------------------------------------------------------------------------------------------


def codec_compress_stats(spark, sf_dir):
    s = coded_events(spark, sf_dir).summary()
    return s.select("stream_id", "n", "ones", F.round("p", 9).alias("p"), F.round("k", 9).alias("k"), "l", "witness_len", F.round("ratio", 9).alias("ratio"))


def codec_witness(spark, sf_dir):
    return coded_events(spark, sf_dir).witness.select("stream_id", "rank", F.col("bit").cast("int").alias("bit"))


def codec_roundtrip(spark, sf_dir):
    return codec.decompress(coded_events(spark, sf_dir)).select("stream_id", "pos", F.col("bit").cast("int").alias("bit"))


def text_density(spark, sf_dir):
    d = bits.binary_density(table(spark, sf_dir, "documents"), "doc_id", bits.text_bytes(F.col("text")))
    return d.select(F.col("stream_id").cast("long").alias("doc_id"), "n", "ones")


def text_roundtrip(spark, sf_dir):
    """Texts that are worth coding go through the codec; the others keep their bytes."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("data", bits.text_bytes(F.col("text")))
    n, ones = F.octet_length("data") * 8, bits.count_ones(F.col("data"))
    worth = F.coalesce((n > 0) & (ones / n > LEAST_DENSITY) & (ones / n < DENSITY_THRESHOLD), F.lit(False))
    docs = docs.withColumn("worth", worth)
    few = docs.where("worth").select("doc_id", "data").persist()  # about one text in a hundred; read by every step of the codec
    coded = codec.compress(bits.binary_to_bits(few, "doc_id", F.col("data")), plan_=codec.plan(bits.binary_density(few, "doc_id", F.col("data"))))
    back = bits.bits_to_binary(codec.decompress(coded)).select(F.col("stream_id").cast("long").alias("doc_id"), bits.binary_to_text(F.col("data")).alias("text"))
    return docs.where("not worth").select("doc_id", bits.binary_to_text(F.col("data")).alias("text")).unionByName(back)


def _image_bits(spark, sf_dir, threshold=140):
    px = images.exploded(embedding_frames(spark, sf_dir))
    return bits.binarize_image(px.select(F.col("frame_idx").alias("id"), F.lit(8).alias("width"), "y", "x", "c", "v"), threshold)


def image_binarize(spark, sf_dir):
    return _image_bits(spark, sf_dir).select(F.col("stream_id").cast("long").alias("vec_id"), "pos", F.col("bit").cast("int").alias("bit"))


def image_roundtrip(spark, sf_dir):
    """All images as one stream of their pixels, coded and restored; restored values are 0 or 255."""
    b = _image_bits(spark, sf_dir).select(F.lit("images").alias("stream_id"), (F.col("stream_id").cast("long") * 64 + F.col("pos")).alias("pos"), "bit")
    out = codec.decompress(codec.compress(b))
    return out.select(F.expr("pos div 64").alias("vec_id"), (F.col("pos") % 64).alias("pos"), (F.col("bit").cast("int") * 255).alias("v"))


def blob_sizes(spark, sf_dir):
    return frames.stream_blobs(coded_events(spark, sf_dir)).select("stream_id", "size")


# --- frames ------------------------------------------------------------------------------------------------


def frame_sample(spark, sf_dir):
    return images.sample(embedding_frames(spark, sf_dir), 30.0, 12.0).select("frame_idx")


def frame_limit(spark, sf_dir):
    return images.sample(embedding_frames(spark, sf_dir), 30.0, 12.0, 20).select("frame_idx")


def _diffs(spark, sf_dir, threshold=30.0):
    return diff.differences(embedding_frames(spark, sf_dir), threshold)


def frame_diff_mask(spark, sf_dir):
    d = _diffs(spark, sf_dir).select("frame_idx", F.posexplode("mask").alias("pos", "changed"))
    return d.select("frame_idx", "pos", F.col("changed").cast("int").alias("changed"))


def frame_changed_values(spark, sf_dir):
    return _diffs(spark, sf_dir).select("frame_idx", F.explode("changed").alias("x")).select("frame_idx", F.col("x.at").alias("pos"), F.col("x.v").alias("v"))


def frame_diff_density(spark, sf_dir):
    return _diffs(spark, sf_dir).select("frame_idx", F.round("density", 9).alias("density"))


def frame_apply_diff(spark, sf_dir):
    """Each frame's predecessor with the changed values put in."""
    base = embedding_frames(spark, sf_dir).withColumn("frame_idx", F.col("frame_idx") + 1)
    changes = _diffs(spark, sf_dir)
    out = diff.apply_difference(base.join(changes.select("video_id", "frame_idx"), ["video_id", "frame_idx"]), changes)
    return out.select("frame_idx", F.posexplode("pixels").alias("pos", "v"))


def frame_replay(spark, sf_dir):
    """All frames from the first one and lossless differences: a digest of each."""
    f = embedding_frames(spark, sf_dir)
    first = f.where(F.col("frame_idx") == 0)
    out = diff.replay(first, diff.differences(f, 0.0, any_channel=True))
    return out.groupBy("frame_idx").agg(F.sum(F.col("v") * (F.col("at") + 1)).cast("long").alias("digest"))


def frame_keyframes(spark, sf_dir):
    return images.keyframes(embedding_frames(spark, sf_dir), 12).select("frame_idx", "is_keyframe", "keyframe_idx")


def frame_resize(spark, sf_dir):
    half = frames.resize(embedding_frames(spark, sf_dir), 0.5)
    return half.select("frame_idx", "height", "width", F.posexplode("pixels").alias("pos", "v"))


def frame_planes(spark, sf_dir):
    """Sizes and sums of the planes that a frame is tagged with."""
    f = images.with_planes(images.convert(color_frames(spark, sf_dir), "bgr2yuv"))
    total = lambda c: F.aggregate(F.col(f"yuv.{c}.data"), F.lit(0), lambda n, v: n + v).alias(f"sum_{c}")
    return f.select("frame_idx", "yuv.format", F.col("yuv.u.h").alias("h"), F.col("yuv.v.w").alias("w"), total("y"), total("u"), total("v"))


def diff_records(spark, sf_dir):
    """Masks and changed values read back from difference records, a row a frame."""
    mask, values = blobs.read_diff_records(blobs.diff_records(_diffs(spark, sf_dir)))
    m = mask.groupBy("stream_id").agg(F.sum("bit").cast("long").alias("changed"), F.sum(F.col("bit") * (F.col("pos") + 1)).cast("long").alias("places"))
    v = values.groupBy("stream_id").agg(F.sum(F.col("v") * (F.col("rank") + 1)).cast("long").alias("weighted"))
    out = m.join(v, "stream_id", "left")
    return out.select(F.split("stream_id", "/")[1].cast("int").alias("frame_idx"), "changed", "places", F.coalesce("weighted", F.lit(0)).alias("weighted"))


def color_spaces(spark, sf_dir):
    return video.verify_color_spaces(color_frames(spark, sf_dir))


def fpr_improvement(spark, sf_dir):
    r = fpr_compare(spark, sf_dir).groupBy().pivot("filter_id", ["standard", "rational"]).agg(F.first("false_positives"))
    better = F.round(theory.improvement_percent(F.col("standard").cast("double"), F.col("rational").cast("double")), 6)
    return r.select("standard", "rational", better.alias("improvement_percent"))


def fpr_trials(spark, sf_dir):
    """Ten trials: strangers by the last digit of their key, against the theoretical rate."""
    f, words = _bits(spark, sf_dir, STANDARD)
    items = strangers(spark, sf_dir).select(F.lit("f").alias("filter_id"), "item")
    per = filters.probe(items, f, words, "standard", M, 1).groupBy(F.substring("item", -1, 1).alias("trial")).agg(F.avg(F.col("passes").cast("int")).alias("rate"))
    t = fpr.trials(per, 0.05)
    return t.select("trials", F.round("mean_rate", 9).alias("mean_rate"), F.round("relative_error_percent", 6).alias("relative_error_percent"))


def synthetic_square(spark, sf_dir):
    return synthetic.square_with_hole(spark).groupBy("y").agg(F.sum("v").cast("long").alias("bright"), F.count_if(F.col("v") > 0).alias("lit"))


def synthetic_shapes(spark, sf_dir):
    f = synthetic.shape_frames(spark)
    px = f.select("frame_idx", F.posexplode("pixels").alias("at", "v"))
    return px.groupBy("frame_idx", (F.col("at") % 3).alias("channel")).agg(F.sum("v").cast("long").alias("total"))


def synthetic_random(spark, sf_dir):
    """Counts of random words and bits that fit what was asked for."""
    w = synthetic.random_strings(spark, 2000)
    fit = w.agg(F.count("*").alias("n"), F.count_if(F.col("item").rlike("^[a-z]{10}$")).alias("fit"), F.countDistinct("item").alias("distinct")).select(F.lit("words").alias("kind"), "n", "fit", "distinct")
    out = fit
    for p in (0.1, 0.2, 0.3, 0.4):
        b = synthetic.bernoulli_bits(spark, 100_000, p, "s")
        near = F.when(F.abs(F.avg("bit") - p) < 0.01, F.count("*")).otherwise(0)
        out = out.union(b.agg(F.count("*").alias("n"), near.alias("fit"), F.countDistinct("bit").alias("distinct")).select(F.lit(f"bits {p}").alias("kind"), "n", "fit", "distinct"))
    return out


def adaptive_threshold(spark, sf_dir):
    n = diff.noise_level(embedding_frames(spark, sf_dir))
    return n.select("frame_idx", F.round("noise", 6).alias("noise"), F.round(diff.adaptive_threshold(F.col("noise"), 1.0, 3.0, 21.0), 6).alias("threshold"))


def gray_and_yuv(spark, sf_dir):
    f = color_frames(spark, sf_dir)
    yuv = images.convert(f, "bgr2yuv").select("frame_idx", F.col("pixels").alias("yuv"))
    g = images.gray(f).select("frame_idx", "gray")
    both = g.join(yuv, "frame_idx").select("frame_idx", F.posexplode("gray").alias("pos", "gray"), "yuv")
    at = lambda c: F.element_at("yuv", F.col("pos") * 3 + c + 1)
    return both.select("frame_idx", "pos", "gray", at(0).alias("luma"), at(1).alias("u"), at(2).alias("v"))


def verify_frames(spark, sf_dir):
    r = verify.report(embedding_frames(spark, sf_dir), edited_frames(spark, sf_dir))
    return r.select(
        "total_frames", "lossless", "exact_frame_matches", F.round("avg_difference", 9).alias("avg_difference"),
        F.round("mean_difference", 9).alias("mean_difference"), "max_difference", "max_diff_frame", F.size("diff_frames").alias("n_diff_frames"),
    )


def verify_examples(spark, sf_dir):
    r = verify.examples(embedding_frames(spark, sf_dir), edited_frames(spark, sf_dir), 3)
    return r.drop("video_id", "c")


def verify_bit_exact(spark, sf_dir):
    """Every tenth frame is missing, every tenth has another shape; digest: places, differences and values of the first three."""
    r = edited_frames(spark, sf_dir).where("frame_idx % 10 <> 3")
    other = F.col("frame_idx") % 10 == 4
    r = r.withColumn("height", F.when(other, 4).otherwise(F.col("height"))).withColumn("width", F.when(other, 16).otherwise(F.col("width")))
    x = verify.bit_exact(embedding_frames(spark, sf_dir), r, 3)
    one = lambda s, e: s + (e["y"] * 8 + e["x"] + 1) * e["difference"] + e["restored_value"]
    return x.select("frame_idx", "status", "differences_found", F.aggregate("examples", F.lit(0).cast("long"), one).alias("digest"))


def planes_to_bgr(spark, sf_dir):
    """Frames' values as luma, their first and last quarters as chroma of half the size; digest: values by place."""
    f = embedding_frames(spark, sf_dir)
    planes = f.select(
        "video_id", "frame_idx", "height", "width", F.lit("YUV420").alias("format"), images.to_binary(F.col("pixels")).alias("y"),
        images.to_binary(F.slice("pixels", 1, 16)).alias("u"), images.to_binary(F.slice("pixels", 49, 16)).alias("v"),
    )
    out = video.with_pixels(files.planes_to_bgr(planes))
    by_place = F.transform("pixels", lambda v, i: v * (i + 1))
    return out.select("frame_idx", "channels", F.aggregate(by_place, F.lit(0).cast("long"), lambda s, x: s + x).alias("digest"))


def verify_channels(spark, sf_dir):
    r = verify.channels(embedding_frames(spark, sf_dir), edited_frames(spark, sf_dir))
    return r.select("frame_idx", "channel", F.round("avg_diff", 9).alias("avg_diff"), "max_diff", "num_nonzero")


def zlib_roundtrip(spark, sf_dir):
    back = frames.decompress(frames.compress(binary_frames(spark, sf_dir), keyframe=True), keyframe=True)
    px = back.select("frame_idx", "channels", F.posexplode(images.from_binary(F.col("data"))).alias("pos", "v"))
    return px.select("frame_idx", "channels", "pos", "v")


def container_roundtrip(spark, sf_dir):
    boxed = frames.containers(frames.compress(binary_frames(spark, sf_dir)))
    back = frames.decompress(frames.from_containers(boxed))
    return back.select("frame_idx", "height", "width", "channels", F.sha2("data", 256).alias("sha256"))


def video_stats(spark, sf_dir):
    s = frames.statistics(frames.compress(binary_frames(spark, sf_dir)))
    return s.select("video_id", "frame_count", "original_size", "keyframes", "keyframe_ratio", "color_space")


def video_sizes(spark, sf_dir):
    """What the compressed frames take; depends on the zlib at hand."""
    s = frames.statistics(frames.compress(binary_frames(spark, sf_dir)))
    return s.select("video_id", "compressed_size", "compression_ratio", "space_savings")


NAMES = [
    stream_density, optimal_params, filter_sizing, fpr_theory_standard, fpr_theory_rational, std_filter_bits, rational_filter_bits,
    std_membership, rational_membership, no_false_negatives, fpr_compare, fpr_sweep_k, fpr_sweep_m, codec_compress_stats, codec_witness,
    codec_roundtrip, text_density, text_roundtrip, image_binarize, image_roundtrip, blob_sizes, frame_sample, frame_limit, frame_diff_mask,
    frame_changed_values, frame_diff_density, frame_apply_diff, adaptive_threshold, gray_and_yuv, verify_frames, verify_examples,
    verify_channels, verify_bit_exact, planes_to_bgr, zlib_roundtrip, container_roundtrip, video_stats, video_sizes, frame_replay, frame_keyframes, frame_resize, frame_planes,
    diff_records, color_spaces, fpr_improvement, fpr_trials, synthetic_square, synthetic_shapes, synthetic_random,
]


def queries():
    return {f.__name__: f for f in NAMES}


# --- SQL ---------------------------------------------------------------------------------------------------

LN2 = "0.6931471805599453"
ITEMS = "items AS (SELECT c_custkey::VARCHAR AS t FROM customer), others AS (SELECT (c_custkey + 1000000)::VARCHAR AS t FROM customer), every AS (FROM items UNION ALL FROM others)"


def _rate(k_expr: str) -> str:
    """CTEs rational filter parameters f(id, kind, m, k) -> idx(id, t, idx), set_(id, idx), pass(id, t)."""
    seeds = list(range(9))
    one = " ".join(f"WHEN {i} THEN s{i}" for i in range(9))
    return f"""{hashes('h', 'every', seeds)},
f AS ({k_expr}),
i AS (SELECT * FROM f, (SELECT unnest(generate_series(0, 8))::INT AS j)),
idx AS (
  SELECT id, t, (CASE WHEN kind = 'standard' THEN CASE j {one} END ELSE s0 + j::UHUGEINT * s1 END % m::UHUGEINT)::BIGINT AS idx
  FROM i, h
  WHERE CASE WHEN kind = 'standard' THEN j < floor(k)
        ELSE j < floor(k) OR (j = floor(k) AND (CASE ceil(k)::INT {one} END)::DOUBLE / 18446744073709551615::DOUBLE < k - floor(k)) END),
set_ AS (SELECT DISTINCT id, idx FROM idx JOIN (SELECT DISTINCT t FROM items) USING (t)),
bad AS (SELECT DISTINCT id, t FROM idx LEFT JOIN set_ s USING (id, idx) WHERE s.idx IS NULL)"""


def _one(kind: str) -> str:
    return f"WITH {ITEMS}, " + _rate(f"SELECT 'f' AS id, '{kind}' AS kind, {M} AS m, {K_STANDARD if kind == 'standard' else K_RATIONAL}::DOUBLE AS k")


def _many(rows: list[tuple]) -> str:
    values = ", ".join(f"('{i}', '{kind}', {m}, {k}::DOUBLE)" for i, kind, m, k in rows)
    return f"WITH {ITEMS}, " + _rate(f"SELECT * FROM (VALUES {values}) v(id, kind, m, k)")


MEASURED = """,
tests AS (SELECT t, t IN (SELECT t FROM items) AS member FROM {tests}),
r AS (
  SELECT f.id, any_value(f.kind) AS kind, count(*) FILTER (WHERE b.t IS NULL AND NOT member) AS false_positives, count(*) AS tested
  FROM f CROSS JOIN tests LEFT JOIN bad b ON b.id = f.id AND b.t = tests.t GROUP BY f.id),
n AS (SELECT f.id, count(s.idx) AS bits_set FROM f LEFT JOIN set_ s USING (id) GROUP BY f.id)
"""

EVENTS = f"""
d AS (SELECT event_type AS stream_id, (SELECT count(*) FROM events) AS n, count(*) AS ones FROM events GROUP BY 1),
q AS (SELECT *, ones / n AS p FROM d),
pk AS (SELECT *, log2((1 - p) * ({LN2} * {LN2}) / p) AS k0 FROM q WHERE p > {LEAST_DENSITY} AND p < {DENSITY_THRESHOLD}),
f AS (SELECT *, greatest(0.1, k0) AS k, greatest(1, floor(p * n * k0 * (1 / {LN2})))::BIGINT AS l FROM pk WHERE k0 > 0),
src AS (SELECT event_id::VARCHAR AS t FROM events),
{hashes('h', 'src', [0, 1, 999])},
idx AS (
  SELECT stream_id, event_id AS pos, (event_type = stream_id)::INT AS bit, ((s0 + j::UHUGEINT * s1) % l::UHUGEINT)::BIGINT AS idx
  FROM f, events e, h, (SELECT unnest(generate_series(0, 12)) AS j)
  WHERE h.t = e.event_id::VARCHAR AND (j < floor(k) OR (j = floor(k) AND s2::DOUBLE / 18446744073709551615::DOUBLE < k - floor(k)))),
set_ AS (SELECT DISTINCT stream_id, idx FROM idx WHERE bit = 1),
bad AS (SELECT DISTINCT stream_id, pos FROM idx LEFT JOIN set_ s USING (stream_id, idx) WHERE s.idx IS NULL),
w AS (
  SELECT f.stream_id, event_id AS pos, (event_type = f.stream_id)::INT AS bit
  FROM f CROSS JOIN events LEFT JOIN bad ON bad.stream_id = f.stream_id AND bad.pos = event_id WHERE bad.pos IS NULL),
c AS (SELECT stream_id, count(*) AS w FROM w GROUP BY 1)
"""
FRAMES = """
e AS (SELECT vec_id::INT AS frame_idx, embedding AS x FROM embeddings),
px AS (SELECT frame_idx, (i - 1)::INT AS pos, floor((x[i]::DOUBLE + 1) * 127.5 + 0.5)::INT AS v FROM e, (SELECT unnest(generate_series(1, 64)) AS i))
"""
DIFFS = f"""{FRAMES},
m AS (SELECT n.frame_idx, n.pos, n.v, (abs(n.v - p.v) > 30)::INT AS changed, p.v AS before FROM px n JOIN px p ON p.frame_idx = n.frame_idx - 1 AND p.pos = n.pos)
"""
EDITS = f"""{FRAMES},
ed AS (SELECT frame_idx, pos, v AS o, CASE WHEN frame_idx % 5 = 0 AND pos % 7 = 0 THEN v + pos % 5 ELSE v END AS r FROM px)
"""
COLOR = f"""{FRAMES},
bgr AS (
  SELECT (a.frame_idx // 3)::INT AS frame_idx, a.pos, a.v AS b, g.v AS g, r.v AS r
  FROM px a JOIN px g ON g.frame_idx = a.frame_idx + 1 AND g.pos = a.pos JOIN px r ON r.frame_idx = a.frame_idx + 2 AND r.pos = a.pos
  WHERE a.frame_idx % 3 = 0)
"""


def oracle_sql() -> dict[str, str]:
    grid = "(SELECT i / 10 AS k, 1000 AS m, 100 AS n FROM (SELECT unnest(generate_series(1, 100)) AS i))"
    params = f"""
p AS (SELECT *, ones / n AS p FROM d),
k AS (SELECT *, CASE WHEN p > {LEAST_DENSITY} AND p < {DENSITY_THRESHOLD} THEN log2((1 - p) * ({LN2} * {LN2}) / p) ELSE 0 END AS k0 FROM p)
SELECT stream_id, n, ones, CASE WHEN k0 > 0 THEN round(greatest(0.1, k0), 9) ELSE 0.0 END AS k,
       CASE WHEN k0 > 0 THEN greatest(1, floor(p * n * k0 * (1 / {LN2})))::BIGINT ELSE 0 END AS l FROM k"""
    ks = [(f"standard:{k}", "standard", M, round(k)) for k in SWEEP_K] + [(f"rational:{k}", "rational", M, k) for k in SWEEP_K]
    ms = [(f"standard:{m}", "standard", m, max(1, round(m / 1500 * 0.6931471805599453))) for m in SWEEP_M]
    ms += [(f"rational:{m}", "rational", m, max(0.1, m / 1500 * 0.6931471805599453)) for m in SWEEP_M]
    swept = "SELECT split_part(id, ':', 1) AS kind, split_part(id, ':', 2)::{t} AS {c}, bits_set, round(false_positives / tested, 9) AS rate FROM r JOIN n USING (id)"
    scale = "CAST(floor(({x} + 8192) / 16384.0) AS INT)"
    luma = scale.format(x="b * 1868 + g * 9617 + r * 4899")
    u = f"greatest(0, least(255, {scale.format(x='(b - luma) * 8061')} + 128))"
    v = f"greatest(0, least(255, {scale.format(x='(r - luma) * 14369')} + 128))"
    near = " UNION ALL ".join(
        f"SELECT frame_idx, pos, greatest(0, least(7, pos // 8 + {dy})) * 8 + greatest(0, least(7, pos % 8 + {dx})) AS at FROM px" for dy in range(-2, 3) for dx in range(-2, 3)
    )
    return {
        "stream_density": "SELECT event_type AS stream_id, (SELECT count(*) FROM events) AS n, count(*) AS ones, round(count(*) / (SELECT count(*) FROM events), 9) AS p FROM events GROUP BY 1",
        "optimal_params": f"""WITH d AS (
  SELECT event_type AS stream_id, (SELECT count(*) FROM events) AS n, count(*) AS ones FROM events GROUP BY 1
  UNION ALL SELECT 'grid' || i, 100000, i * 100 FROM (SELECT unnest(generate_series(1, 399)) AS i)), {params}""",
        "filter_sizing": f"""WITH g AS (SELECT n, p, ceil(-n * ln(p) / ({LN2} * {LN2}))::BIGINT AS m FROM (VALUES (100), (1000), (10000), (100000)) a(n), (VALUES (0.1::DOUBLE), (0.01::DOUBLE), (0.001::DOUBLE)) b(p))
SELECT n, p, m, greatest(1, round_even(m / n * {LN2}, 0)::INT) AS k_integer, round(greatest(0.1, m / n * {LN2}), 9) AS k_rational FROM g""",
        "fpr_theory_standard": f"SELECT k, round(pow(1 - exp(-k * n / m), k), 9) AS rate FROM {grid}",
        "fpr_theory_rational": f"""SELECT k, round(pow(f, floor(k)) * (1 - (1 - f) * (k - floor(k))), 9) AS rate, round(pow(f, k), 9) AS rate_simple,
  round(pow(1 - exp(-floor(k) * n / m), floor(k)) * pow(1 - exp(-n / m), k - floor(k)), 9) AS rate_split
FROM (SELECT *, 1 - exp(-k * n / m) AS f FROM {grid})""",
        "std_filter_bits": _one("standard") + " SELECT idx FROM set_",
        "rational_filter_bits": _one("rational") + " SELECT idx FROM set_",
        "std_membership": _one("standard") + " SELECT t AS item, t NOT IN (SELECT t FROM bad) AS passes FROM every",
        "rational_membership": _one("rational") + " SELECT t AS item, t NOT IN (SELECT t FROM bad) AS passes FROM every",
        "no_false_negatives": "SELECT kind, 0 AS missed, (SELECT count(*) FROM customer) AS tested FROM (VALUES ('standard'), ('rational')) v(kind)",
        "fpr_compare": _many([("standard", "standard", M, K_STANDARD), ("rational", "rational", M, K_RATIONAL)]) + MEASURED.format(tests="every")
        + "SELECT id AS filter_id, bits_set, false_positives, tested, round(false_positives / tested, 9) AS rate FROM r JOIN n USING (id)",
        "fpr_sweep_k": _many(ks) + MEASURED.format(tests="others") + swept.format(t="DOUBLE", c="k"),
        "fpr_sweep_m": _many(ms) + MEASURED.format(tests="others") + swept.format(t="BIGINT", c="m"),
        "codec_compress_stats": f"WITH {EVENTS} SELECT stream_id, n, ones, round(p, 9) AS p, round(k, 9) AS k, l, c.w AS witness_len, round((l + c.w) / n, 9) AS ratio FROM f JOIN c USING (stream_id)",
        "codec_witness": f"WITH {EVENTS} SELECT stream_id, row_number() OVER (PARTITION BY stream_id ORDER BY pos) - 1 AS rank, bit FROM w",
        "codec_roundtrip": "SELECT k.event_type AS stream_id, event_id AS pos, (e.event_type = k.event_type)::INT AS bit FROM (SELECT DISTINCT event_type FROM events) k, events e",
        "text_density": "SELECT doc_id, octet_length(encode(text)) * 8 AS n, bit_count(CAST(encode(text) AS BIT)) AS ones FROM documents",
        "text_roundtrip": "SELECT doc_id, text FROM documents",
        "image_binarize": f"WITH {FRAMES} SELECT frame_idx::BIGINT AS vec_id, pos::BIGINT AS pos, (v > 140)::INT AS bit FROM px",
        "image_roundtrip": f"WITH {FRAMES} SELECT frame_idx::BIGINT AS vec_id, pos::BIGINT AS pos, (v > 140)::INT * 255 AS v FROM px",
        "blob_sizes": f"WITH {EVENTS} SELECT stream_id, (25 + ceil(l / 8) + ceil(c.w / 8))::BIGINT AS size FROM f JOIN c USING (stream_id)",
        "frame_sample": "SELECT vec_id::INT AS frame_idx FROM embeddings WHERE vec_id % 2 = 0",
        "frame_limit": "SELECT vec_id::INT AS frame_idx FROM embeddings WHERE vec_id % 2 = 0 ORDER BY vec_id LIMIT 20",
        "frame_diff_mask": f"WITH {DIFFS} SELECT frame_idx, pos, changed FROM m",
        "frame_changed_values": f"WITH {DIFFS} SELECT frame_idx, pos, v FROM m WHERE changed = 1",
        "frame_diff_density": f"WITH {DIFFS} SELECT frame_idx, round(sum(changed) / 64, 9) AS density FROM m GROUP BY 1",
        "frame_apply_diff": f"WITH {DIFFS} SELECT frame_idx, pos, CASE WHEN changed = 1 THEN v ELSE before END AS v FROM m",
        "adaptive_threshold": f"""WITH {FRAMES}, a AS ({near}), d AS (SELECT a.frame_idx, a.pos, median(px.v) AS med FROM a JOIN px ON px.frame_idx = a.frame_idx AND px.pos = a.at GROUP BY ALL),
s AS (SELECT frame_idx, stddev_pop(v - med) AS noise FROM px JOIN d USING (frame_idx, pos) GROUP BY 1)
SELECT frame_idx, round(noise, 6) AS noise, round(greatest(3.0, least(21.0, noise)), 6) AS threshold FROM s""",
        "gray_and_yuv": f"WITH {COLOR}, y AS (SELECT *, {luma} AS luma FROM bgr) SELECT frame_idx, pos, luma AS gray, luma, {u} AS u, {v} AS v FROM y",
        "verify_frames": f"""WITH {EDITS}, f AS (SELECT frame_idx, avg(abs(o - r)) AS d, max(abs(o - r)) AS m FROM ed GROUP BY 1)
SELECT count(*) AS total_frames, bool_and(m = 0) AS lossless, count(*) FILTER (WHERE m = 0) AS exact_frame_matches, round(max(d), 9) AS avg_difference,
  round(avg(d), 9) AS mean_difference, max(m) AS max_difference, (SELECT frame_idx FROM f ORDER BY d DESC, frame_idx LIMIT 1) AS max_diff_frame, count(*) FILTER (WHERE m > 0) AS n_diff_frames FROM f""",
        "verify_examples": f"""WITH {EDITS}, b AS (SELECT *, count(*) OVER (PARTITION BY frame_idx) AS differences_found, row_number() OVER (PARTITION BY frame_idx ORDER BY pos) AS rank FROM ed WHERE o <> r)
SELECT frame_idx, differences_found, rank::INT AS rank, (pos // 8)::INT AS y, (pos % 8)::INT AS x, o AS original_value, r AS restored_value, abs(o - r) AS difference FROM b WHERE rank <= 3""",
        "verify_channels": f"WITH {EDITS} SELECT frame_idx, 0 AS channel, round(avg(abs(o - r)), 9) AS avg_diff, max(abs(o - r)) AS max_diff, count(*) FILTER (WHERE o <> r) AS num_nonzero FROM ed GROUP BY 1",
        "verify_bit_exact": f"""WITH {EDITS}, b AS (SELECT *, o <> r AS bad, row_number() OVER (PARTITION BY frame_idx, o <> r ORDER BY pos) AS rank FROM ed),
g AS (SELECT frame_idx, count(*) FILTER (WHERE bad) AS n, coalesce(sum((pos + 1) * abs(o - r) + r) FILTER (WHERE bad AND rank <= 3), 0) AS digest, frame_idx % 10 IN (3, 4) AS apart FROM b GROUP BY 1)
SELECT frame_idx, CASE WHEN frame_idx % 10 = 3 THEN 'missing' WHEN frame_idx % 10 = 4 THEN 'shape' WHEN n > 0 THEN 'differs' ELSE 'equal' END AS status,
  CASE WHEN NOT apart THEN n END::INT AS differences_found, CASE WHEN NOT apart THEN digest END::BIGINT AS digest FROM g""",
        "planes_to_bgr": f"""WITH {FRAMES}, q AS (SELECT a.frame_idx, a.pos, a.v AS y, u.v - 128 AS u, w.v - 128 AS w FROM px a
  JOIN px u ON u.frame_idx = a.frame_idx AND u.pos = a.pos // 16 * 4 + a.pos % 8 // 2 JOIN px w ON w.frame_idx = a.frame_idx AND w.pos = 48 + a.pos // 16 * 4 + a.pos % 8 // 2),
c AS (SELECT frame_idx, pos, y + {scale.format(x=f"u * {images.B_FROM_U}")} AS b, y + {scale.format(x=f"u * ({images.G_FROM_U}) + w * ({images.G_FROM_V})")} AS g, y + {scale.format(x=f"w * {images.R_FROM_V}")} AS r FROM q)
SELECT frame_idx, 3::INT AS channels, sum(greatest(0, least(255, b)) * (3 * pos + 1) + greatest(0, least(255, g)) * (3 * pos + 2) + greatest(0, least(255, r)) * (3 * pos + 3))::BIGINT AS digest FROM c GROUP BY 1""",
        "zlib_roundtrip": f"WITH {COLOR} SELECT frame_idx, 3 AS channels, pos * 3 + c AS pos, CASE c WHEN 0 THEN b WHEN 1 THEN g ELSE r END AS v FROM bgr, (SELECT unnest([0, 1, 2])::INT AS c)",
        "container_roundtrip": f"""WITH {COLOR}, h AS (SELECT frame_idx, string_agg(printf('%02x%02x%02x', b, g, r), '' ORDER BY pos) AS hex FROM bgr GROUP BY 1)
SELECT frame_idx, 8 AS height, 8 AS width, 3 AS channels, sha256(unhex(hex)) AS sha256 FROM h""",
        "video_stats": f"WITH {COLOR} SELECT 'emb' AS video_id, count(DISTINCT frame_idx) AS frame_count, (count(*) * 3)::BIGINT AS original_size, count(DISTINCT frame_idx) AS keyframes, 1.0::DOUBLE AS keyframe_ratio, 'BGR' AS color_space FROM bgr",
        "frame_replay": f"WITH {FRAMES} SELECT frame_idx, sum(v * (pos + 1))::BIGINT AS digest FROM px GROUP BY 1",
        "frame_keyframes": "SELECT vec_id::INT AS frame_idx, vec_id % 12 = 0 AS is_keyframe, (vec_id - vec_id % 12)::INT AS keyframe_idx FROM embeddings",
        "frame_resize": f"WITH {FRAMES} SELECT frame_idx, 4 AS height, 4 AS width, ((pos // 16) * 4 + (pos % 8) // 2)::INT AS pos, round_even(sum(v) / 4.0, 0)::INT AS v FROM px GROUP BY ALL",
        "frame_planes": f"WITH {COLOR}, y AS (SELECT *, {luma} AS luma FROM bgr) SELECT frame_idx, 'YUV444' AS format, 8 AS h, 8 AS w, sum(luma)::INT AS sum_y, sum({u})::INT AS sum_u, sum({v})::INT AS sum_v FROM y GROUP BY 1",
        "diff_records": f"""WITH {DIFFS}, k AS (SELECT *, row_number() OVER (PARTITION BY frame_idx, changed ORDER BY pos) AS rank FROM m)
SELECT frame_idx, sum(changed)::BIGINT AS changed, sum(changed * (pos + 1))::BIGINT AS places, sum(changed * v * rank)::BIGINT AS weighted FROM k GROUP BY 1""",
        "color_spaces": "SELECT s AS color_space, true AS lossless, true AS all_lossless FROM (VALUES ('BGR'), ('RGB'), ('YUV')) v(s)",
        "fpr_improvement": _many([("standard", "standard", M, K_STANDARD), ("rational", "rational", M, K_RATIONAL)]) + MEASURED.format(tests="every")
        + ", o AS (SELECT max(false_positives) FILTER (WHERE id = 'standard') AS standard, max(false_positives) FILTER (WHERE id = 'rational') AS rational FROM r)"
        + " SELECT standard, rational, CASE WHEN standard > 0 THEN round((standard - rational) / standard * 100, 6) END AS improvement_percent FROM o",
        "fpr_trials": _one("standard") + ", t AS (SELECT right(t, 1) AS trial, avg((t NOT IN (SELECT t FROM bad))::INT) AS rate FROM others GROUP BY 1)"
        + " SELECT count(*) AS trials, round(avg(rate), 9) AS mean_rate, round(abs(avg(rate) - 0.05) / 0.05 * 100, 6) AS relative_error_percent FROM t",
        "synthetic_square": """WITH p AS (SELECT (i // 100)::INT AS y, i % 100 AS x FROM (SELECT unnest(generate_series(0, 9999)) AS i)),
v AS (SELECT y, (y BETWEEN 25 AND 74 AND x BETWEEN 25 AND 74 AND NOT (y BETWEEN 40 AND 59 AND x BETWEEN 40 AND 59))::INT AS lit FROM p)
SELECT y, sum(lit * 255)::BIGINT AS bright, sum(lit)::BIGINT AS lit FROM v GROUP BY 1""",
        "synthetic_shapes": """WITH p AS (SELECT f::INT AS frame_idx, i // 100 AS y, i % 100 AS x FROM (SELECT unnest(generate_series(0, 9999)) AS i), (SELECT unnest(generate_series(0, 4)) AS f)),
v AS (SELECT frame_idx, CASE WHEN y BETWEEN 20 AND 60 AND x BETWEEN 20 + 2 * frame_idx AND 50 + 2 * frame_idx THEN 255 ELSE 30 END AS a,
  CASE WHEN (y - 70) * (y - 70) + (x - 70) * (x - 70) <= 225 THEN 200 ELSE 30 END AS b, 30 + frame_idx AS c FROM p)
SELECT frame_idx, k::INT AS channel, sum(CASE k WHEN 0 THEN a WHEN 1 THEN b ELSE c END)::BIGINT AS total FROM v, (SELECT unnest([0, 1, 2]) AS k) GROUP BY ALL""",
        "synthetic_random": "SELECT * FROM (VALUES ('words', 2000::BIGINT, 2000::BIGINT, 2000::BIGINT), ('bits 0.1', 100000, 100000, 2), ('bits 0.2', 100000, 100000, 2), ('bits 0.3', 100000, 100000, 2), ('bits 0.4', 100000, 100000, 2)) v(kind, n, fit, \"distinct\")",
    }
