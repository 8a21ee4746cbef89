import random

import pytest
from pyspark.sql import functions as F

from sieveline.functions import bits as B
from sieveline.operators import codec
from sieveline.operators.frames import stream_blobs
from sieveline.plans import layouts
from sieveline.sources import synthetic


@pytest.mark.parametrize(
    "p, k, l", [(0.01, 5.5718, 8038), (0.05, 3.1904, 23013), (0.10, 2.1124, 30475), (0.20, 0.9425, 27193), (0.30, 0.1649, 7135), (0.32, 0.1, 1381)]
)
def test_optimal_params(p, k, l):  # noqa: E741
    got = codec.optimal_params(100_000, p)
    assert round(got[0], 4) == k and got[1] == l


@pytest.mark.parametrize("p", [0.0, 0.0001, 0.32453, 0.5, 1.0])
def test_streams_that_are_left_as_they_are(p):
    assert codec.optimal_params(1000, p) == (0.0, 0)


def streams(spark):
    random.seed(7)
    rows = []
    for name, n, ones in [
        ("zeros", 300, 0), ("full", 300, 300), ("one", 20_000, 1), ("rare", 20_000, 3), ("tenth", 2000, 200), ("fifth", 2000, 400), ("near", 2000, 640),
        ("edge", 2000, 649), ("over", 2000, 650), ("single", 1, 1),
    ]:
        on = set(random.sample(range(n), ones))
        rows += [(name, i, int(i in on)) for i in range(n)]
    return spark.createDataFrame(rows, "stream_id string, pos long, bit int").withColumn("bit", F.col("bit").cast("tinyint"))


@pytest.mark.parametrize("variant", ["stream", "frames"])
@pytest.mark.parametrize("block", [1 << 16, 128])
def test_round_trip(spark, monkeypatch, variant, block):
    monkeypatch.setattr(codec, "BLOCK", block)
    given = streams(spark).cache()
    coded = codec.compress(given, variant)
    s = {r.stream_id: r for r in coded.summary().collect()}
    for name in ("zeros", "full", "over", "one", "single"):
        assert s[name].l == 0 and s[name].ratio == 1.0 and s[name].witness_len == 0
    for name in ("rare", "tenth", "fifth", "near", "edge"):
        assert s[name].l > 0 and s[name].witness_len >= s[name].ones
        assert s[name].ratio == (s[name].l + s[name].witness_len) / s[name].n
    bad = {r.stream_id: r.mismatches for r in codec.mismatches(given, codec.decompress(coded)).collect()}
    assert bad == dict.fromkeys(s, 0)


def test_witness_is_ordered_bits_that_pass(spark):
    given = synthetic.bernoulli_bits(spark, 3000, 0.1, "b")
    coded = codec.compress(given)
    w = [r.bit for r in coded.witness.orderBy("rank").collect()]
    assert sum(w) == given.agg(F.sum("bit")).first()[0]
    assert [r.rank for r in coded.witness.orderBy("rank").collect()] == list(range(len(w)))


def test_blobs(spark):
    coded = codec.compress(streams(spark))
    lengths = coded.plan.select("stream_id", F.lit(5).alias("length"))
    s = {r.stream_id: r for r in coded.summary().collect()}
    for r in stream_blobs(coded, lengths, 8).collect():
        want = s[r.stream_id]
        l = want.l or want.n  # noqa: E741
        assert r.size == layouts.text_blob_size(l, want.witness_len) == len(r.blob)
        assert r.size == 25 + -(-l // 8) + -(-want.witness_len // 8)
        back = layouts.unpack_text(bytes(r.blob))
        assert back["length"] == 5 and back["depth"] == 8 and len(back["filter"]) == l and len(back["witness"]) == want.witness_len
    for r in stream_blobs(coded, shape=(10, 30)).collect():
        back = layouts.unpack_image(bytes(r.blob))
        assert back["shape"] == (10, 30)
        assert r.size == 21 + 8 + -(-len(back["filter"]) // 8) + -(-len(back["witness"]) // 8)


TEXTS = ["", "A", "plain text", "é€𝄞 mixed", "\x00\x01", None]


def test_text_bits(spark):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(TEXTS)], "id string, t string").withColumn("d", B.text_bytes(F.col("t")))
    d = {r.stream_id: r for r in B.binary_density(df, "id", F.col("d")).collect()}
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        if t is not None:
            assert d[str(i)].n == 8 * len(raw) and d[str(i)].ones == sum(bin(b).count("1") for b in raw)
    got = {}
    for r in B.binary_to_bits(df, "id", F.col("d")).collect():
        got.setdefault(r.stream_id, {})[r.pos] = r.bit
    assert [got["1"][i] for i in range(8)] == [0, 1, 0, 0, 0, 0, 0, 1]
    back = {r.stream_id: r.t for r in B.bits_to_binary(B.binary_to_bits(df, "id", F.col("d"))).select("stream_id", B.binary_to_text(F.col("data")).alias("t")).collect()}
    assert back == {str(i): t for i, t in enumerate(TEXTS) if t}


def test_ascii_depth(spark):
    df = spark.createDataFrame([("aé€𝄞z", bytes([65, 200, 66]))], "t string, b binary")
    r = df.select(B.text_bytes(F.col("t"), 8).alias("t"), B.binary_to_text(F.col("b"), 8).alias("b"), B.binary_to_text(F.col("b")).alias("u")).first()
    assert bytes(r.t) == b"a???z" and r.b == "A�B" and r.u == "A�B"


def test_square_has_the_stated_density(spark):
    b = B.binarize_image(synthetic.square_with_hole(spark))
    assert b.agg(F.avg("bit")).first()[0] == 0.21
