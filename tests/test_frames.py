import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline.operators import diff, frames, images, verify
from sieveline.plans import layouts
from sieveline.sources import files, synthetic

RNG = np.random.default_rng(3)


def as_rows(arrays, video="v"):
    return [(video, i, a.shape[0], a.shape[1], a.shape[2], a.ravel().astype(int).tolist()) for i, a in enumerate(arrays)]


SCHEMA = "video_id string, frame_idx int, height int, width int, channels int, pixels array<int>"


def frames_of(spark, arrays, video="v"):
    return spark.createDataFrame(as_rows(arrays, video), SCHEMA)


@pytest.mark.parametrize("kind", [np.uint8, np.uint16, np.float32])
def test_frame_codec(spark, kind):
    arrays = [(RNG.random((5, 7, c)) * 200).astype(kind) for c in (1, 3)]
    rows = [("v", i, 5, 7, a.shape[2], a.itemsize, a.tobytes()) for i, a in enumerate(arrays)]
    df = spark.createDataFrame(rows, frames.FRAME)
    for keyframe in (False, True):
        back = frames.decompress(frames.compress(df, keyframe), keyframe).orderBy("frame_idx").collect()
        assert [(r.channels, bytes(r.data)) for r in back] == [(a.shape[2], a.tobytes()) for a in arrays]
    blobs = frames.compress(df)
    s = frames.statistics(blobs).first()
    size = sum(len(r.blob) for r in blobs.collect()) + 8 + 8
    assert (s.frame_count, s.compressed_size, s.original_size) == (2, size, sum(a.nbytes for a in arrays))
    box = frames.containers(blobs)
    assert bytes(box.first().container)[:8] == b"BFVC" + struct.pack("<I", 2)
    assert frames.from_containers(box).count() == 2


def test_planes_and_errors(spark):
    a = RNG.integers(0, 256, (4, 4, 3))
    df = images.with_planes(frames_of(spark, [a]))
    y = df.first().yuv
    assert y.format == "YUV444" and list(y.y.data) == a[:, :, 0].ravel().tolist() and list(y.v.data) == a[:, :, 2].ravel().tolist()
    assert images.with_planes(frames_of(spark, [a[:, :, :1]])).first().yuv is None
    planes = ("YUV444", [(4, 4, a[:, :, c].astype(np.uint8).tobytes()) for c in range(3)])
    got = layouts.unpack_frame(layouts.pack_frame(4, 4, 1, a.astype(np.uint8).tobytes(), planes))
    assert got["format"] == "YUV444" and got["planes"] == planes[1] and got["channels"] == 3
    with pytest.raises(ValueError):
        layouts.unpack_container(b"XXXX" + struct.pack("<I", 0))
    with pytest.raises(ValueError):
        layouts.unpack_container(layouts.pack_container([]))
    d = layouts.unpack_diff(layouts.pack_diff([1, 0, 1], [1], 0.1, 9, 1.5, bytes([7, 8]), 2))
    assert d["filter"].tolist() == [1, 0, 1] and d["values"].tolist() == [7, 8] and d["n"] == 9
    bad = spark.createDataFrame([("v", 0, b"\x02abc")], "video_id string, frame_idx int, blob binary")
    with pytest.raises(Exception, match="key frames"):
        frames.decompress(bad, keyframe=True).collect()


def test_colours(spark):
    a = RNG.integers(0, 256, (6, 5, 3))
    f = frames_of(spark, [a])
    assert images.convert(f, "bgr2rgb").first().pixels == a[:, :, ::-1].ravel().tolist()
    b, g, r = (a[:, :, i].astype(int) for i in range(3))
    y = (b * 1868 + g * 9617 + r * 4899 + 8192) >> 14
    assert images.gray(f).first().gray == y.ravel().tolist() == images.convert(f, "bgr2gray").first().pixels
    yuv = np.array(images.convert(f, "bgr2yuv").first().pixels).reshape(6, 5, 3)
    assert (yuv[:, :, 0] == y).all() and (yuv[:, :, 1] == np.clip((((b - y) * 8061 + 8192) >> 14) + 128, 0, 255)).all()
    back = np.array(images.convert(images.convert(frames_of(spark, [np.full((2, 2, 3), 90)]), "bgr2yuv"), "yuv2bgr").first().pixels)
    assert abs(back - 90).max() <= 1
    assert images.convert(frames_of(spark, [a[:, :, :1]]), "gray2bgr").first().pixels == np.repeat(a[:, :, :1], 3, axis=2).ravel().tolist()
    with pytest.raises(ValueError):
        images.convert(f, "bgr2cmyk")


def test_pixels_round_trip_and_sampling(spark):
    f = synthetic.shape_frames(spark, 7, 20)
    px = images.exploded(f)
    back = images.assembled(px, f.drop("pixels"))
    key = lambda df: sorted((r.frame_idx, r.pixels) for r in df.collect())
    assert key(back) == key(f)
    raw = f.select("frame_idx", images.from_binary(images.to_binary(F.col("pixels"))).alias("pixels"))
    assert key(raw) == key(f)
    kept = lambda *a: sorted(r.frame_idx for r in images.sample(f, *a).collect())
    assert kept(30.0, 15.0) == [0, 2, 4, 6] and kept(30.0, 15.0, 2) == [0, 2] and kept(10.0, 30.0) == list(range(7)) and kept(25.0, 10.0) == [0, 2, 4, 6]
    assert [r.keyframe_idx for r in images.keyframes(f, 3).orderBy("frame_idx").collect()] == [0, 0, 0, 3, 3, 3, 6]
    half = frames.resize(f, 0.5).first()
    assert (half.height, half.width, len(half.pixels)) == (10, 10, 300)
    assert frames.resize(f, 1.0).orderBy("frame_idx").first().pixels == f.orderBy("frame_idx").first().pixels


def test_differences_and_back(spark):
    arrays = [RNG.integers(0, 256, (4, 6, 3)) for _ in range(4)]
    f = frames_of(spark, arrays)
    d = {r.frame_idx: r for r in diff.differences(f, 20).collect()}
    gray = [((a * [1868, 9617, 4899]).sum(axis=2) + 8192) >> 14 for a in arrays]
    for i in (1, 2, 3):
        mask = abs(gray[i] - gray[i - 1]) > 20
        assert d[i].mask == mask.ravel().tolist() and d[i].density == mask.mean()
        assert [x.v for x in d[i].changed] == arrays[i][mask].ravel().tolist()
    lossless = diff.differences(f, 0, any_channel=True)
    base = frames_of(spark, arrays).withColumn("frame_idx", F.col("frame_idx") + 1).where("frame_idx < 4")
    again = {r.frame_idx: r.pixels for r in diff.apply_difference(base, lossless).collect()}
    assert again == {i: arrays[i].ravel().tolist() for i in (1, 2, 3)}
    out = {}
    for r in diff.replay(f.where("frame_idx = 0"), lossless).orderBy("frame_idx", "at").collect():
        out.setdefault(r.frame_idx, []).append(r.v)
    assert out == {i: a.ravel().tolist() for i, a in enumerate(arrays)}
    broken = lossless.withColumn("changed", F.slice("changed", 1, 1))
    assert {r.frame_idx: r.pixels for r in diff.apply_difference(base, broken).collect()} == {i: arrays[i - 1].ravel().tolist() for i in (1, 2, 3)}
    bits = diff.mask_bits(diff.differences(f, 20))
    assert bits.count() == 3 * 24


def test_noise_and_threshold(spark):
    a = RNG.integers(0, 256, (9, 8, 1))
    n = diff.noise_level(frames_of(spark, [a])).first().noise
    p = np.pad(a[:, :, 0], 2, mode="edge")
    med = np.array([[np.median(p[i : i + 5, j : j + 5]) for j in range(8)] for i in range(9)])
    assert n == pytest.approx((a[:, :, 0] - med).std())
    t = spark.createDataFrame([(0.1,), (1.0,), (9.0,)], "n double").select(diff.adaptive_threshold(F.col("n")).alias("t")).collect()
    assert [r.t for r in t] == [3.0, 10.0, 30.0]


def test_verification(spark):
    arrays = [RNG.integers(1, 250, (3, 4, 3)) for _ in range(3)]
    edited = [a.copy() for a in arrays]
    edited[1][2, 1, 0] += 5
    o, e = frames_of(spark, arrays), frames_of(spark, edited)
    r = verify.report(o, o).first()
    assert r.lossless and r.exact_frame_matches == 3 and r.max_difference == 0 and r.diff_frames == [] and r.max_diff_frame is None
    r = verify.report(o, e).first()
    assert not r.lossless and r.diff_frames == [1] and r.max_diff_frame == 1 and r.max_difference == 5
    assert r.avg_difference == pytest.approx(5 / 36) and r.mean_difference == pytest.approx(5 / 108)
    x = verify.examples(o, e).collect()
    assert [(v.frame_idx, v.y, v.x, v.c, v.difference) for v in x] == [(1, 2, 1, 0, 5)]
    c = {(v.frame_idx, v.channel): v.num_nonzero for v in verify.channels(o, e).collect()}
    assert c == {(i, k): int((i, k) == (1, 0)) for i in range(3) for k in range(3)}
    r = verify.report(o, e.where("frame_idx < 2")).first()
    assert not r.lossless and r.exact_frame_matches is None and r.max_difference is None
    far = edited[1].copy()
    far[0, 3, 2] += 1
    x = {v.frame_idx: v for v in verify.bit_exact(frames_of(spark, [*arrays, arrays[0]]), frames_of(spark, [arrays[0], far, arrays[2][:2]]), 1).collect()}
    assert [x[i].status for i in range(4)] == ["equal", "differs", "shape", "missing"] and x[0].examples == [] and x[2].examples is None
    (e1,) = x[1].examples
    assert x[1].differences_found == 2 and (e1.y, e1.x, e1.c, e1.difference) == (0, 3, 2, 1)
    assert [v.status for v in verify.bit_exact(o.limit(0), o).collect()] == ["extra"] * 3
    other = frames_of(spark, [a[:2] for a in arrays])
    assert verify.report(o, other).first().diff_frames == [0, 1, 2]
    s = spark.createDataFrame([("BGR", True), ("BGR", True), ("YUV", False)], "color_space string, lossless boolean")
    assert {(r.color_space, r.lossless, r.all_lossless) for r in verify.by_color_space(s).collect()} == {("BGR", True, False), ("YUV", False, False)}


def test_files(spark, tmp_path):
    files.register(spark)
    w, h, n = 6, 4, 5
    planes = [(RNG.bytes(w * h), RNG.bytes(w * h // 4), RNG.bytes(w * h // 4)) for _ in range(n)]
    (tmp_path / "a.y4m").write_bytes(f"YUV4MPEG2 W{w} H{h} F25:1 C420jpeg\n".encode() + b"".join(b"FRAME\n" + b"".join(p) for p in planes))
    got = spark.read.format("raw_video").option("frames_per_task", 2).load(str(tmp_path / "a.y4m")).orderBy("frame_idx").collect()
    assert [(bytes(r.y), bytes(r.u), bytes(r.v)) for r in got] == planes
    (tmp_path / "a.yuv").write_bytes(b"".join(b"".join(p) for p in planes))
    raw = spark.read.format("raw_video").options(width=w, height=h, format="YV12").load(str(tmp_path / "a.yuv")).orderBy("frame_idx").collect()
    assert [(bytes(r.y), bytes(r.v), bytes(r.u)) for r in raw] == planes
    df = spark.createDataFrame([("v", i, h, w, 1, 1, p[0]) for i, p in enumerate(planes)], frames.FRAME)
    frames.containers(frames.compress(df)).coalesce(1).write.format("frame_container").mode("append").save(str(tmp_path / "out"))
    back = frames.decompress(files.read_containers(spark, str(tmp_path / "out" / "*.bfvc"))).orderBy("frame_idx").collect()
    assert [bytes(r.data) for r in back] == [p[0] for p in planes]
    files.write_text(spark.createDataFrame([("é",)], "text string"), str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t")).first()[0] == "é"


def test_synthetic_rows_do_not_depend_on_partitions(spark):
    a = sorted(map(tuple, synthetic.random_strings(spark, 50).collect()))
    b = sorted(map(tuple, synthetic.random_strings(spark, 50).repartition(7).collect()))
    assert a == b and all(len(w) == 10 and w.islower() for _, w in a)
