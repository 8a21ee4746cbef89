import numpy as np
import pytest
from pyspark.sql import functions as F

from sieveline import cli
from sieveline.operators import blobs, codec, diff, frames, images, video
from sieveline.plans.config import VideoConfig
from sieveline.sources import files, synthetic

RNG = np.random.default_rng(12)
TEXTS = ["", "plain", "@@@@  @@  @ @@@ " * 20, "é€𝄞 and more", "\x00" * 40 + "A" * 8, None]


def test_texts_through_blobs(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "id long, t string")
    packed = blobs.compress_texts(df, "id", "t").cache()
    back = {int(r.stream_id): r.text for r in blobs.decompress_texts(packed).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    lossy = blobs.decompress_texts(blobs.compress_texts(df, "id", "t", 8), 8)
    assert {r.text for r in lossy.collect()} >= {"plain", "??? and more"}


def test_images_through_blobs(spark):
    square = synthetic.square_with_hole(spark)
    back = blobs.decompress_images(blobs.compress_images(square, 100, 100))
    want = {r.y * 100 + r.x: r.v for r in square.collect()}
    assert {r.pos: r.v for r in back.collect()} == want


def test_difference_records(spark):
    a = [RNG.integers(0, 256, (20, 20, 1))]
    for _ in range(3):
        b = a[-1].copy()
        b[RNG.integers(0, 20, 40), RNG.integers(0, 20, 40)] = RNG.integers(0, 256, (40, 1))
        a.append(b)
    f = spark.createDataFrame([("v", i, 20, 20, 1, x.ravel().tolist()) for i, x in enumerate(a)], "video_id string, frame_idx int, height int, width int, channels int, pixels array<int>")
    d = diff.differences(f, 3).cache()
    records = blobs.diff_records(d).cache()
    masks, values = blobs.read_diff_records(records)
    bad = codec.mismatches(diff.mask_bits(d), masks)
    assert bad.count() == 3 and bad.agg(F.sum("mismatches")).first()[0] == 0
    got = {}
    for r in values.orderBy("stream_id", "rank").collect():
        got.setdefault(r.stream_id, []).append(r.v)
    assert got == {f"v/{r.frame_idx}": [x.v for x in r.changed] for r in d.collect()}
    assert all(r.ratio == 8 * len(r.blob) / (400 + 8 * len(got[r.stream_id])) for r in records.collect())


@pytest.mark.parametrize("yuv", [False, True])
def test_video(spark, tmp_path, yuv):
    f = synthetic.shape_frames(spark, 4, 16)
    raw = f.select("video_id", "frame_idx", "height", "width", "channels", F.lit(1).alias("itemsize"), images.to_binary(F.col("pixels")).alias("data")).cache()
    made, stats = video.compress_video(raw, str(tmp_path / "out"), VideoConfig(direct_yuv=yuv))
    assert stats.first().frame_count == 4
    back = video.decompress_video(spark, str(tmp_path / "out" / "*.bfvc")).withColumn("video_id", F.lit("shapes"))
    assert video.verify_lossless(raw, back).first().lossless
    assert back.where("yuv is not null").count() == (4 if yuv else 0)
    if yuv:
        r = back.orderBy("frame_idx").first()
        assert bytes(r.yuv.y.data) == bytes(r.data)[::3]
    assert video.verify_lossless(raw, video.decompress_video(spark, blobs=made)).first().lossless
    assert all(max(r.pixels) == 0 for r in video.diagnostics(raw, back).collect())
    with pytest.raises(ValueError):
        video.decompress_video(spark)


def test_colour_spaces(spark):
    got = video.verify_color_spaces(synthetic.shape_frames(spark, 2, 16)).collect()
    assert {r.color_space for r in got} == {"BGR", "RGB", "YUV"} and all(r.lossless and r.all_lossless for r in got)


def test_command_line(spark, tmp_path):
    (tmp_path / "a.y4m").write_bytes(b"YUV4MPEG2 W4 H2 F25:1 C444\n" + b"".join(b"FRAME\n" + RNG.bytes(24) for _ in range(3)))
    assert cli.main(["verify", str(tmp_path / "a.y4m")]) == 0
    assert cli.main(["compress", str(tmp_path / "a.y4m"), str(tmp_path / "out"), "--max-frames", "2"]) == 0
    assert cli.main(["decompress", str(tmp_path / "out"), str(tmp_path / "back")]) == 0
    assert spark.read.parquet(str(tmp_path / "back")).where("channels = 3").count() == 2
    assert cli.main(["decompress", str(tmp_path / "out"), str(tmp_path / "png"), "--images"]) == 0
    assert sorted(p.name for p in (tmp_path / "png").iterdir() if not p.name.startswith((".", "_"))) == ["a-00000000.png", "a-00000001.png"]
    assert cli.main(["synthetic", str(tmp_path / "made"), "--frames", "2", "--size", "80"]) == 0
    assert video.decompress_video(spark, str(tmp_path / "made")).count() == 2


@pytest.mark.parametrize(("chroma", "dy", "dx"), [("420jpeg", 2, 2), ("422", 1, 2), ("444", 1, 1)])
def test_colour_frames_of_files(spark, tmp_path, chroma, dy, dx):
    h, w, n = 5, 7, 6  # odd sizes: chroma covers part of the last pixels
    ph, pw = -(-h // dy), -(-w // dx)
    planes = [(RNG.integers(0, 256, (h, w)), *RNG.integers(0, 256, (2, ph, pw))) for _ in range(n)]
    raw = lambda p: b"".join(a.astype(np.uint8).tobytes() for a in p)
    path = str(tmp_path / "a.y4m")
    open(path, "wb").write(f"YUV4MPEG2 W{w} H{h} F30:1 C{chroma}\n".encode() + b"".join(b"FRAME\n" + raw(p) for p in planes))
    assert files.frame_rate(path) == 30.0

    def plain(i):
        out = []
        for y in range(h):
            for x in range(w):
                a, u, v = (int(planes[i][0][y, x]), int(planes[i][1][y // dy, x // dx]) - 128, int(planes[i][2][y // dy, x // dx]) - 128)
                bgr = (a + (u * 33292 + 8192 >> 14), a + (u * -6472 + v * -9519 + 8192 >> 14), a + (v * 18678 + 8192 >> 14))
                out += [min(255, max(0, c)) for c in bgr]
        return out

    got = {r.frame_idx: list(r.data) for r in video.read_video(spark, path).collect()}
    assert got == {i: plain(i) for i in range(n)}
    got = {r.frame_idx: list(r.data) for r in video.read_video(spark, path, max_frames=2, target_fps=15, color_space="RGB").collect()}
    assert got == {i: [c for at in range(0, 3 * h * w, 3) for c in plain(i)[at : at + 3][::-1]] for i in (0, 2)}
    small = video.read_video(spark, path, scale=0.5, color_space="GRAY").first()
    assert (small.height, small.width, small.channels, len(small.data)) == (2, 3, 1, 6)


def test_image_and_blob_files(spark, tmp_path):
    a = RNG.integers(0, 256, (3, 4, 3))
    g = RNG.integers(0, 256, (3, 4, 1))
    rows = [(n, 3, 4, x.shape[2], x.astype(np.uint8).tobytes()) for n, x in (("colour", a), ("gray", g))]
    files.write_images(spark.createDataFrame(rows, "id string, height int, width int, channels int, data binary"), str(tmp_path / "i"))
    got = {r.id.rsplit("/", 1)[1]: r for r in files.read_images(spark, str(tmp_path / "i" / "*.png")).collect()}
    assert got["colour.png"].pixels == a.ravel().tolist() and got["gray.png"].channels == 1 and got["gray.png"].pixels == g.ravel().tolist()
    made = blobs.compress_texts(spark.createDataFrame([("p 1%20+", "aaaa" * 30), ("2", "")], "id string, text string"), "id", "text")
    files.write_blobs(made, str(tmp_path / "b"))
    back = {r.stream_id: bytes(r.blob) for r in files.read_blobs(spark, str(tmp_path / "b")).collect()}
    assert back == {r.stream_id: bytes(r.blob) for r in made.collect()} and len(back) == 2
    with pytest.raises(Exception, match="cannot be a file's name"):
        files.write_blobs(spark.createDataFrame([("a/b", b"x")], "stream_id string, blob binary"), str(tmp_path / "b"))
