"""Files of frames: containers, Y4M and raw YUV videos, images, coded blobs; read as rows, written as rows or files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ..operators.frames import from_containers

#: Bytes of the three planes for a frame of h x w, by chroma name, as divisors of height and width.
CHROMA = {"420": (2, 2), "422": (1, 2), "444": (1, 1)}
PLANES = "video_id string, frame_idx int, height int, width int, format string, y binary, u binary, v binary"


def read_containers(spark: SparkSession, path: str) -> DataFrame:
    """video_id (the file's path), frame_idx, blob of containers in ``path``; a path that is missing raises Spark's error."""
    return from_containers(spark.read.format("binaryFile").load(path).select(F.col("path").alias("video_id"), F.col("content").alias("container")))


def _file_system(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FileSink(DataSource):
    """Writes rows (a name, its bytes) as files ``path``/name + suffix.

    A path without a scheme is on each executor's own disk, so on a cluster it must be a folder that all share.
    """

    SUFFIX = ""

    def writer(self, schema, overwrite):
        return _FileWriter(self.options["path"], self.options.get("suffix", self.SUFFIX))


class ContainerSink(FileSink):
    """Rows (video_id, container) as video_id.bfvc: ``df.write.format("frame_container").save(path)``."""

    SUFFIX = ".bfvc"

    @classmethod
    def name(cls) -> str:
        return "frame_container"

    def schema(self) -> str:
        return "video_id string, container binary"


class BlobSink(FileSink):
    """Rows (stream_id, blob) as a file each, option suffix: ``df.write.format("coded_blob").save(path)``."""

    SUFFIX = ".blob"

    @classmethod
    def name(cls) -> str:
        return "coded_blob"

    def schema(self) -> str:
        return "stream_id string, blob binary"


class _FileWriter(DataSourceWriter):
    def __init__(self, path: str, suffix: str):
        self.path, self.suffix = path, suffix

    def write(self, iterator):
        system, base = _file_system(self.path)
        system.create_dir(base, recursive=True)
        for name, content in iterator:
            if not name or "/" in name or "\0" in name:
                raise ValueError(f"{name!r} cannot be a file's name")
            # a task that runs again writes the same file again, complete under its name only at the end
            with system.open_output_stream(f"{base}/.{name}.part") as f:
                f.write(bytes(content or b""))
            system.move(f"{base}/.{name}.part", f"{base}/{name}{self.suffix}")
        return WriterCommitMessage()


class _Range(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class RawVideo(DataSource):
    """Frames of one Y4M or headerless YUV file as planes: ``spark.read.format("raw_video").load(path)``.

    Options: width, height and format (I420, YV12, YUV422, YUV444) for headerless files; frames_per_task.  A task
    reads only its own range of frames, so a file of any length is spread over tasks.
    """

    @classmethod
    def name(cls) -> str:
        return "raw_video"

    def schema(self) -> str:
        return PLANES

    def reader(self, schema):
        return _RawReader(self.options)


class _RawReader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"]
        self.step = int(options.get("frames_per_task", 64))
        system, base = _file_system(self.path)
        self.total = system.get_file_info(base).size
        with system.open_input_file(base) as f:
            head = f.read(4096)
        if head.startswith(b"YUV4MPEG2"):
            line = head.split(b"\n", 1)[0]
            fields = {x[:1]: x[1:].decode() for x in line.split(b" ")[1:]}
            self.width, self.height = int(fields[b"W"]), int(fields[b"H"])
            self.chroma = next((c for c in CHROMA if fields.get(b"C", "420").startswith(c)), None)
            self.start, self.mark, self.swapped, self.format = len(line) + 1, len(b"FRAME\n"), False, f"YUV{self.chroma}"
        else:
            self.width, self.height = int(options["width"]), int(options["height"])
            self.format = options.get("format", "I420").upper()
            self.chroma = {"I420": "420", "YV12": "420", "YUV422": "422", "YUV444": "444"}.get(self.format)
            self.start, self.mark, self.swapped = 0, 0, self.format == "YV12"
        if self.chroma is None:
            raise ValueError("unknown chroma format")
        dy, dx = CHROMA[self.chroma]
        self.luma = self.width * self.height
        self.part = -(-self.width // dx) * -(-self.height // dy)
        self.size = self.mark + self.luma + 2 * self.part
        self.frames = (self.total - self.start) // self.size

    def partitions(self):
        return [_Range(i, min(i + self.step, self.frames)) for i in range(0, self.frames, self.step)] or [_Range(0, 0)]

    def read(self, partition) -> Iterator[tuple]:
        system, base = _file_system(self.path)
        with system.open_input_file(base) as f:
            for i in range(partition.first, partition.last):
                f.seek(self.start + i * self.size + self.mark)
                y, a, b = f.read(self.luma), f.read(self.part), f.read(self.part)
                u, v = (b, a) if self.swapped else (a, b)
                yield self.path, i, self.height, self.width, self.format, y, u, v


def register(spark: SparkSession) -> None:
    """Make the formats of this module known to a session."""
    spark.dataSource.register(ContainerSink)
    spark.dataSource.register(BlobSink)
    spark.dataSource.register(RawVideo)


def planes_to_bgr(planes: DataFrame) -> DataFrame:
    """Byte frames of three channels (blue, green, red) of rows (``PLANES``).

    Each chroma value stands for all pixels it covers; values are full range, converted as ``images.yuv_to_bgr`` does.
    """
    from ..operators import images as im
    from ..operators.frames import FRAME

    names = [c.split()[0] for c in FRAME.split(", ")]

    def scaled(x: np.ndarray) -> np.ndarray:
        return (x + im.HALF) >> 14

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                dy, dx = CHROMA[{"I420": "420", "YV12": "420"}.get(r.format, r.format.removeprefix("YUV"))]
                h, w = r.height, r.width
                y = np.frombuffer(r.y, np.uint8).reshape(h, w).astype(np.int32)
                u, v = (np.frombuffer(p, np.uint8).reshape(-(-h // dy), -(-w // dx)).repeat(dy, 0).repeat(dx, 1)[:h, :w].astype(np.int32) - 128 for p in (r.u, r.v))
                bgr = (y + scaled(u * im.B_FROM_U), y + scaled(u * im.G_FROM_U + v * im.G_FROM_V), y + scaled(v * im.R_FROM_V))
                data = np.stack(bgr, axis=2).clip(0, 255).astype(np.uint8).tobytes()
                out.append((r.video_id, r.frame_idx, h, w, 3, 1, data))
            yield pd.DataFrame(out, columns=names)

    return planes.mapInPandas(run, FRAME)


def frame_rate(path: str) -> float | None:
    """Frames a second as a Y4M file states them; None for other files and where it states none."""
    system, base = _file_system(path)
    with system.open_input_file(base) as f:
        head = f.read(4096)
    if not head.startswith(b"YUV4MPEG2"):
        return None
    rate = next((x[1:].decode() for x in head.split(b"\n", 1)[0].split(b" ")[1:] if x[:1] == b"F"), "0:0").split(":")
    return float(rate[0]) / float(rate[1]) if len(rate) == 2 and float(rate[0]) and float(rate[1]) else None


def write_images(df: DataFrame, path: str) -> None:
    """Rows (id, height, width, channels, data: bytes, blue, green, red where there are three) as PNG files ``path``/id.png."""

    def png(height: int, width: int, channels: int, data: bytes) -> bytes:
        a = np.frombuffer(data, np.uint8).reshape(height, width, channels)[:, :, ::-1]
        lines = np.concatenate([np.zeros((height, 1), np.uint8), a.reshape(height, -1)], axis=1)  # 0: no line filter
        kind = {1: 0, 3: 2}[channels]
        parts = [(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, kind, 0, 0, 0)), (b"IDAT", zlib.compress(lines.tobytes())), (b"IEND", b"")]
        return b"\x89PNG\r\n\x1a\n" + b"".join(struct.pack(">I", len(c)) + t + c + struct.pack(">I", zlib.crc32(t + c)) for t, c in parts)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            files = [png(r.height, r.width, r.channels, bytes(r.data)) for r in batch.itertuples(index=False)]
            yield pd.DataFrame({"stream_id": batch["id"], "blob": files})

    register(df.sparkSession)
    rows = df.select(F.col("id").cast("string").alias("id"), "height", "width", "channels", "data")
    rows.mapInPandas(run, "stream_id string, blob binary").write.format("coded_blob").option("suffix", ".png").mode("append").save(path)


def write_blobs(df: DataFrame, path: str) -> None:
    """Coded texts, images or masks (stream_id, blob) as files ``path``/stream_id.blob."""
    register(df.sparkSession)
    df.select(F.col("stream_id").cast("string").alias("stream_id"), "blob").write.format("coded_blob").mode("append").save(path)


def read_blobs(spark: SparkSession, path: str) -> DataFrame:
    """stream_id, blob, exact_k (null: files hold k in single precision) of the blobs in the folder ``path``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", "*.blob").load(path)
    name = F.regexp_extract("path", r"([^/]*)\.blob$", 1)
    return rows.select(name.alias("stream_id"), F.col("content").alias("blob"), F.lit(None).cast("double").alias("exact_k"))


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """id, height, width, channels, pixels of images that Spark's own reader knows (blue, green, red)."""
    i = F.col("image")
    from ..operators.images import from_binary

    rows = spark.read.format("image").load(path)
    return rows.select(
        i["origin"].alias("id"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), from_binary(i["data"]).alias("pixels")
    )


def write_text(df: DataFrame, path: str, column: str = "text") -> None:
    df.select(F.col(column).cast("string")).write.text(path)
