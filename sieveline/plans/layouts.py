"""Binary layouts of coded texts, images, frames and frame differences: packing and unpacking of single values.

The layouts are fixed; their numbers stand in the order given.  k is stored in single precision there, so decode
from a blob only what the blob's own k was used for, or keep the plan's k beside it (``exact_k``).
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Struct formats of the headers, in order of their fields.
TEXT_HEADER = ">fIfIBII"  # p, n, k, characters, bit depth, filter bits, witness bits
IMAGE_HEADER = ">fIfB"  # p, n, k, dimensions; then a >I each, then >II filter and witness bits
DIFF_HEADER = "<fIfII"  # p, n, k, filter bits, witness bits; then <I-counted parts
FRAME_HEADER = "<III"  # height, width, bytes of a value
CONTAINER_MAGIC = b"BFVC"
#: Types of frame values by their size in bytes; any other size is read as the last.
VALUE_TYPES = {1: np.uint8, 2: np.uint16, 4: np.float32}


def _packed(bits) -> bytes:
    return np.packbits(np.asarray(bits, np.uint8)).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8))[:n]


def text_blob_size(l: int, w: int) -> int:  # noqa: E741
    return struct.calcsize(TEXT_HEADER) + -(-l // 8) - (-w // 8)


def image_blob_size(l: int, w: int, dims: int) -> int:  # noqa: E741
    return struct.calcsize(IMAGE_HEADER) + 4 * dims + 8 + -(-l // 8) - (-w // 8)


def pack_text(filter_bits, witness, p: float, n: int, k: float, length: int, depth: int) -> bytes:
    return struct.pack(TEXT_HEADER, p, n, k, length, depth, len(filter_bits), len(witness)) + _packed(filter_bits) + _packed(witness)


def unpack_text(blob: bytes) -> dict:
    p, n, k, length, depth, l, w = struct.unpack_from(TEXT_HEADER, blob)  # noqa: E741
    at = struct.calcsize(TEXT_HEADER)
    cut = at + -(-l // 8)
    return {"p": p, "n": n, "k": k, "length": length, "depth": depth, "filter": _unpacked(blob[at:cut], l), "witness": _unpacked(blob[cut:], w)}


def pack_image(filter_bits, witness, p: float, n: int, k: float, shape: tuple[int, ...]) -> bytes:
    head = struct.pack(IMAGE_HEADER, p, n, k, len(shape)) + struct.pack(f">{len(shape)}I", *shape)
    return head + struct.pack(">II", len(filter_bits), len(witness)) + _packed(filter_bits) + _packed(witness)


def unpack_image(blob: bytes) -> dict:
    p, n, k, dims = struct.unpack_from(IMAGE_HEADER, blob)
    at = struct.calcsize(IMAGE_HEADER)
    shape = struct.unpack_from(f">{dims}I", blob, at)
    l, w = struct.unpack_from(">II", blob, at + 4 * dims)  # noqa: E741
    at += 4 * dims + 8
    cut = at + -(-l // 8)
    return {"p": p, "n": n, "k": k, "shape": shape, "filter": _unpacked(blob[at:cut], l), "witness": _unpacked(blob[cut:], w)}


def pack_diff(filter_bits, witness, p: float, n: int, k: float, values: bytes, count: int) -> bytes:
    f, w, z = _packed(filter_bits), _packed(witness), zlib.compress(values, 9)
    head = struct.pack(DIFF_HEADER, p, n, k, len(filter_bits), len(witness))
    return head + struct.pack("<I", len(f)) + f + struct.pack("<I", len(w)) + w + struct.pack("<II", len(z), count) + z


def unpack_diff(blob: bytes) -> dict:
    p, n, k, l, w = struct.unpack_from(DIFF_HEADER, blob)  # noqa: E741
    at = struct.calcsize(DIFF_HEADER)
    parts = []
    for _ in range(2):
        (size,) = struct.unpack_from("<I", blob, at)
        parts.append(blob[at + 4 : at + 4 + size])
        at += 4 + size
    size, count = struct.unpack_from("<II", blob, at)
    values = np.frombuffer(zlib.decompress(blob[at + 8 : at + 8 + size]), np.uint8)
    return {"p": p, "n": n, "k": k, "filter": _unpacked(parts[0], l), "witness": _unpacked(parts[1], w), "values": values[:count]}


def pack_frame(height: int, width: int, itemsize: int, data: bytes, planes: tuple[str, list[tuple[int, int, bytes]]] | None = None, level: int = 9) -> bytes:
    """A frame: shape, compressed values, and whether a format name and three compressed planes follow."""
    z = zlib.compress(data, level)
    out = struct.pack(FRAME_HEADER, height, width, itemsize) + struct.pack("<I", len(z)) + z
    if planes is None:
        return out + struct.pack("<B", 0)
    name, parts = planes
    out += struct.pack("<BH", 1, len(name.encode())) + name.encode()
    for h, w, values in parts:
        z = zlib.compress(values, level)
        out += struct.pack("<I", len(z)) + z + struct.pack("<II", h, w)
    return out


def unpack_frame(blob: bytes) -> dict:
    """The number of channels follows from the number of values."""
    height, width, itemsize = struct.unpack_from(FRAME_HEADER, blob)
    (size,) = struct.unpack_from("<I", blob, 12)
    data = zlib.decompress(blob[16 : 16 + size])
    at = 16 + size
    kind = VALUE_TYPES.get(itemsize, np.float32)
    out = {"height": height, "width": width, "itemsize": itemsize, "data": data, "format": None, "planes": None}
    out["channels"] = max(1, len(data) // np.dtype(kind).itemsize // max(1, height * width))
    if blob[at]:
        (n,) = struct.unpack_from("<H", blob, at + 1)
        out["format"], at, out["planes"] = blob[at + 3 : at + 3 + n].decode(), at + 3 + n, []
        for _ in range(3):
            (size,) = struct.unpack_from("<I", blob, at)
            values = zlib.decompress(blob[at + 4 : at + 4 + size])
            out["planes"].append((*struct.unpack_from("<II", blob, at + 4 + size), values))
            at += 12 + size
    return out


def pack_container(frames: list[bytes]) -> bytes:
    return CONTAINER_MAGIC + struct.pack("<I", len(frames)) + b"".join(struct.pack("<I", len(f)) + f for f in frames)


def unpack_container(blob: bytes) -> list[bytes]:
    if blob[:4] != CONTAINER_MAGIC:
        raise ValueError("not a frame container: wrong magic bytes")
    (n,) = struct.unpack_from("<I", blob, 4)
    at, out = 8, []
    for _ in range(n):
        (size,) = struct.unpack_from("<I", blob, at)
        out.append(blob[at + 4 : at + 4 + size])
        at += 4 + size
    if not out:
        raise ValueError("the frame container is empty")
    return out
