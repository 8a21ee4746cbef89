"""Parameters of filters and codecs."""

from __future__ import annotations

from dataclasses import dataclass

#: The two index seeds and the activation seed of codec filters, for bit streams and for frame masks.
CODEC_SEEDS = {"stream": (0, 1, 999), "frames": (0x12345678, 0x87654321, 999)}
#: Fixed value: streams at least this dense are stored as they are.
DENSITY_THRESHOLD = 0.32453
#: Fixed value: streams at most this dense are stored as they are.
LEAST_DENSITY = 0.0001
#: Fixed value: the fewest hash functions of a codec filter.
LEAST_HASHES = 0.1


@dataclass(frozen=True)
class FilterSpec:
    """One filter: ``kind`` standard or rational, ``m`` bits, ``k`` hash functions, seeds or null for the usual ones."""

    filter_id: str
    kind: str
    m: int
    k: float
    seeds: tuple[int, int, int] | None = None


@dataclass(frozen=True)
class VideoConfig:
    """Settings of the frame codec; ``raw`` passes all changes, of any channel, at threshold 0."""

    noise_tolerance: float = 10.0
    keyframe_interval: int = 30
    min_diff_threshold: float = 3.0
    max_diff_threshold: float = 30.0
    color_space: str = "BGR"
    direct_yuv: bool = False
    compression_level: int = 9
