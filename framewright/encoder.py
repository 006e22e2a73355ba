"""The programming interface: an encoder for DataFrames of frames, and one that is fed frame by frame."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame

from .functions.tables import PROFILES, RATES, Config
from .operators import kernel
from .operators.container import Movie, movie_bytes, write_movie
from .operators.encode import encode_frames
from .sources.frames import check_frames

PROFILE_NAMES = tuple(p[0] for p in PROFILES)
FOURCC = {p[1]: i for i, p in enumerate(PROFILES)}


def frame_rate(fps: float | None = None, num: int | None = None, den: int | None = None) -> tuple[int, int]:
    """A rate as a fraction: the one given, else that of ``fps``, else 30/1."""
    if num is not None and den is not None:
        return num, den
    if fps is None:
        return 30, 1
    for value, n, d in RATES:
        if abs(fps - value) < 0.01:
            return n, d
    if float(fps).is_integer():
        return int(fps), 1
    err, d = min((abs(fps - np.floor(fps * d + 0.5) / d), d) for d in range(1, 1002))
    return int(np.floor(fps * d + 0.5)), d


def config(width: int, height: int, profile: int | str = 3, fps: float | None = None, fps_num: int | None = None, fps_den: int | None = None, color_range: str = "limited") -> Config:
    """A checked configuration; the profile by its number, name or four-character code."""
    if isinstance(profile, str):
        names = {n.lower(): i for i, n in enumerate(PROFILE_NAMES)} | FOURCC
        if profile.lower() not in names:
            raise ValueError(f"no profile {profile!r}")
        profile = names[profile.lower()]
    num, den = frame_rate(fps, fps_num, fps_den)
    return Config(width, height, profile, num, den, color_range)


def rgba_size(c: Config) -> int:
    return c.frame_bytes


def yuv_size(c: Config) -> int:
    """Bytes of a frame's planes as 16-bit samples."""
    pixels = c.width * c.height
    return 2 * (4 * pixels if c.is_444 else pixels + 2 * ((c.width + 1) // 2) * c.height)


def split_planes(data: bytes, c: Config) -> list[np.ndarray]:
    """Planes of a converted frame: 16-bit little-endian samples, plane after plane."""
    if len(data) != yuv_size(c):
        raise ValueError(f"a converted frame of {c.width} x {c.height} has {yuv_size(c)} bytes, not {len(data)}")
    flat, at, out = np.frombuffer(data, "<u2").astype(np.int32), 0, []
    half = c.width if c.is_444 else (c.width + 1) // 2
    for width in (c.width, half, half, c.width)[: 4 if c.is_444 else 3]:
        out.append(flat[at : at + width * c.height].reshape(c.height, width))
        at += width * c.height
    return out


class FilmEncoder:
    """Encodes a DataFrame of frames (frame_idx, width, height, rgba), batch or streaming."""

    def __init__(self, c: Config):
        self.config = c

    def packets(self, frames: DataFrame) -> DataFrame:
        return encode_frames(check_frames(frames, self.config), self.config)

    def write(self, frames: DataFrame, path: str, created: int = 0) -> int:
        """Encodes to a movie file; the packets are written once, beside it, and read for the file."""
        parts = f"{path}.packets"
        self.packets(frames).write.mode("overwrite").parquet(parts)
        return write_movie(frames.sparkSession.read.parquet(parts), path, Movie(self.config, self.config.is_444, created))


class FrameEncoder:
    """Fed frame by frame: keeps packets, or hands each on as it is made and keeps sizes alone."""

    def __init__(self, c: Config, on_packet: Callable[[bytes], None] | None = None, created: int = 0):
        self.config, self.on_packet = c, on_packet
        self.movie = Movie(c, c.is_444, created)
        self.kept: list[bytes] = []
        self.sizes: list[int] = []
        self.ended = False

    @property
    def frame_count(self) -> int:
        return len(self.sizes)

    @property
    def duration(self) -> Fraction:
        """In seconds."""
        return Fraction(self.frame_count * self.config.fps_den, self.config.fps_num)

    def _take(self, packet: bytes) -> bytes:
        if self.ended:
            raise RuntimeError("no frames after the end")
        self.sizes.append(len(packet))
        if self.on_packet:
            self.on_packet(packet)
        else:
            self.kept.append(packet)
        return packet

    def add_rgba(self, rgba: bytes) -> bytes:
        return self._take(self.encode_rgba(rgba))

    def add_yuv(self, data: bytes) -> bytes:
        return self._take(self.encode_yuv(data))

    def encode_rgba(self, rgba: bytes) -> bytes:
        """A packet that is not recorded: for a container of one's own."""
        return kernel.encode(rgba, self.config)

    def encode_yuv(self, data: bytes) -> bytes:
        return kernel.Frame.of_planes(split_planes(data, self.config), self.config).packet()

    def headers(self) -> tuple[bytes, bytes]:
        """What stands before and after the packets."""
        self.ended = True
        return self.movie.header(sum(self.sizes)), self.movie.moov(self.sizes)

    def finish(self) -> bytes:
        """The whole movie, if the packets were kept."""
        if self.on_packet:
            raise RuntimeError("the packets were handed on: use headers()")
        self.ended = True
        return movie_bytes(self.kept, self.movie)
