"""Frames to packets, quantizer choice and movies: the operators that scale by frames."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import Config
from . import kernel

PACKETS = "frame_idx long, size long, data binary"


def _frames(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bytes]]:
    for batch in batches:
        for f, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            yield f, data.as_py()


def encode_frames(frames: DataFrame, config: Config) -> DataFrame:
    """(frame_idx, size, data): each frame's packet.

    Frames are independent, so they are encoded where they lie: no shuffle, one batch in memory at a
    time (64 MB by Spark's own setting, or one frame), and the same bytes for any partitioning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, rgba in _frames(batches):
            data = kernel.encode(rgba, config)
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["frame_idx", "size", "data"])

    return frames.select("frame_idx", "rgba").mapInArrow(run, PACKETS)


def encode_converted(frames: DataFrame, config: Config) -> DataFrame:
    """(frame_idx, size, data) from (frame_idx, planes): frames that are converted already, as 16-bit samples."""
    from ..encoder import split_planes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, planes in _frames(batches):
            data = kernel.Frame.of_planes(split_planes(planes, config), config).packet()
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["frame_idx", "size", "data"])

    return frames.select("frame_idx", "planes").mapInArrow(run, PACKETS)


def convert_frames(frames: DataFrame, config: Config) -> DataFrame:
    """(frame_idx, planes): the converted planes of each frame as 16-bit samples."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, rgba in _frames(batches):
            planes = kernel.to_planes(np.frombuffer(rgba, np.uint8).reshape(config.height, config.width, 4), config)
            yield pa.RecordBatch.from_arrays([pa.array([f], pa.int64()), pa.array([b"".join(p.astype("<u2").tobytes() for p in planes)], pa.binary())], names=["frame_idx", "planes"])

    return frames.select("frame_idx", "rgba").mapInArrow(run, "frame_idx long, planes binary")


def slice_quantizers(frames: DataFrame, config: Config) -> DataFrame:
    """(frame_idx, mb_row, slice, q, bits, error): what the search along each macroblock row chooses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, rgba in _frames(batches):
            frame = kernel.Frame(np.frombuffer(rgba, np.uint8).reshape(config.height, config.width, 4), config)
            q = frame.quantizers()
            bits, error = frame.cost(np.minimum(q, 128))
            row, s = np.divmod(np.arange(len(q)), config.slices_per_row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), f)), *map(pa.array, (row, s, q, bits, error))], names=["frame_idx", "mb_row", "slice", "q", "bits", "error"])

    return frames.select("frame_idx", "rgba").mapInArrow(run, "frame_idx long, mb_row long, slice long, q long, bits long, error long")


def frame_slices(frames: DataFrame, config: Config) -> DataFrame:
    """(frame_idx, mb_row, slice, q, size, data): the coded slices with their headers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for f, rgba in _frames(batches):
            frame = kernel.Frame(np.frombuffer(rgba, np.uint8).reshape(config.height, config.width, 4), config)
            q = frame.quantizers()
            data = frame.slices(q)
            row, s = np.divmod(np.arange(len(q)), config.slices_per_row)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(q), f)), pa.array(row), pa.array(s), pa.array(q), pa.array([len(d) for d in data], pa.int64()), pa.array(data, pa.binary())], names=["frame_idx", "mb_row", "slice", "q", "size", "data"])

    return frames.select("frame_idx", "rgba").mapInArrow(run, "frame_idx long, mb_row long, slice long, q long, size long, data binary")


def assemble_frames(slices: DataFrame, config: Config) -> DataFrame:
    """(frame_idx, size, data) from coded slices, in SQL expressions: picture header, slice table, frame header."""
    from ..functions.columns import big_endian

    by = slices.groupBy("frame_idx").agg(F.array_sort(F.collect_list(F.struct("mb_row", "slice", "size", F.hex("data").alias("hex")))).alias("s"))
    total = F.aggregate("s", F.lit(0).cast("long"), lambda t, x: t + x["size"]) + 8 + 2 * F.size("s")
    table = F.unhex(F.array_join(F.transform("s", lambda x: F.lpad(F.hex(x["size"]), 4, "0")), ""))
    body = F.unhex(F.array_join(F.transform("s", lambda x: x["hex"]), ""))
    picture = F.concat(F.unhex(F.lit("40")), big_endian(total, 4), big_endian(F.size("s"), 2), F.unhex(F.lit("30")), table, body)
    head = F.lit(bytearray(kernel.frame_header(config, 0)[4:]))
    return by.select("frame_idx", (total + 156).alias("size"), F.concat(big_endian(total + 156, 4), head, picture).alias("data"))
