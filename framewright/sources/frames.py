"""Frames: synthetic ones in closed form, raw files, and the forms in which operators take them.

``pixels`` has a row per pixel (frame_idx, y, x, r, g, b, a) and is for fixtures and checks;
``frames`` has a row per frame (frame_idx, width, height, rgba) and is what scales.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import Config

FRAMES = "frame_idx long, width int, height int, rgba binary"
_LOW32 = 0xFFFFFFFF
# Fixed values of the test generator: the state's growth with each call, its start, and the noise's range.
STEP, SEED, SEED_STEP, SPREAD = 1831565813, 4660, 977, 40


def _mul32(a: Column, b: Column) -> Column:
    """The low 32 bits of a product, without overflow."""
    return (a.bitwiseAND(F.lit(65535)) * b + F.shiftleft((F.shiftright(a, 16) * b).bitwiseAND(F.lit(65535)), 16)).bitwiseAND(F.lit(_LOW32))


def noise(frame: Column, call: Column) -> Column:
    """0 to 39 from a counter: what the sequential generator gives at its call-th call for a frame."""
    t = (F.lit(SEED) + SEED_STEP * frame + call * STEP).bitwiseAND(F.lit(_LOW32))
    t = _mul32(t.bitwiseXOR(F.shiftright(t, 15)), t.bitwiseOR(F.lit(1)))
    t = (t + _mul32(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_LOW32)).bitwiseXOR(t)
    return F.shiftright(t.bitwiseXOR(F.shiftright(t, 14)) * SPREAD, 32)


def frame_ids(events: DataFrame) -> DataFrame:
    """(frame_idx): one frame per thousand events, dealt over tasks."""
    n = events.agg(F.call_function("div", F.count("*"), F.lit(1000)).alias("n"))
    return n.select(F.explode(F.when(F.col("n") > 0, F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).alias("frame_idx")).repartition("frame_idx")


def synthetic_pixels(ids: DataFrame, width: int, height: int) -> DataFrame:
    """Ramps with noise, in exact integers; alpha is a ramp."""
    f, x, y = F.col("frame_idx"), F.col("x"), F.col("y")
    grid = ids.select("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))).alias("y"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("x"))
    channel = lambda base, c: (base + noise(f, 3 * (y * width + x) + c + 1)).bitwiseAND(F.lit(255))
    return grid.select("frame_idx", "y", "x", channel(2 * x + 10 * f, 0).alias("r"), channel(3 * y + 5 * f, 1).alias("g"), channel(x + y + 7 * f, 2).alias("b"), (2 * x + y).bitwiseAND(F.lit(255)).alias("a"))


def alpha_pattern(ids: DataFrame, width: int, height: int) -> DataFrame:
    """One colour, with alpha 8, 128 and 255 by a pixel's number."""
    i = F.col("y") * width + F.col("x")
    grid = ids.select("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))).alias("y"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("x"))
    a = F.when(i % 4 == 0, 8).when(i % 3 == 0, 128).otherwise(255)
    return grid.select("frame_idx", "y", "x", *(F.lit(v).cast("long").alias(c) for c, v in (("r", 200), ("g", 100), ("b", 50))), a.cast("long").alias("a"))


def gradient(ids: DataFrame, width: int, height: int) -> DataFrame:
    """Linear ramps in single precision: red to the right, green down, blue to the left; opaque."""
    grid = ids.select("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(height - 1).cast("long"))).alias("y"))
    grid = grid.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(width - 1).cast("long"))).alias("x"))
    fx, fy = ((F.col(c) / n).cast("float") for c, n in (("x", width), ("y", height)))
    byte = lambda v: (v * F.lit(255).cast("float")).cast("long")
    one = F.lit(1).cast("float")
    return grid.select("frame_idx", "y", "x", byte(fx).alias("r"), byte(fy).alias("g"), byte(one - fx).alias("b"), F.lit(255).cast("long").alias("a"))


def synthetic_rgba(frame: int, width: int, height: int) -> bytes:
    """One frame of the same pixels, by numpy."""
    mask = np.uint64(_LOW32)
    n = np.arange(1, 3 * width * height + 1, dtype=np.uint64)
    t = (np.uint64(SEED + SEED_STEP * frame) + n * np.uint64(STEP)) & mask
    t = ((t ^ (t >> np.uint64(15))) * (t | np.uint64(1))) & mask
    t = ((t + (((t ^ (t >> np.uint64(7))) * (t | np.uint64(61))) & mask)) & mask) ^ t
    k = (((t ^ (t >> np.uint64(14))) * np.uint64(SPREAD)) >> np.uint64(32)).astype(np.int64).reshape(height, width, 3)
    y, x = np.mgrid[:height, :width]
    out = np.stack([2 * x + 10 * frame + k[..., 0], 3 * y + 5 * frame + k[..., 1], x + y + 7 * frame + k[..., 2], 2 * x + y], axis=-1)
    return (out & 255).astype(np.uint8).tobytes()


def synthetic_frames(ids: DataFrame, width: int, height: int) -> DataFrame:
    """A row per frame."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([width], pa.int32()), pa.array([height], pa.int32()), pa.array([synthetic_rgba(f, width, height)], pa.binary())], names=["frame_idx", "width", "height", "rgba"])

    return ids.mapInArrow(run, FRAMES)


def matte(x: Column, y: Column, frame: Column, width: int, height: int, fps: float) -> Column:
    """A smooth alpha of full range that drifts diagonally, half a period a second."""
    wave = F.sin(2 * math.pi * (x / width + y / height + frame / fps * 0.5))
    return F.floor(128 + 127 * wave).cast("long").bitwiseAND(F.lit(255))


def write_raw(frames: DataFrame, path: str) -> int:
    """Writes frames, in order, as one flat file through Hadoop's file system; a partition at a time."""
    spark = frames.sparkSession
    target, size = spark._jvm.org.apache.hadoop.fs.Path(path), 0
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for row in frames.orderBy("frame_idx").select("rgba").toLocalIterator():
            out.write(row["rgba"])
            size += len(row["rgba"])
    finally:
        out.close()
    return size


def raw_frames(spark: SparkSession, path: str, config: Config, limit: int | None = None) -> DataFrame:
    """Frames of flat files of fixed-size records, one file or many in the order of their paths.

    The files are read as records by Spark, so a file larger than memory is split over tasks;
    ``limit`` keeps the first frames, which is a filter on frame_idx. A file must be whole frames.
    """
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    total = fs.getContentSummary(hadoop).getLength()
    if total % config.frame_bytes:
        raise ValueError(f"{path} holds {total} bytes, which is no whole number of frames of {config.frame_bytes}")
    # records stay in the JVM: its reader splits the files and numbers the records, no Python runs over frames
    encoders = spark._jvm.org.apache.spark.sql.Encoders
    records = spark._jsc.binaryRecords(path, config.frame_bytes).zipWithIndex().rdd()
    pairs = DataFrame(spark._jsparkSession.createDataset(records, encoders.tuple(encoders.BINARY(), encoders.LONG())).toDF(), spark)
    out = pairs.select(F.col("_2").alias("frame_idx"), F.lit(config.width).alias("width"), F.lit(config.height).alias("height"), F.col("_1").alias("rgba"))
    return out if limit is None else out.where(F.col("frame_idx") < limit)


def png_bytes(pixels: np.ndarray) -> bytes:
    """A PNG file of (height, width, 4) bytes, without filters."""
    import struct
    import zlib

    height, width, _ = pixels.shape
    rows = np.concatenate([np.zeros((height, 1), np.uint8), pixels.reshape(height, -1)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows.tobytes(), 1)) + chunk(b"IEND", b"")


def write_png(frames: DataFrame, folder: str, pattern: str = "frame_%04d.png") -> None:
    """Writes frames as a folder of PNG files through Hadoop's file system, a partition at a time."""
    spark = frames.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    fs = hadoop.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    for row in frames.toLocalIterator():
        out = fs.create(hadoop.Path(f"{folder}/{pattern % row['frame_idx']}"), True)
        try:
            out.write(bytearray(png_bytes(np.frombuffer(row["rgba"], np.uint8).reshape(row["height"], row["width"], 4))))
        finally:
            out.close()


def frame_fault(config: Config) -> Column:
    """What is wrong with a frame's size or length; null for one that is as the configuration says."""
    size = f"{config.width} x {config.height}"
    other = (F.col("width") != config.width) | (F.col("height") != config.height) | F.col("width").isNull() | F.col("height").isNull()
    shown = F.concat_ws(" x ", F.coalesce(F.col("width").cast("string"), F.lit("none")), F.coalesce(F.col("height").cast("string"), F.lit("none")))
    length = F.coalesce(F.octet_length("rgba").cast("string"), F.lit("none"))
    return F.when(other, F.concat(F.lit(f"a frame is {size}, not "), shown)).when(
        F.coalesce(F.octet_length("rgba"), F.lit(-1)) != config.frame_bytes, F.concat(F.lit(f"a frame of {size} has {config.frame_bytes} bytes, not "), length)
    )


def check_frames(frames: DataFrame, config: Config) -> DataFrame:
    """The frames as they are; one whose size or length isn't the configuration's fails the job."""
    fault = frame_fault(config)
    return frames.withColumn("rgba", F.when(fault.isNotNull(), F.raise_error(fault).cast("binary")).otherwise(F.col("rgba")))


def image_sequence(spark: SparkSession, folder: str, suffix: str = ".png") -> DataFrame:
    """(frame_idx, name, path, content): a folder's images in the natural order of their numbers."""
    files = spark.read.format("binaryFile").load(folder).where(F.lower("path").endswith(suffix))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return number_names(files.select(name.alias("name"), "path", "content"))


def number_names(files: DataFrame, range_rows: int = 65_536) -> DataFrame:
    """Adds frame_idx, the place in the order of the last number in ``name``, then of the name.

    Names are numbered within ranges of numbers (those without a number, within their first two
    characters), and ranges by their counts: no task sees more than a range of names and a row per
    range. Contents are joined on again.
    """
    from pyspark.sql import Window

    digits = F.regexp_extract("name", r"(\d+)\D*$", 1)
    number = F.when(digits == "", None).otherwise(digits).cast("decimal(38,0)")
    names = files.select("name").distinct().withColumn("number", number)
    part = F.struct(F.floor(F.col("number") / range_rows).alias("range"), F.when(F.col("number").isNull(), F.substring("name", 1, 2)).otherwise("").alias("start"))
    names = names.withColumn("part", part)
    order = Window.orderBy(F.col("part.range").asc_nulls_first(), "part.start").rowsBetween(Window.unboundedPreceding, -1)
    first = names.groupBy("part").agg(F.count("*").alias("n")).select(F.col("part").alias("own"), F.coalesce(F.sum("n").over(order), F.lit(0)).alias("first"))
    within = names.withColumn("k", F.row_number().over(Window.partitionBy("part").orderBy("number", "name")) - 1)
    places = within.join(first, F.col("part").eqNullSafe(F.col("own"))).select("name", (F.col("first") + F.col("k")).cast("long").alias("frame_idx"))
    return files.join(places, "name")


def decode_png(files: DataFrame, config: Config) -> DataFrame:
    """Frames from PNG contents, four channels of 8 bits each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for f, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pixels = png_pixels(data)
                if pixels.shape[:2] != (config.height, config.width):
                    raise ValueError(f"frame {f} is {pixels.shape[1]} x {pixels.shape[0]}, not {config.width} x {config.height}")
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([config.width], pa.int32()), pa.array([config.height], pa.int32()), pa.array([pixels.tobytes()], pa.binary())], names=["frame_idx", "width", "height", "rgba"])

    return files.select("frame_idx", "content").mapInArrow(run, FRAMES)


# Fixed values of the PNG format: first column and row, and steps, of the seven passes of an interlaced image.
PNG_PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def png_lines(data: np.ndarray, height: int, size: int, step: int) -> np.ndarray:
    """(height, size) bytes from as many filtered lines; ``step`` is the bytes from a pixel to the next."""
    out = np.zeros((height, size), np.uint8)
    above = np.zeros(size, np.int64)
    for y, row in enumerate(data.reshape(height, 1 + size)):
        line = row[1:].astype(np.int64)
        if row[0] == 1:
            for k in range(step):
                line[k::step] = np.cumsum(line[k::step])
        elif row[0] == 2:
            line = line + above
        elif row[0] in (3, 4):
            left = corner = np.zeros(step, np.int64)
            for x in range(0, size, step):
                up = above[x : x + step]
                if row[0] == 3:
                    guess = (left + up) // 2
                else:
                    p = left + up - corner
                    a, b, c = abs(p - left), abs(p - up), abs(p - corner)
                    guess = np.where((a <= b) & (a <= c), left, np.where(b <= c, up, corner))
                line[x : x + step] = left = (line[x : x + step] + guess) & 255
                corner = up
        above = line & 255
        out[y] = above
    return out


def png_samples(lines: np.ndarray, width: int, n: int, depth: int) -> np.ndarray:
    """(height, width, n) samples as they are stored, of 16 bits the upper 8."""
    if depth == 16:
        return lines.reshape(len(lines), width, n, 2)[..., 0]
    if depth < 8:
        bits = np.unpackbits(lines, axis=1)[:, : width * n * depth].reshape(len(lines), width, n, depth)
        return (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=3).astype(np.uint8)
    return lines.reshape(len(lines), width, n)


def png_pixels(data: bytes) -> np.ndarray:
    """(height, width, 4) of a PNG file's bytes: any depth, colour type and order of lines.

    Of 16 bits the upper 8 are kept, and decide which colour is the clear one.
    """
    import struct
    import zlib

    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("no PNG file")
    at, packed, palette, clear = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            width, height, depth, color, _, _, laced = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = body
        elif kind == b"IDAT":
            packed += body
        at += 12 + size
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[color]
    flat, at, px = np.frombuffer(zlib.decompress(packed), np.uint8), 0, np.zeros((height, width, n), np.uint8)
    for x, y, across, down in PNG_PASSES if laced else ((0, 0, 1, 1),):
        w, h = -(-(width - x) // across), -(-(height - y) // down)
        if w > 0 and h > 0:
            size = -(-w * n * depth // 8)
            lines = png_lines(flat[at : at + h * (1 + size)], h, size, max(1, n * depth // 8))
            px[y::down, x::across] = png_samples(lines, w, n, depth)
            at += h * (1 + size)
    full = np.full((height, width, 1), 255, np.uint8)
    if color == 3:
        alpha = np.full(256, 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = np.frombuffer(clear, np.uint8)
        return np.concatenate([palette[px[..., 0]], alpha[px]], axis=2)
    if clear is not None and color in (0, 2):  # one colour lets all through
        key = np.array(struct.unpack(f">{n}H", clear[: 2 * n])) >> (8 if depth == 16 else 0)
        full = np.where((px == key).all(axis=2, keepdims=True), 0, 255).astype(np.uint8)
    if depth < 8:
        px = px * np.uint8(255 // ((1 << depth) - 1))
    grey = np.repeat(px[..., :1], 3, axis=2) if n < 3 else px[..., :3]
    return np.concatenate([grey, px[..., -1:] if n in (2, 4) else full], axis=2)


def has_alpha(pixels: DataFrame) -> DataFrame:
    """(frame_idx, has_alpha): whether any pixel lets through."""
    return pixels.groupBy("frame_idx").agg(F.bool_or(F.col("a") < 255).alias("has_alpha"))
