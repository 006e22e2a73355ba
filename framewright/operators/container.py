"""The movie container: sample index as DataFrames, boxes as bytes, and the writer.

The index needs a running sum over all packets. It is made in two steps, sums of ranges of frames
and a running sum within each range, so no task sees more than one range and one row per range.
Creation time is a parameter: the same packets give the same file.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import EPOCH_1904, Config

RANGE = 65_536
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def sample_index(packets: DataFrame, range_rows: int = RANGE) -> DataFrame:
    """(frame_idx, size, offset): where each packet starts among all packets, in the order of frame_idx."""
    part = F.floor(F.col("frame_idx") / range_rows)
    rows = packets.select("frame_idx", F.col("size").cast("long").alias("size"), part.alias("part"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("part").agg(F.sum("size").alias("total")).select("part", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    within = Window.partitionBy("part").orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.withColumn("before", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return local.join(sums, "part").select("frame_idx", "size", (F.col("base") + F.col("before")).cast("long").alias("offset"))


def totals(packets: DataFrame, config: Config) -> DataFrame:
    """(samples, bytes, duration) of a movie."""
    return packets.agg(F.count("*").alias("samples"), F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"), (F.count("*") * config.fps_den).alias("duration"))


def reorder(packets: DataFrame) -> DataFrame:
    """Packets in the order of their frames, whatever order they came in."""
    return packets.orderBy("frame_idx")


def with_times(packets: DataFrame, times: DataFrame) -> DataFrame:
    """Each packet with its frame's (timestamp, duration)."""
    return packets.join(times, "frame_idx")


def mdat_header_size(total: int) -> int:
    return 16 if total + 8 > 0xFFFFFFFF else 8


def file_index(packets: DataFrame, config: Config, range_rows: int = RANGE) -> DataFrame:
    """(sample, size, file_offset, wide, sync, duration): the tables of the container, a row per sample."""
    index = sample_index(packets, range_rows)
    total = packets.agg(F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("total"))
    head = F.when(F.col("total") + 8 > 0xFFFFFFFF, 36).otherwise(28)
    place = Window.partitionBy("part").orderBy("frame_idx")
    numbered = index.withColumn("part", F.floor(F.col("frame_idx") / range_rows))
    counts = numbered.groupBy("part").agg(F.count("*").alias("n"))
    first = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first"))
    rows = numbered.withColumn("k", F.row_number().over(place)).join(first, "part").join(F.broadcast(total))
    return rows.select((F.col("first") + F.col("k")).cast("long").alias("sample"), "size", (F.col("offset") + head).cast("long").alias("file_offset"), (head + F.col("total") > 0xFFFFFFFF).alias("wide"), F.lit(True).alias("sync"), F.lit(config.fps_den).cast("long").alias("duration"))


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


@dataclass(frozen=True)
class Movie:
    """What the boxes say about a movie; ``created`` counts seconds since 1904."""

    config: Config
    has_alpha: bool = False
    created: int = 0
    primaries: int = 1
    transfer: int = 1
    matrix: int = 1

    def ftyp(self) -> bytes:
        return box(b"ftyp", b"qt  ", struct.pack(">I", 0x200), b"qt  ")

    def header(self, total: int) -> bytes:
        """The file's start, up to the first packet."""
        if mdat_header_size(total) == 16:
            return self.ftyp() + struct.pack(">I4sQ", 1, b"mdat", total + 16)
        return self.ftyp() + struct.pack(">I4s", total + 8, b"mdat")

    def mvhd(self, duration: int) -> bytes:
        return box(b"mvhd", struct.pack(">5I", 0, self.created, self.created, self.config.fps_num, duration & 0xFFFFFFFF), struct.pack(">IH10x", 0x10000, 0x100), _MATRIX, bytes(24), struct.pack(">I", 2))

    def tkhd(self, duration: int) -> bytes:
        size = struct.pack(">2I", self.config.width << 16, self.config.height << 16)
        return box(b"tkhd", struct.pack(">6I", 3, self.created, self.created, 1, 0, duration & 0xFFFFFFFF), bytes(16), _MATRIX, size)

    def mdhd(self, duration: int) -> bytes:
        return box(b"mdhd", struct.pack(">5I2H", 0, self.created, self.created, self.config.fps_num, duration & 0xFFFFFFFF, 0x55C4, 0))

    def hdlr(self) -> bytes:
        return box(b"hdlr", bytes(8), b"vide", bytes(12), b"\x0cVideoHandler")

    def vmhd(self) -> bytes:
        return box(b"vmhd", struct.pack(">I8x", 1))

    def dinf(self) -> bytes:
        return box(b"dinf", box(b"dref", struct.pack(">2I", 0, 1), box(b"url ", struct.pack(">I", 1))))

    def stsd(self) -> bytes:
        full = self.config.color_range == "full"
        # the name's length byte is 17 for either name, also for the one of 16 characters
        name = b"\x11" + (b"Apple ProRes 4444" if self.config.is_444 else b"Apple ProRes 422").ljust(31, b"\0")
        colr = box(b"colr", b"nclx" if full else b"nclc", struct.pack(">3H", self.primaries, self.transfer, self.matrix), b"\x80" if full else b"")
        entry = box(
            self.config.fourcc.encode(), bytes(6), struct.pack(">3H", 1, 0, 0), b"appl", struct.pack(">2I2H", 0, 512, self.config.width, self.config.height),
            struct.pack(">3IH", 0x480000, 0x480000, 0, 1), name, struct.pack(">2H", 32 if self.has_alpha else 24, 0xFFFF), box(b"fiel", b"\x01\x00"), colr,
        )
        return box(b"stsd", struct.pack(">2I", 0, 1), entry)

    def stbl(self, sizes: list[int]) -> bytes:
        n, total = len(sizes), sum(sizes)
        at, offsets = len(self.header(total)), []
        wide = at + total > 0xFFFFFFFF
        for size in sizes:
            offsets.append(at)
            at += size
        pairs = lambda *x: struct.pack(f">{len(x)}I", *x)
        return box(
            b"stbl", self.stsd(), box(b"stts", pairs(0, 1, n, self.config.fps_den)), box(b"stss", pairs(0, n, *range(1, n + 1))),
            box(b"stsc", pairs(0, 1, 1, 1, 1)), box(b"stsz", pairs(0, 0, n, *sizes)),
            box(b"co64" if wide else b"stco", pairs(0, n), struct.pack(f">{n}{'Q' if wide else 'I'}", *offsets)),
        )

    def moov(self, sizes: list[int]) -> bytes:
        """The file's end; needs the sizes of all packets, 4 bytes each."""
        if not sizes:
            raise ValueError("a movie needs a frame")
        duration = len(sizes) * self.config.fps_den
        media = box(b"mdia", self.mdhd(duration), self.hdlr(), box(b"minf", self.vmhd(), self.dinf(), self.stbl(sizes)))
        return box(b"moov", self.mvhd(duration), box(b"trak", self.tkhd(duration), media))

    def at(self, unix_seconds: int) -> Movie:
        return replace(self, created=(unix_seconds + EPOCH_1904) & 0xFFFFFFFF)


def movie_parts(packets: DataFrame, movie: Movie) -> DataFrame:
    """(place, data): what stands at which byte of the movie's file: its start, each packet, its end.

    Parts can be written by any task, as each has its place. The driver holds the sizes, 8 bytes a
    frame, for the tables at the end; packets stay where they are. They are read twice: give a
    written table, not a plan that encodes.
    """
    own = packets.select("frame_idx", F.col("size").cast("long").alias("size"), "data")
    sizes = [r["size"] for r in own.select("frame_idx", "size").orderBy("frame_idx").select("size").collect()]
    head = movie.header(sum(sizes))
    ends = own.sparkSession.createDataFrame([(0, bytearray(head)), (len(head) + sum(sizes), bytearray(movie.moov(sizes)))], "place long, data binary")
    placed = own.select("frame_idx", "data").join(sample_index(own.select("frame_idx", "size")), "frame_idx")
    return placed.select((F.col("offset") + len(head)).alias("place"), "data").unionByName(ends)


def write_movie(packets: DataFrame, path: str, movie: Movie) -> int:
    """Writes one movie file through Hadoop's file system; returns its size.

    Parts reach the driver in order, a partition at a time, and go on to the file.
    """
    spark = packets.sparkSession
    target, size = spark._jvm.org.apache.hadoop.fs.Path(path), 0
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        for row in movie_parts(packets, movie).orderBy("place").select("data").toLocalIterator(prefetchPartitions=False):
            out.write(row["data"])
            size += len(row["data"])
    finally:
        out.close()
    return size


NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf")


def list_boxes(data: bytes, at: int = 0, end: int | None = None, path: str = "") -> list[tuple[str, int, int, bytes]]:
    """(path, offset, size, content) of all boxes of a movie, in order."""
    out, end = [], len(data) if end is None else end
    while at < end:
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            (size,), head = struct.unpack(">Q", data[at + 8 : at + 16]), 16
        name = f"{path}/{kind.decode()}"
        out.append((name, at, size, data[at + head : at + size]))
        if kind in NESTED:
            out += list_boxes(data, at + head, at + size, name)
        at += size
    return out


def movie_bytes(packets: list[bytes], movie: Movie) -> bytes:
    """A whole small movie in memory."""
    return movie.header(sum(map(len, packets))) + b"".join(packets) + movie.moov([len(p) for p in packets])
