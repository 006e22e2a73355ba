"""Boxes, offsets and files."""

import struct

import pytest

from framewright.functions.tables import Config
from framewright.operators import container
from framewright.operators.container import Movie


def boxes(data: bytes, at: int = 0) -> dict[str, bytes]:
    out = {}
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        out[kind.decode()] = data[at + head : at + size]
        at += size
    assert at == len(data)
    return out


def table(data: bytes) -> dict[str, bytes]:
    moov = boxes(boxes(data)["moov"])
    return boxes(boxes(boxes(boxes(moov["trak"])["mdia"])["minf"])["stbl"])


@pytest.mark.parametrize("profile", [0, 3, 5])
def test_a_movie_can_be_read_again(profile):
    c = Config(1920, 1080, profile=profile, fps_num=30000, fps_den=1001)
    packets = [bytes([0, 0, 0, 9]) + b"icpf" + bytes([i]) * i for i in range(5)]
    data = container.movie_bytes(packets, Movie(c, has_alpha=profile == 5).at(0))
    top = boxes(data)
    assert list(top) == ["ftyp", "mdat", "moov"] and top["mdat"] == b"".join(packets)
    t = table(data)
    assert list(t) == ["stsd", "stts", "stss", "stsc", "stsz", "stco"]
    sizes = struct.unpack(">5I", t["stsz"][12:])
    offsets = struct.unpack(">5I", t["stco"][8:])
    assert [data[o : o + s] for o, s in zip(offsets, sizes, strict=True)] == packets
    assert struct.unpack(">4I", t["stts"]) == (0, 1, 5, 1001) and struct.unpack(">7I", t["stss"]) == (0, 5, 1, 2, 3, 4, 5)
    assert t["stsd"][12:16].decode() == c.fourcc
    depth = struct.unpack(">H", t["stsd"][8 + 82 : 8 + 84])[0]
    assert depth == (32 if profile == 5 else 24)
    mvhd = boxes(top["moov"])["mvhd"]
    assert len(mvhd) == 100 and struct.unpack(">2I", mvhd[12:20]) == (30000, 5005) and struct.unpack(">I", mvhd[4:8])[0] == 2082844800


def test_creation_time_alone_changes_the_bytes():
    m = Movie(Config(16, 16))
    assert container.movie_bytes([b"abc"], m) == container.movie_bytes([b"abc"], m) != container.movie_bytes([b"abc"], m.at(5))


def test_large_files_have_wide_offsets():
    m = Movie(Config(16, 16))
    sizes = [2**31, 2**31, 10]
    assert len(m.header(sum(sizes))) == 36 and m.header(sum(sizes))[20:28] == struct.pack(">I4s", 1, b"mdat")
    stbl = boxes(m.stbl(sizes))["stbl"]
    assert struct.unpack(">3Q", boxes(stbl)["co64"][8:]) == (36, 36 + 2**31, 36 + 2**32)


def test_a_movie_needs_a_frame():
    with pytest.raises(ValueError):
        Movie(Config(16, 16)).moov([])


def test_index_does_not_depend_on_its_ranges(spark):
    packets = spark.range(50).selectExpr("id * 3 AS frame_idx", "id % 7 + 1 AS size")
    rows = [sorted(map(tuple, container.sample_index(packets, n).collect())) for n in (4, 1000)]
    assert rows[0] == rows[1] and rows[0][0] == (0, 1, 0)
    c = Config(16, 16)
    rows = [sorted(map(tuple, container.file_index(packets, c, n).collect())) for n in (4, 1000)]
    assert rows[0] == rows[1] and [r[0] for r in rows[0]] == list(range(1, 51))
    assert container.sample_index(packets.where("size < 0")).count() == 0


def test_written_movie(spark, tmp_path):
    packets = [bytes([65 + i]) * (i + 1) for i in range(6)]
    df = spark.createDataFrame([(i, len(p), bytearray(p)) for i, p in enumerate(packets)], "frame_idx long, size long, data binary").repartition(3)
    m = Movie(Config(16, 16))
    n = container.write_movie(df, f"file://{tmp_path}/out.mov", m)
    data = (tmp_path / "out.mov").read_bytes()
    assert data == container.movie_bytes(packets, m) and n == len(data)
    parts = {r["place"]: bytes(r["data"]) for r in container.movie_parts(df, m).collect()}
    assert len(parts) == 8 and all(data[at : at + len(part)] == part for at, part in parts.items()) and sum(map(len, parts.values())) == n
