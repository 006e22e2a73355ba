"""Sources and the small files around them."""

import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from framewright.functions import columns as C
from framewright.functions.tables import Config
from framewright.sources import frames, records


def png(pixels: np.ndarray, kind: int, filters) -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    h, w, n = pixels.shape
    rows, above = b"", np.zeros(w * n, int)
    for y in range(h):
        line = pixels[y].ravel().astype(int)
        f = filters[y % len(filters)]
        left, corner = np.r_[np.zeros(n, int), line[:-n]], np.r_[np.zeros(n, int), above[:-n]]
        p = left + above - corner
        a, b, c = abs(p - left), abs(p - above), abs(p - corner)
        paeth = np.where((a <= b) & (a <= c), left, np.where(b <= c, above, corner))
        rows += bytes([f]) + bytes(((line - (0, left, above, (left + above) // 2, paeth)[f]) & 255).tolist())
        above = line
    head = struct.pack(">IIBBBBB", w, h, 8, kind, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


@pytest.mark.parametrize(("kind", "n"), [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_png(kind, n):
    px = np.random.default_rng(kind).integers(0, 256, (7, 5, n), dtype=np.uint8)
    got = frames.png_pixels(png(px, kind, (0, 1, 2, 3, 4)))
    assert (got[..., :3] == (px[..., :3] if n > 2 else px[..., :1])).all()
    assert (got[..., 3] == (px[..., -1] if n in (2, 4) else 255)).all()


def packed_png(lines: list[bytes], width: int, height: int, depth: int, kind: int, laced: int = 0, **chunks: bytes) -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, laced))
    more = b"".join(chunk(k.encode(), d) for k, d in chunks.items())
    return b"\x89PNG\r\n\x1a\n" + head + more + chunk(b"IDAT", zlib.compress(b"".join(b"\0" + x for x in lines))) + chunk(b"IEND", b"")


def test_png_depths():
    draw = np.random.default_rng(3)
    wide = draw.integers(0, 1 << 16, (4, 5, 3))
    got = frames.png_pixels(packed_png([r.astype(">u2").tobytes() for r in wide], 5, 4, 16, 2))
    assert (got[..., :3] == wide >> 8).all() and (got[..., 3] == 255).all()
    for depth in (1, 2, 4):
        grey = draw.integers(0, 1 << depth, (3, 11))
        lines = [np.packbits(np.unpackbits(r.astype(np.uint8)[:, None], axis=1)[:, 8 - depth :].ravel()).tobytes() for r in grey]
        got = frames.png_pixels(packed_png(lines, 11, 3, depth, 0))
        assert (got[..., 0] == grey * (255 // ((1 << depth) - 1))).all()
        colours = draw.integers(0, 256, (1 << depth, 3), dtype=np.uint8)
        got = frames.png_pixels(packed_png(lines, 11, 3, depth, 3, PLTE=colours.tobytes(), tRNS=b"\x07"))
        assert (got[..., :3] == colours[grey]).all() and (got[..., 3] == np.where(grey == 0, 7, 255)).all()


@pytest.mark.parametrize("size", [(1, 1), (3, 2), (9, 13), (16, 8)])
def test_interlaced_png(size):
    w, h = size
    px = np.random.default_rng(w).integers(0, 256, (h, w, 4), dtype=np.uint8)
    lines = []
    for step, (x, y) in ((8, (0, 0)), (8, (4, 0)), ((4, 8), (0, 4)), (4, (2, 0)), ((2, 4), (0, 2)), (2, (1, 0)), ((1, 2), (0, 1))):
        across, down = step if isinstance(step, tuple) else (step, {8: 8, 4: 4, 2: 2}[step])
        part = px[y::down, x::across]
        lines += [r.tobytes() for r in part] if part.size else []
    assert (frames.png_pixels(packed_png(lines, w, h, 8, 6, 1)) == px).all()


def test_png_folder(spark, tmp_path):
    c = Config(5, 7)
    px = [np.random.default_rng(i).integers(0, 256, (7, 5, 4), dtype=np.uint8) for i in range(12)]
    for i, p in enumerate(px):
        (tmp_path / f"shot_{i}.png").write_bytes(png(p, 6, (i % 5,)))
    (tmp_path / "notes.txt").write_text("no image")
    got = frames.decode_png(frames.image_sequence(spark, str(tmp_path)), c)
    assert {r["frame_idx"]: bytes(r["rgba"]) for r in got.collect()} == {i: p.tobytes() for i, p in enumerate(px)}
    with pytest.raises(Exception, match="not 6 x 7"):
        frames.decode_png(frames.image_sequence(spark, str(tmp_path)), Config(6, 7)).collect()


def test_written_png_folder(spark, tmp_path):
    c = Config(6, 4)
    made = frames.synthetic_frames(spark.range(12).withColumnRenamed("id", "frame_idx"), 6, 4)
    frames.write_png(made, f"file://{tmp_path}/shots", "s_%d.png")
    got = frames.decode_png(frames.image_sequence(spark, f"file://{tmp_path}/shots"), c)
    assert {r["frame_idx"]: bytes(r["rgba"]) for r in got.collect()} == {i: frames.synthetic_rgba(i, 6, 4) for i in range(12)}


def test_numbering_does_not_depend_on_ranges(spark):
    names = [f"shot_{i}.png" for i in (9, 10, 2, 700, 70_000, 5)] + ["b.png", "a.png", "ab.png", "9_x.png", "x_0009.png"]
    df = spark.createDataFrame([(n,) for n in names], "name string")
    got = [[r["name"] for r in frames.number_names(df, n).orderBy("frame_idx").collect()] for n in (3, 65_536)]
    assert got[0] == got[1] == ["a.png", "ab.png", "b.png", "shot_2.png", "shot_5.png", "9_x.png", "shot_9.png", "x_0009.png", "shot_10.png", "shot_700.png", "shot_70000.png"]


def test_raw_file(spark, tmp_path):
    c = Config(4, 3)
    data = [frames.synthetic_rgba(i, 4, 3) for i in range(9)]
    (tmp_path / "clip.raw").write_bytes(b"".join(data))
    got = frames.raw_frames(spark, str(tmp_path / "clip.raw"), c).orderBy("frame_idx").collect()
    assert [bytes(r["rgba"]) for r in got] == data
    assert frames.raw_frames(spark, str(tmp_path / "clip.raw"), c, limit=4).count() == 4
    with pytest.raises(ValueError, match="whole number"):
        frames.raw_frames(spark, str(tmp_path / "clip.raw"), Config(5, 3))


def test_the_two_generators_agree(spark):
    px = frames.synthetic_pixels(spark.createDataFrame([(0,), (7,)], "frame_idx long"), 9, 5)
    for f in (0, 7):
        rows = px.where(F.col("frame_idx") == f).orderBy("y", "x").collect()
        assert bytes(v for r in rows for v in (r["r"], r["g"], r["b"], r["a"])) == frames.synthetic_rgba(f, 9, 5)


def test_frames_are_checked(spark):
    c = Config(2, 2)
    good = spark.createDataFrame([(0, 2, 2, bytearray(16))], frames.FRAMES)
    assert frames.check_frames(good, c).count() == 1
    for row in [(0, 2, 2, bytearray(15)), (0, 3, 2, bytearray(16)), (0, 2, 2, None)]:
        with pytest.raises(Exception, match="has 16 bytes|not 3 x 2"):
            frames.check_frames(spark.createDataFrame([row], frames.FRAMES), c).collect()


def test_sequences(spark, tmp_path):
    (tmp_path / "s.conf").write_text("# name|dir\nwalk|in/walk|640|480|30|1|90|0|f_%04d.png\nfade|in/fade|320|240|24000|1001|10|1|g_%d.png\n")
    assert records.read_sequences(spark, str(tmp_path / "s.conf")).count() == 2
    row = records.read_sequences(spark, str(tmp_path / "s.conf"), "fade").first()
    assert (row["fps_num"], row["fps_den"], row["has_alpha"], row["png_pattern"]) == (24000, 1001, 1, "g_%d.png")


def test_results_and_metrics(spark, tmp_path):
    (tmp_path / "r.csv").write_text('contender,threads,fps,note\nours,8,26.25,"a, quoted ""cell"""\nother,,,\n')
    rows = {r["contender"]: r for r in records.read_results(spark, str(tmp_path / "r.csv")).collect()}
    assert rows["ours"]["fps"] == 26.25 and rows["ours"]["note"] == 'a, quoted "cell"' and rows["other"]["fps"] is None and rows["ours"]["mbps"] is None
    (tmp_path / "m.json").write_text(json.dumps({"sequence": "s", "width": 4, "results": {"native": {"hq": {"size_bytes": 5, "psnr_avg": 50.5, "ssim_avg": 0.9}}}}, indent=1))
    got = records.flatten_metrics(records.read_json(spark, str(tmp_path / "m.json"), records.METRICS)).collect()
    assert [tuple(r) for r in got] == [("s", "native", "hq", 5, 50.5, 0.9)]
    table = spark.createDataFrame([("a", 1.5), (None, 2.0)], "k string, v double")
    assert [r[0] for r in records.markdown(table, ["k", "v"]).collect()] == ["| a | 1.5 |", "| - | 2.0 |"]
    for kind in ("json", "csv", "parquet"):
        records.write_report(table, str(tmp_path / kind), kind)
    assert spark.read.parquet(str(tmp_path / "parquet")).count() == 2


def test_rates(spark):
    cases = [(None, None, None, 30, 1), (25, 1, 60.0, 25, 1), (None, None, 23.98, 24000, 1001), (None, None, 29.97, 30000, 1001), (None, None, 50.0, 50, 1), (None, None, 12.5, 25, 2), (None, 1, 59.94, 60000, 1001)]
    df = spark.createDataFrame([(i, *c[:3]) for i, c in enumerate(cases)], "i int, num int, den int, fps double")
    got = df.select("i", C.resolve_rate(F.col("num"), F.col("den"), F.col("fps")).alias("f")).orderBy("i").select("f.*").collect()
    assert [tuple(r) for r in got] == [c[3:] for c in cases]


def test_sizes_in_words(spark):
    got = spark.createDataFrame([(512,), (2048,), (3 << 20,)], "n long").select(C.human_size(F.col("n"))).collect()
    assert [r[0] for r in got] == ["512 B", "2.0 KB", "3.00 MB"]
