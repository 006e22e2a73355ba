"""The programming interface."""

import numpy as np
import pytest

from framewright import encoder
from framewright.operators import kernel
from framewright.sources.frames import FRAMES, synthetic_rgba


@pytest.mark.parametrize("profile", ["HQ", "ap4h", 0])
def test_frame_by_frame_and_as_a_film(spark, tmp_path, profile):
    c = encoder.config(33, 18, profile, fps=23.976)
    assert (c.fps_num, c.fps_den) == (24000, 1001)
    frames = [synthetic_rgba(i, 33, 18) for i in range(4)]
    whole, handed = encoder.FrameEncoder(c), []
    parts = encoder.FrameEncoder(c, handed.append)
    for f in frames:
        assert whole.add_rgba(f) == parts.add_rgba(f) == whole.encode_rgba(f)
    head, end = parts.headers()
    data = whole.finish()
    assert data == head + b"".join(handed) + end and whole.frame_count == 4 and float(whole.duration) == pytest.approx(4 * 1001 / 24000)
    for e in (whole, parts):
        with pytest.raises(RuntimeError):
            e.add_rgba(frames[0])
    with pytest.raises(RuntimeError):
        parts.finish()
    df = spark.createDataFrame([(i, 33, 18, bytearray(f)) for i, f in enumerate(frames)], FRAMES).repartition(3)
    encoder.FilmEncoder(c).write(df, f"file://{tmp_path}/film.mov")
    assert (tmp_path / "film.mov").read_bytes() == data


@pytest.mark.parametrize("profile", [3, 5])
def test_converted_frames(profile):
    c = encoder.config(17, 9, profile)
    rgba = synthetic_rgba(2, 17, 9)
    planes = kernel.to_planes(np.frombuffer(rgba, np.uint8).reshape(9, 17, 4), c)
    data = b"".join(p.astype("<u2").tobytes() for p in planes)
    e = encoder.FrameEncoder(c)
    assert len(data) == encoder.yuv_size(c) and encoder.rgba_size(c) == len(rgba)
    assert e.add_yuv(data) == kernel.encode(rgba, c)
    with pytest.raises(ValueError):
        e.add_yuv(data[:-2])


def test_rates_and_names():
    assert encoder.frame_rate() == (30, 1) and encoder.frame_rate(29.97) == (30000, 1001) and encoder.frame_rate(12.5) == (25, 2)
    assert encoder.frame_rate(50.0, 1, 2) == (1, 2) and encoder.PROFILE_NAMES[3] == "HQ"
    with pytest.raises(ValueError):
        encoder.config(16, 16, "none")
