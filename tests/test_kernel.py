"""The kernel against plain loops, and what must hold of any packet."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from framewright.functions.tables import BASIS, Config
from framewright.operators import kernel
from framewright.sources.frames import synthetic_rgba

from . import scalar

BLOCKS = {
    "flat 0": np.zeros((8, 8)), "flat 88": np.full((8, 8), 88), "flat 512": np.full((8, 8), 512), "flat 1023": np.full((8, 8), 1023),
    "ramp": np.tile(10 * np.arange(8) - 35, (8, 1)), "checks": 100 * (1 - 2 * (np.indices((8, 8)).sum(axis=0) % 2)),
    "edge": np.where(np.arange(8) < 4, -200, 200) * np.ones((8, 1)), "diagonal": np.where(np.indices((8, 8)).sum(axis=0) < 8, -150, 150),
}


@pytest.mark.parametrize("name", BLOCKS)
def test_transform_is_the_two_rounded_products(name):
    block = BLOCKS[name].astype(np.int64)
    assert kernel.transform(block[None])[0].ravel().tolist() == scalar.dct(block.tolist())


@pytest.mark.parametrize(("value", "dc"), [(88, 2816), (512, 16384), (1023, 32736)])
def test_flat_blocks_have_dc_alone(value, dc):
    got = kernel.transform(np.full((1, 8, 8), value))[0].ravel()
    assert got[0] == dc and not got[1:].any()


def test_basis_rows_are_orthogonal_enough():
    m = np.array(BASIS, dtype=float)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert np.abs(m @ m.T - np.eye(8)).max() < 1e-3


@given(st.integers(0, 255), st.integers(0, 40000))
@settings(max_examples=300, deadline=None)
def test_codewords(book, value):
    if (book >> 2) & 7 > (book & 3) + (book >> 5) + 7:
        return
    code, bits = kernel.codeword(np.array([book]), np.array([value]))
    text = scalar.word(book, value)
    assert (int(code[0]), int(bits[0])) == (int(text, 2), len(text))


@pytest.mark.parametrize("size", [(17, 9), (33, 31), (130, 18), (16, 16)])
@pytest.mark.parametrize("profile", range(6))
def test_packets_equal_the_loops(size, profile):
    if profile % 2 and size == (33, 31):
        return
    c = Config(*size, profile=profile)
    rgba = synthetic_rgba(3, *size)
    assert kernel.encode(rgba, c) == scalar.encode(rgba, c)


def test_noise_drives_the_search_beyond_the_regular_quantizers():
    c = Config(130, 16, profile=0)
    rgba = np.random.default_rng(5).integers(0, 256, c.frame_bytes, dtype=np.uint8).tobytes()
    assert kernel.encode(rgba, c) == scalar.encode(rgba, c)
    frame = kernel.Frame(np.frombuffer(rgba, np.uint8).reshape(16, 130, 4), c)
    assert frame.quantizers().max() > c.max_q


@pytest.mark.parametrize("profile", [3, 4])
def test_what_holds_of_a_packet(profile):
    c = Config(150, 37, profile=profile)
    data = kernel.encode(synthetic_rgba(1, 150, 37), c)
    assert int.from_bytes(data[:4], "big") == len(data) and data[4:8] == b"icpf"
    n = int.from_bytes(data[161:163], "big")
    sizes = [int.from_bytes(data[164 + 2 * i : 166 + 2 * i], "big") for i in range(n)]
    assert n == c.slices_per_row * c.mb_height
    assert int.from_bytes(data[157:161], "big") == len(data) - 156 == 8 + 2 * n + sum(sizes)
    frame = kernel.Frame(np.frombuffer(synthetic_rgba(1, 150, 37), np.uint8).reshape(37, 150, 4), c)
    q = frame.quantizers()
    if not c.is_444:  # the estimate is what is written
        assert [8 * s for s in sizes] == frame.cost(q)[0].tolist()


def test_frames_of_another_length_are_refused():
    with pytest.raises(ValueError, match="bytes"):
        kernel.encode(b"1234", Config(16, 16))


@pytest.mark.parametrize("bad", [{"width": 0}, {"height": -1}, {"width": 1.5}, {"profile": 6}, {"fps_den": 0}, {"color_range": "odd"}, {"width": True}])
def test_configurations_are_checked(bad):
    with pytest.raises(ValueError):
        Config(**{"width": 16, "height": 16} | bad)


def test_full_range_and_alpha_differ():
    rgba = synthetic_rgba(0, 16, 16)
    assert kernel.encode(rgba, Config(16, 16)) != kernel.encode(rgba, Config(16, 16, color_range="full"))


@given(st.lists(st.integers(0, 4), min_size=1, max_size=600))
@settings(max_examples=100, deadline=None)
def test_alpha_codes(values):
    pixels = [(0, 64, 65535, 32768, 1)[v] for v in values]
    assert bytes(kernel.alpha_code(np.array(pixels), np.array([len(pixels)]))[0]) == scalar.to_bytes(scalar.alpha_bits(pixels))
