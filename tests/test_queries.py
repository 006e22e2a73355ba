"""Every query against its SQL, and those without against what is known otherwise."""

import pytest
from pyspark.sql import functions as F

from framewright.plans import registry
from framewright.plans.registry import ODD, ORACLES, QUERIES

from .conftest import same_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf_dir, duck, name):
    assert same_rows(QUERIES[name](spark, sf_dir), duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_and_repeats(spark, sf_dir, name):
    one = sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))
    assert one and one == sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))


def test_luma_of_the_first_frame(spark, sf_dir):
    got = {r["plane"]: r for r in QUERIES["prj1_yuv422"](spark, sf_dir).where("frame_idx = 0").collect()}["y"]
    assert (got["n"], got["sum_v"], got["min_v"], got["max_v"]) == (10240, 5225750, 95, 929)


def test_partitioning_changes_no_byte(spark, sf_dir):
    from framewright.operators.encode import encode_frames

    frames = registry.sources.synthetic_frames(spark.range(5).withColumnRenamed("id", "frame_idx"), ODD.width, ODD.height)
    one, many = ({r["frame_idx"]: bytes(r["data"]) for r in encode_frames(frames.repartition(n), ODD).collect()} for n in (1, 5))
    assert one == many and len(one) == 5


def test_slices_assembled_in_sql_are_the_kernels_packet(spark, sf_dir):
    assembled = {r["frame_idx"]: r["md5"] for r in QUERIES["bit6_assembled"](spark, sf_dir).collect()}
    direct = registry.encode.encode_frames(registry.rgba(spark, sf_dir, ODD), ODD).select("frame_idx", F.md5("data").alias("md5"))
    assert assembled == {r["frame_idx"]: r["md5"] for r in direct.collect()}


def test_bits_of_the_windows_are_the_kernels(spark, sf_dir):
    """At one quantizer, the window operators' cost is the kernel's for every slice."""
    import numpy as np

    from framewright.operators import kernel
    from framewright.sources.frames import synthetic_rgba

    cost = {}
    for r in QUERIES["agg4_plane_cost"](spark, sf_dir).where("frame_idx = 0").collect():
        b, e = cost.get((r["mb_row"], r["slice"]), (48, 0))
        cost[r["mb_row"], r["slice"]] = (b + r["bits"], e + r["error"])
    frame = kernel.Frame(np.frombuffer(synthetic_rgba(0, ODD.width, ODD.height), np.uint8).reshape(ODD.height, ODD.width, 4), ODD)
    bits, error = frame.cost(np.full(ODD.slices_per_row * ODD.mb_height, registry.Q))
    assert [cost[divmod(i, ODD.slices_per_row)] for i in range(len(bits))] == list(zip(bits.tolist(), error.tolist(), strict=True))


def test_stream_equals_batch(spark, sf_dir):
    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))
    assert rows("stream_packets") == rows("bit8_frame_md5")


@pytest.mark.parametrize(("one", "other"), [("src4_converted", "bit8_frame_md5"), ("src8_raw_file", "src1_frames"), ("stream_movie", "mux_movie")])
def test_ways_to_the_same_bytes(spark, sf_dir, one, other):
    rows = lambda name: sorted(map(tuple, QUERIES[name](spark, sf_dir).collect()))
    assert rows(one) == rows(other)
