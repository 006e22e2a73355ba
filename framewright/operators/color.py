"""Colour conversion, subsampling, padding and tiling over pixel and sample rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import align, clamp
from ..functions.tables import COLOR, SLICE_MBS, Config

PLANES = ("y", "cb", "cr", "a")


def raw_sample(name: str, r: Column, g: Column, b: Column, color_range: str) -> Column:
    """A component in 10 bits, before its limits."""
    kr, kg, kb, offset, _, _ = COLOR[color_range][name]
    return F.shiftright(r * kr + g * kg + b * kb + 2048, 12) + offset


def sample(name: str, r: Column, g: Column, b: Column, color_range: str) -> Column:
    low, high = COLOR[color_range][name][4:]
    return clamp(raw_sample(name, r, g, b, color_range), low, high)


def alpha10(a: Column) -> Column:
    """8 bits to 10."""
    return F.least(F.lit(1023), F.shiftright(a * 16430 + 2048, 12))


def _rows(df: DataFrame, x: Column, planes: dict[str, Column]) -> DataFrame:
    """A row per plane of each row: one pass over the input, no join."""
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("plane"), v.cast("int").alias("v")) for n, v in planes.items()))).alias("s")
    return df.select("frame_idx", "y", x.alias("x"), each).select("frame_idx", "s.plane", "y", "x", "s.v")


def yuv444(pixels: DataFrame, color_range: str = "limited", alpha: bool = False) -> DataFrame:
    """(frame_idx, plane, y, x, v): all planes in full size; with alpha the fourth too."""
    rgb = F.col("r"), F.col("g"), F.col("b")
    planes = {n: sample(n, *rgb, color_range) for n in ("y", "cb", "cr")}
    return _rows(pixels, F.col("x"), planes | ({"a": alpha10(F.col("a"))} if alpha else {}))


def yuv422(pixels: DataFrame, color_range: str = "limited") -> DataFrame:
    """(frame_idx, plane, y, x, v): chroma of half width, from the truncated mean of a pair's colours.

    A pair's two pixels are summed before they are shuffled; an odd last column, alone in its
    pair, is its own mean.
    """
    luma = _rows(pixels, F.col("x"), {"y": sample("y", F.col("r"), F.col("g"), F.col("b"), color_range)})
    pairs = pixels.groupBy("frame_idx", "y", F.call_function("div", F.col("x"), F.lit(2)).alias("x")).agg(*(F.call_function("div", F.sum(c), F.count("*")).alias(c) for c in "rgb"))
    rgb = F.col("r"), F.col("g"), F.col("b")
    return luma.unionByName(_rows(pairs, F.col("x"), {n: sample(n, *rgb, color_range) for n in ("cb", "cr")}))


def plane_width(config: Config) -> Column:
    """A plane's width as it comes in, by the column ``plane``."""
    half = F.col("plane").isin("cb", "cr") & F.lit(not config.is_444)
    return F.when(half, (config.width + 1) // 2).otherwise(config.width)


def pad(samples: DataFrame, config: Config) -> DataFrame:
    """Repeats last columns and rows up to whole macroblocks.

    Each sample says itself where it goes: a sample of the last column or row is several rows
    then, so there is no join and no shuffle.
    """
    width, height = config.mb_width * 16, config.mb_height * 16
    own, full = plane_width(config), F.when(F.col("plane").isin("cb", "cr") & F.lit(not config.is_444), width // 2).otherwise(width)
    upto = lambda at, last, end: F.sequence(at, F.when(at == last, F.lit(end).cast("long") if isinstance(end, int) else end.cast("long")).otherwise(at))
    wide = samples.select("frame_idx", "plane", "y", F.explode(upto(F.col("x").cast("long"), own - 1, full - 1)).alias("x"), "v")
    return wide.select("frame_idx", "plane", F.explode(upto(F.col("y").cast("long"), F.lit(config.height - 1), height - 1)).alias("y"), "x", "v")


def tiles(padded: DataFrame, config: Config) -> DataFrame:
    """(frame_idx, mb_row, slice, slice_width, plane, block_no, r, c, v): where each sample stands in its block.

    Luma blocks of a macroblock go by rows, half-width chroma from top to bottom, full chroma by columns.
    """
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    x, y = F.col("x").cast("long"), F.col("y").cast("long")
    half = F.col("plane").isin("cb", "cr") & F.lit(not config.is_444)
    mb = F.when(half, div(x, 8)).otherwise(div(x, 16))
    down, right = div(y % 16, 8), div(x % 16, 8)
    within = F.when(half, down).when(F.col("plane") == "y", 2 * down + right).otherwise(2 * right + down)
    per = F.when(half, 2).otherwise(4)
    return padded.select(
        "frame_idx", div(y, 16).alias("mb_row"), div(mb, SLICE_MBS).alias("slice"),
        F.least(F.lit(SLICE_MBS), config.mb_width - SLICE_MBS * div(mb, SLICE_MBS)).alias("slice_width"),
        "plane", ((mb % SLICE_MBS) * per + within).alias("block_no"), (y % 8).alias("r"), (x % 8).alias("c"), F.col("v").cast("long").alias("v"),
    )


def alpha16(padded: DataFrame, config: Config) -> DataFrame:
    """(frame_idx, mb_row, slice, i, v): alpha in 16 bits, in raster order within each slice."""
    div = lambda a, b: F.call_function("div", a, F.lit(b))
    x, y, v = F.col("x").cast("long"), F.col("y").cast("long"), clamp(F.col("v").cast("long"), 0, 1023)
    slice_no = div(x, 16 * SLICE_MBS)
    width = 16 * F.least(F.lit(SLICE_MBS), config.mb_width - SLICE_MBS * slice_no)
    wide = F.shiftleft(v, 6).bitwiseOR(F.shiftright(v, 4))
    return padded.where("plane = 'a'").select("frame_idx", div(y, 16).alias("mb_row"), slice_no.alias("slice"), ((y % 16) * width + x % (16 * SLICE_MBS)).alias("i"), wide.alias("v"))


def padded_size(config: Config) -> tuple[int, int]:
    return config.mb_width * 16, config.mb_height * 16


__all__ = ["align", "alpha10", "alpha16", "pad", "padded_size", "plane_width", "raw_sample", "sample", "tiles", "yuv422", "yuv444"]
