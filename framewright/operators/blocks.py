"""The transform, and quantization, over block rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import descale, whole_div
from ..functions.tables import BASIS, CHROMA, DC_OFFSET, LUMA, SCAN, Config

SLICE = ("frame_idx", "mb_row", "slice", "slice_width")
BLOCK = (*SLICE, "plane", "block_no")


def _product(u: int, values: list[Column], even_bits: int, odd_bits: int) -> Column:
    total = sum((v * m for v, m in zip(values[1:], BASIS[u][1:], strict=True)), values[0] * BASIS[u][0])
    bits = even_bits if u % 4 == 0 else odd_bits
    return total * 2 if bits == 0 else descale(total, bits)


def dct_rows(tiled: DataFrame) -> DataFrame:
    """(block, r, p0..p7): the first pass, a projection over a block row's eight samples.

    The samples of a row lie together in the input, so the map-side part of the aggregate leaves an
    eighth of the rows to be shuffled; the second pass shuffles those once more, by block.
    """
    placed = [F.max(F.when((F.col("c") == c), F.col("v"))).alias(f"s{c}") for c in range(8)]
    rows = tiled.groupBy(*BLOCK, "r").agg(*placed)
    values = [F.col(f"s{c}") for c in range(8)]
    return rows.select(*BLOCK, "r", *(_product(u, values, 0, 12).alias(f"p{u}") for u in range(8)))


def dct_blocks(rows: DataFrame) -> DataFrame:
    """(block, coef): 64 coefficients in raster order."""
    packed = rows.groupBy(*BLOCK).agg(F.array_sort(F.collect_list(F.struct("r", F.array(*(f"p{u}" for u in range(8))).alias("p")))).alias("rows"))
    at = lambda k, c: F.get(F.get("rows", F.lit(k))["p"], c)
    columns = F.sequence(F.lit(0), F.lit(7))

    def line(u: int) -> Column:
        return F.transform(columns, lambda c: _product(u, [at(k, c) for k in range(8)], 2, 15))

    lines = [line(u) for u in range(8)]
    return packed.select(*BLOCK, F.concat(*lines).alias("coef"))


def matrix_value(config: Config, raster: Column) -> Column:
    """The quantization matrix's entry, by the column ``plane``."""
    table = lambda m: F.get(F.array(*map(F.lit, m)), raster.cast("int"))
    return F.when(F.col("plane") == "y", table(LUMA[config.profile])).otherwise(table(CHROMA[config.profile]))


def scaled_matrix(matrix: DataFrame, quantizers: DataFrame) -> DataFrame:
    """(plane, raster, q, weight) from (plane, raster, m) and the few (q): premultiplied, 1 at least."""
    return matrix.join(F.broadcast(quantizers)).select("plane", "raster", "q", F.greatest(F.lit(1).cast("long"), F.col("m") * F.col("q")).alias("weight"))


def dc_levels(blocks: DataFrame, config: Config, q) -> DataFrame:
    """(block, dc, scale, level): DC without its offset, quantized toward zero."""
    q = F.lit(q) if isinstance(q, int) else q
    dc = F.get("coef", F.lit(0)) - DC_OFFSET
    scale = F.greatest(F.lit(1).cast("long"), (matrix_value(config, F.lit(0)) * q).cast("long"))
    return blocks.select(*BLOCK, dc.alias("dc"), scale.alias("scale"), whole_div(dc, scale).alias("level"))


def ac_entries(blocks: DataFrame, config: Config) -> DataFrame:
    """(slice, plane, pos, raster, coeff, weight): what isn't zero, in the order of coding.

    The position goes over all blocks of the slice at one place of the scan, then to the next.
    """
    per = F.col("slice_width") * F.when((F.col("plane") == "y") | F.lit(config.is_444), 4).otherwise(2)
    scan = F.array(*map(F.lit, SCAN))
    each = F.posexplode(F.transform(F.slice(scan, 2, 63), lambda k: F.struct(k.alias("raster"), F.get("coef", k).alias("coeff")))).alias("i", "e")
    rows = blocks.select(*BLOCK, per.alias("per"), each).where("e.coeff <> 0")
    return rows.select(*SLICE, "plane", (F.col("i") * F.col("per") + F.col("block_no")).alias("pos"), F.col("e.raster").alias("raster"), F.col("e.coeff").alias("coeff"), matrix_value(config, F.col("e.raster")).cast("long").alias("weight"))


def ac_levels(entries: DataFrame, q) -> DataFrame:
    """Adds level and rest: size over weight times q, truncated, and what that leaves."""
    q = F.lit(q) if isinstance(q, int) else q
    size, scale = F.abs("coeff"), F.greatest(F.lit(1).cast("long"), F.col("weight") * q)
    return entries.withColumns({"level": whole_div(size, scale), "rest": size % scale})
