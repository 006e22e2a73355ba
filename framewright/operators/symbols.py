"""Entropy-coding symbols as window operators, their costs, and their bits.

All windows are over a slice's plane, in coding order, so every operator here shares one
partitioning; a partition is a slice's plane, at most 32 blocks, however long the film.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import align, code_bits, code_word, lookup, zigzag
from ..functions.tables import DC_BOOKS, FIRST_DC_BOOK, LEVEL_BOOKS, RUN_BOOKS
from .blocks import SLICE

PLANE = (*SLICE, "plane")


def dc_symbols(levels: DataFrame) -> DataFrame:
    """Adds delta (sign-flipped after a fall), code, book.

    Two windows, one over the other: the flip looks at the difference before, which looks at the
    level before. The first DC of a slice has a book of its own, the second a fixed one.
    """
    order = Window.partitionBy(*PLANE).orderBy("block_no")
    raw = levels.withColumn("raw", F.col("level") - F.lag("level").over(order))
    fell = F.coalesce(F.lag("raw").over(order) < 0, F.lit(False))
    delta = F.when(F.col("raw").isNull(), F.col("level")).when(fell, -F.col("raw")).otherwise(F.col("raw"))
    coded = raw.withColumn("delta", delta).withColumn("code", zigzag(F.col("delta")))
    context = F.when(F.lag("raw").over(order).isNull(), F.lit(5).cast("long")).otherwise(F.least(F.lag("code").over(order), F.lit(6).cast("long")))
    book = F.when(F.col("raw").isNull(), F.lit(FIRST_DC_BOOK)).otherwise(lookup(DC_BOOKS, context))
    return coded.withColumn("book", book).drop("raw")


def _marked(levels: DataFrame) -> DataFrame:
    """Adds coded and, for coded entries, run, run_context, level_context, from the coded entry before.

    Entries of level zero are a window partition of their own: they are kept, and not looked at.
    """
    order = Window.partitionBy(*PLANE, "coded").orderBy("pos")
    before = lambda c, first, most: F.least(F.coalesce(F.lag(c).over(order), F.lit(first).cast("long")), F.lit(most).cast("long"))
    marked = levels.withColumn("coded", F.col("level") != 0)
    runs = marked.withColumn("run", F.col("pos") - F.coalesce(F.lag("pos").over(order), F.lit(-1).cast("long")) - 1)
    return runs.withColumns({"run_context": before("run", 4, 15), "level_context": before("level", 2, 9)})


def ac_symbols(levels: DataFrame) -> DataFrame:
    """Of the levels that aren't zero: run, run_context, level_context."""
    return _marked(levels.where("level <> 0")).drop("coded")


def alpha_runs(alpha: DataFrame) -> DataFrame:
    """(slice, n, v, diff, run) from (slice, i, v): islands of equal alpha, and the wrapped difference to the one before."""
    keys = [c for c in alpha.columns if c not in ("i", "v")]
    order = Window.partitionBy(*keys).orderBy("i")
    marked = alpha.withColumn("new", F.coalesce((F.col("v") != F.lag("v").over(order)), F.lit(True)).cast("long"))
    islands = marked.withColumn("n", F.sum("new").over(order)).groupBy(*keys, "n").agg(F.first("v").alias("v"), (F.count("*") - 1).alias("run"))
    diff = (F.col("v") - F.coalesce(F.lag("v").over(Window.partitionBy(*keys).orderBy("n")), F.lit(0xFFFF).cast("long"))).bitwiseAND(F.lit(0xFFFF))
    return islands.withColumn("diff", diff)


def alpha_bits(runs: DataFrame) -> DataFrame:
    """(slice, bits) of coded alpha: short differences take 8 bits, others 17; runs 1, 5 or 16."""
    signed = F.when(F.col("diff") >= 0x10000 - 64, F.col("diff") - 0x10000).otherwise(F.col("diff"))
    one = F.when((F.abs(signed) > 64) | (signed == 0), 17).otherwise(8) + F.when(F.col("run") == 0, 1).when(F.col("run") < 16, 5).otherwise(16)
    keys = [c for c in runs.columns if c not in ("n", "v", "run", "diff")]
    return runs.groupBy(*keys).agg(F.sum(one).alias("bits"))


def dc_cost(symbols: DataFrame) -> DataFrame:
    """(slice, plane, dc_bits, dc_error)."""
    return symbols.groupBy(*PLANE).agg(F.sum(code_bits(F.col("book"), F.col("code"))).alias("dc_bits"), F.sum(F.abs("dc") % F.col("scale")).alias("dc_error"))


def ac_cost(levels: DataFrame) -> DataFrame:
    """(slice, plane, ac_bits, ac_error): the error is over all entries, the bits over those that are left."""
    run_book, level_book = lookup(RUN_BOOKS, F.col("run_context")), lookup(LEVEL_BOOKS, F.col("level_context"))
    bits = code_bits(run_book, F.col("run")) + code_bits(level_book, F.col("level") - 1) + 1
    coded = F.coalesce(F.sum(F.when(F.col("coded"), bits)), F.lit(0)).cast("long")
    return _marked(levels).groupBy(*PLANE).agg(coded.alias("ac_bits"), F.sum("rest").alias("ac_error"))


def plane_cost(dc: DataFrame, ac: DataFrame) -> DataFrame:
    """(slice, plane, bits, error): in whole bytes; a plane without AC entries has DC alone."""
    rows = dc.select(*PLANE, F.col("dc_bits").alias("bits"), F.col("dc_error").alias("error")).union(ac.select(*PLANE, "ac_bits", "ac_error"))
    both = rows.groupBy(*PLANE).agg(F.sum("bits").alias("bits"), F.sum("error").alias("error"))
    return both.select(*PLANE, align(F.col("bits").cast("long"), 8).alias("bits"), F.col("error").cast("long").alias("error"))


def plane_bits(dc: DataFrame, ac: DataFrame) -> DataFrame:
    """(slice, plane, text): the plane's bits as zeros and ones, filled to whole bytes."""
    word = lambda code, bits: F.lpad(F.bin(code), bits.cast("int"), "0")
    run_book, level_book = lookup(RUN_BOOKS, F.col("run_context")), lookup(LEVEL_BOOKS, F.col("level_context"))
    level = F.col("level") - 1
    first = dc.select(*PLANE, F.lit(0).alias("kind"), F.col("block_no").cast("long").alias("at"), word(code_word(F.col("book"), F.col("code")), code_bits(F.col("book"), F.col("code"))).alias("text"))
    text = F.concat(word(code_word(run_book, F.col("run")), code_bits(run_book, F.col("run"))), word(code_word(level_book, level), code_bits(level_book, level)), F.when(F.col("coeff") < 0, "1").otherwise("0"))
    then = ac.select(*PLANE, F.lit(1).alias("kind"), F.col("pos").cast("long").alias("at"), text.alias("text"))
    joined = first.unionByName(then).groupBy(*PLANE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("kind", "at", "text"))), lambda s: s["text"]), "").alias("text"))
    return joined.withColumn("text", F.rpad("text", align(F.length("text"), 8), "0"))


def bits_to_bytes(text: Column) -> Column:
    """A text of zeros and ones, a multiple of 8 long, as binary: a byte at a time."""
    count = F.call_function("div", F.length(text), F.lit(8)).cast("int")
    each = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))
    return F.unhex(F.array_join(F.transform(each, lambda i: F.lpad(F.conv(F.substring(text, i * 8 + 1, F.lit(8)), 2, 16), 2, "0")), ""))
