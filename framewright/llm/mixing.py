"""Operator 8: mixing sources to target weights by pivotal dependent rounding.

Sources share all words by weight, none above ``MAX_COPIES`` times its size; the excess is shared
again by weight. A document of a source is to be taken target / size times on average: the whole
part of that is taken outright, the fraction by dependent rounding.

Two documents with fractions meet and move mass (words times fraction) between them until one's
fraction is 0 or 1; which way is drawn at random so that either's expectation stays. The sum of
mass never changes, so what a source takes misses its target by less than the one document that
is left in the end, which goes to the nearer side; then the one or two documents of the last block change
sides that bring the source nearest to its target. This is done as a reduction tree: documents are dealt into blocks of about ``BLOCK`` by a hash, a fold
over each block settles all but one of its documents, and the one left goes to the next level.
Each level has a ``BLOCK``-th of the rows of the one before; the last has one block per source.
The blocks do not depend on the source's size, so a source with a third of all rows has as many
more blocks, none of them larger. Blocks and draws are hashes of the level and the row: its id, its
text and, of rows equal in these, a number (equal rows are counted before the shuffle and told
apart after it), so neither a null id nor a hot one fills a block. Reruns agree.

Defined results: null text has size 0 and takes 0 words; a null source is a source, the last;
sources without words have target 0; repeated rows count each; an empty table gives no rows.
Only DataFrame functions are used.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, table

MAX_COPIES, BLOCK, SEED = 3, 64, 8
#: Fractions nearer than this to 0 or 1 are 0 or 1.
EPS = 1e-9
ROW = ("id", "row", "size", "source_size", "target", "whole", "p")
#: Equal rows that are written out from one row.
CHUNK = 1 << 16


def source_targets(sizes: DataFrame, max_copies: int = MAX_COPIES) -> DataFrame:
    """(key, source_size, target) from (key, source, size): one row per source.

    The target is min(max_copies * size, level * weight), with the level at which all targets
    sum to all sizes: sources in order of cap over weight are capped while the level that the
    others would then have is above. The windows run over one row per source.
    """
    by = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    rank = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    by = by.withColumn("weight", ((F.row_number().over(rank) - 1) % 3 + 1).cast("double"))
    by = by.withColumn("cap", (max_copies * F.col("source_size")).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "key")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(1))
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    by = by.withColumn("level", left / F.sum("weight").over(after))
    # the first source that its level does not cap sets the level for all after it; theirs are no higher
    by = by.withColumn("level", F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(everything))
    target = F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    return by.select("key", "source_size", target.alias("target"))


def numbered(rows: DataFrame) -> DataFrame:
    """Rows (id, source, key, size) from these with th, a hash of the text: each with ``row``, a number of its own."""
    same = rows.groupBy("id", "source", "key", "size", "th").agg(F.count("*").alias("n"))
    chunks = same.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {CHUNK}"))).alias("chunk"))
    last = F.least(F.col("n") - F.col("chunk") * CHUNK, F.lit(CHUNK)) - 1
    each = chunks.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("i"))
    return each.select("id", "source", "key", "size", F.xxhash64("id", "source", "th", F.col("chunk") * CHUNK + F.col("i")).alias("row"))


def draw(ident: Column, level: int) -> Column:
    """A number in [0, 1) that depends on the id, the seed and the level alone."""
    return F.shiftrightunsigned(F.xxhash64(ident, F.lit(SEED), F.lit(level)), 11) / F.lit(float(1 << 53))


def fold(rows: Column) -> Column:
    """Settles all documents of a block but one: an array of (row, p), p is 0 or 1 but for one at most.

    The state is the document still open and those settled; weights are sizes.
    """

    def let(value: Column, then) -> Column:
        """then(value), with the value worked out once."""
        return F.element_at(F.transform(F.array(value), then), 1)

    snap = lambda p: F.when(p < EPS, 0.0).when(p > 1 - EPS, 1.0).otherwise(p)

    def meet(state: Column, x: Column) -> Column:
        a = state["open"]
        wa, wx = a["size"].cast("double"), x["size"].cast("double")

        def moved(m: Column) -> Column:
            rise = x["u"] * (m["up"] + m["down"]) < m["down"]  # a rises with odds in proportion to what its fall would move
            return F.when(rise, m["up"]).otherwise(-m["down"])

        def ended(p: Column) -> Column:
            a_done = p["a"].isin(0.0, 1.0)
            na, nx = a.withField("p", p["a"]), x.withField("p", p["x"])
            return F.struct(F.when(a_done, nx).otherwise(na).alias("open"), F.array_append(state["done"], F.when(a_done, na).otherwise(nx)).alias("done"))

        limits = F.struct(F.least((1 - a["p"]) * wa, x["p"] * wx).alias("up"), F.least(a["p"] * wa, (1 - x["p"]) * wx).alias("down"))
        return let(let(limits, moved), lambda m: let(F.struct(snap(a["p"] + m / wa).alias("a"), snap(x["p"] - m / wx).alias("x")), ended))

    def step(state: Column, x: Column) -> Column:
        settled = state["open"]["p"].isin(0.0, 1.0)
        return F.when(settled, F.struct(x.alias("open"), F.array_append(state["done"], state["open"]).alias("done"))).otherwise(meet(state, x))

    start = F.struct(F.element_at(rows, 1).alias("open"), F.filter(rows, lambda _: F.lit(False)).alias("done"))
    return F.aggregate(F.slice(rows, F.lit(2), F.greatest(F.size(rows) - 1, F.lit(0))), start, step, lambda s: F.array_append(s["done"], s["open"]))


def close(done: DataFrame) -> DataFrame:
    """(key, d) with every p 0 or 1, from (key, d), the last block of each source: some ``BLOCK`` rows of a key.

    The fractional one goes to the nearer side; then that one or those two change sides, of all of
    the block, that bring the source nearest to its target, if any does.
    """
    by = done.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("d.size", "d.row", "d.p", "d"))).alias("xs"))
    p = lambda x: F.round(x["p"])
    over = F.aggregate("xs", F.lit(0.0), lambda s, x: s + (p(x) - x["p"]) * x["size"])
    # what changing sides adds to what is taken
    by = by.select("key", "xs", over.alias("over"), F.transform("xs", lambda x: (1 - 2 * p(x)) * x["size"]).alias("gains"))
    stay = F.array(F.struct(F.abs("over").alias("miss"), F.lit(0).alias("n"), F.lit(-1).alias("i"), F.lit(-1).alias("j")))

    def first(g: Column, i: Column) -> Column:
        pairs = F.transform(F.slice("gains", i + 1, F.size("gains")), lambda h, k: F.struct(F.abs(F.col("over") + g + F.when(k > 0, h).otherwise(0.0)).alias("miss"), F.when(k > 0, 2).otherwise(1).alias("n"), i.alias("i"), (i + k).alias("j")))
        return F.array_min(pairs)

    by = by.select("key", "xs", F.array_min(F.concat(stay, F.transform("gains", first))).alias("best"))
    turned = F.transform("xs", lambda x, k: x["d"].withField("p", F.when((k == F.col("best.i")) | (k == F.col("best.j")), 1 - p(x)).otherwise(p(x))))
    return by.select("key", F.explode(turned).alias("d"))


def mix(docs: DataFrame, ident: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """(id, size, source_size, target, copies, taken) for each row.

    Shuffles ids and sizes alone, never texts: twice over all rows, and once per level over a
    ``BLOCK``-th of the level before.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))
    rows = docs.select(F.col(ident).cast("long").alias("id"), F.col(source).alias("source"), key.alias("key"), size.alias("size"), F.xxhash64(F.col(text)).alias("th"))
    sizes = scratch.write(numbered(rows), "rows")
    targets = scratch.write(source_targets(sizes), "targets")
    share = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(share + EPS)
    part = F.greatest(share - whole, F.lit(0.0))
    rows = sizes.join(targets, "key").select("key", F.struct("id", "row", "size", "source_size", "target", whole.cast("long").alias("whole"), F.when((F.col("size") == 0) | (part < EPS), 0.0).otherwise(part).alias("p")).alias("d"))
    settled = [rows.where("d.p = 0").select("d")]
    open_rows = rows.where("d.p > 0")
    total, level = sizes.count(), 0
    while True:
        blocks = math.ceil(total / BLOCK)
        block = F.pmod(F.xxhash64("d.row", F.lit(SEED), F.lit(~level)), F.lit(max(blocks, 1)))
        one = F.struct(draw(F.col("d.row"), level).alias("u"), *(F.col(f"d.{c}").alias(c) for c in ROW))
        dealt = open_rows.select("key", block.alias("block"), one.alias("x")).groupBy("key", "block").agg(F.array_sort(F.collect_list("x")).alias("xs"))
        done = dealt.select("key", F.transform(fold(F.col("xs")), lambda d: F.struct(*(d[c].alias(c) for c in ROW))).alias("ds"))
        done = scratch.write(done.select("key", F.explode("ds").alias("d")), f"level-{level}")
        if blocks <= 1:
            settled.append(close(done).select("d"))
            break
        settled.append(done.where("d.p IN (0.0, 1.0)").select("d"))
        open_rows, total, level = done.where("d.p NOT IN (0.0, 1.0)"), blocks, level + 1
    out = settled[0]
    for more in settled[1:]:
        out = out.unionByName(more)
    copies = (F.col("d.whole") + F.col("d.p")).cast("long")
    return out.select("d.id", "d.size", "d.source_size", "d.target", copies.alias("copies"), (copies * F.col("d.size")).alias("taken"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what the mix takes of every document."""
    got = mix(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "copies")
