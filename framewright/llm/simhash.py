"""Operator 3: SimHash near-duplicates through deletion-variant signatures.

Fingerprints: 64 bits of the XXH64 values of all word shingles, by majority.

Links at ``MAX_BITS`` = 2 or fewer differing bits: a fingerprint is cut into two segments of 32
bits. Of two linked fingerprints, one segment differs by one bit at most, so with some bit of it
wildcarded the segments are equal. Every distinct fingerprint is indexed under the 2 x 32
one-wildcard variants of its segments; an equality join on the variant brings candidates
together, and each is verified on all 64 bits.

No pairs are made within a variant's group. A group of two is one candidate pair, taken from the
aggregate itself. In larger groups of a wildcard, only members on the two sides of its bit are new to
each other, and their other segments differ by one bit or none: the smaller side goes on with its 33
one-flip forms, and an equality join meets the other side. Members with a whole segment in common
(an index entry of its own) go on with their 33 one-flip forms on both sides; two members share a
form exactly if they differ by two bits or fewer, and each form gives a star around its smallest
member. So the rows are 33 per member of a group, however large, and no link is lost.

Defined results: null and empty texts, and texts of no words, have fingerprint zero and are
linked like any other; fewer words than a shingle give one shingle of all; equal fingerprints
are linked; repeated rows and ids stay rows of their own; an empty table gives no rows. A null
id is kept, but names no component unless no other id is reachable.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .components import connected_components

SEED, SHINGLE, MAX_BITS = 42, 3, 2
#: Shingles whose bits are counted at a time, for a bound on memory with very long texts.
BLOCK = 65_536
#: Variants with a larger group are sent to all tasks up to this many, about 16 MB.
BROADCAST_KEYS = 1_000_000


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """The fingerprint of one whole text, as an unsigned number."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z, and exactly the six separators
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = (ends - np.fromiter(map(len, words), np.int64, len(words)) - 1).tolist()
    stops = (ends - 1).tolist()[size - 1 :]
    n, ones, digest = len(stops), np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, BLOCK):
        hashes = [digest(joined[a:b], SEED) for a, b in zip(starts[at : at + BLOCK], stops[at : at + BLOCK], strict=False)]
        bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def with_fingerprint(docs: DataFrame, ident: str, text: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp) and the columns in ``keep``: fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x.as_py()) for x in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64)), *batch.columns[2:]], names=["id", "fp", *keep])

    return docs.select(F.col(ident).cast("long").alias("id"), F.col(text).alias("text"), *keep).mapInArrow(run, ", ".join(["id long, fp long", *(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)]))


def _bit(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def variants(fp: Column) -> Column:
    """(bit, rest): the 64 one-wildcard variants of the two segments, and both segments whole (bit 64 and 65)."""
    low, high = fp.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(fp, 32)
    without = lambda segment, bit: segment.bitwiseAND(F.bitwise_not(_bit(bit)))
    bits = F.sequence(F.lit(0), F.lit(31))
    one = F.transform(bits, lambda b: F.struct(b.alias("bit"), without(low, b).alias("rest")))
    two = F.transform(bits, lambda b: F.struct((b + 32).alias("bit"), without(high, b).alias("rest")))
    return F.concat(one, two, F.array(F.struct(F.lit(64).alias("bit"), low.alias("rest")), F.struct(F.lit(65).alias("bit"), high.alias("rest"))))


def side(fp: Column, bit: Column) -> Column:
    """The bit that a variant leaves out; null for a whole segment."""
    return F.when(bit < 64, F.call_function("shiftright", fp, bit).bitwiseAND(F.lit(1).cast("long")))


def near_other(fp: Column, bit: Column) -> Column:
    """The fingerprint, and it with each bit of the segment that the variant is not of flipped."""
    low = (bit < 32) | (bit == 64)
    other = F.when(low, F.sequence(F.lit(32), F.lit(63))).otherwise(F.sequence(F.lit(0), F.lit(31)))
    return F.concat(F.array(fp), F.transform(other, lambda b: fp.bitwiseXOR(_bit(b))))


def links(fps: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (fp) that connect all linked ones."""
    spread_out = fps.repartition(int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")  # a small table makes many rows here
    index = lambda: spread_out.select("fp", F.explode(variants(F.col("fp"))).alias("v")).select("v.bit", "v.rest", "fp")
    own = side(F.col("fp"), F.col("bit"))
    groups = index().groupBy("bit", "rest").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b"), F.sum(own).alias("ones"))
    # in a wildcard's group only the two sides of the bit are new to each other: equal segments meet whole
    groups = scratch.write(groups.where("n > 1 AND (bit >= 64 OR ones BETWEEN 1 AND n - 1)"), "groups")
    near = lambda x, y: F.bit_count(F.col(x).bitwiseXOR(F.col(y))) <= MAX_BITS
    pairs = groups.where("n = 2").where(near("a", "b")).select("a", "b")
    shared = groups.where("n > 2").select("bit", "rest", F.when(2 * F.col("ones") <= F.col("n"), 1).otherwise(0).alias("few"))
    if shared.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS:
        shared = F.broadcast(shared)  # else Spark sorts both sides: the index is shuffled a second time
    large = scratch.write(index().join(shared, ["bit", "rest"]).select("bit", "fp", (own == F.col("few")).alias("few")), "large")

    # a segment in common: the others differ by two bits or fewer exactly if one flip each can make them equal
    middles = large.where("bit >= 64").select("bit", "fp", F.explode(near_other(F.col("fp"), F.col("bit"))).alias("mid"))
    hubs = middles.groupBy("bit", "mid").agg(F.min("fp").alias("hub"), F.max("fp").alias("far")).where("hub <> far")
    hubs = scratch.write(hubs.select("bit", "mid", "hub"), "hubs")
    stars = middles.join(hubs, ["bit", "mid"]).where("fp <> hub").select(F.col("fp").alias("a"), F.col("hub").alias("b"))

    # segments one bit apart: the others differ by one bit or none, so the side of fewer, turned over, meets the other by a flip
    turned = F.col("fp").bitwiseXOR(_bit(F.col("bit")))
    flips = large.where("few").select("bit", F.col("fp").alias("a"), F.explode(near_other(turned, F.col("bit"))).alias("b"))
    across = flips.join(large.where("NOT few").select("bit", F.col("fp").alias("b")), ["bit", "b"])
    found = stars.union(across.select("a", "b")).where(near("a", "b"))
    return scratch.write(pairs.union(found).distinct(), "links")


def simhash_groups(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(id, fp, component) for each row: component is the smallest id reachable by links.

    With ``keep`` also part, a fingerprint that tells groups apart whatever their ids, and those columns.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.write(with_fingerprint(docs, ident, text, keep), "rows")
    # equal fingerprints count once from here on
    fps = scratch.write(rows.groupBy("fp").agg(F.min("id").alias("least")), "fps")
    parts = connected_components(links(fps.select("fp"), scratch), scratch)
    sets = scratch.write(fps.join(parts.withColumnRenamed("vertex", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("part"), "least"), "sets")
    named = scratch.write(sets.groupBy("part").agg(F.min("least").alias("component")), "named")
    classes = scratch.write(sets.join(named, "part").select("fp", "component", *(["part"] if keep else [])), "classes")
    for name in ("groups", "large", "hubs", "links", "sets", "named", "fps"):
        scratch.drop(name)
    return rows.join(classes, "fp").select("id", "fp", "component", *(["part", *keep] if keep else []))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: fingerprint and component of every document."""
    got = simhash_groups(table(spark, sf_dir, "documents"))
    return got.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


# Fixed values of XXH64: its five primes.
PRIMES = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)


def op3_sql(shingle: int = SHINGLE, seed: int = SEED, bits: int = MAX_BITS) -> str:
    """DuckDB SQL for the query: XXH64 in 128-bit numbers, all pairs of fingerprints, and what is reachable."""
    p1, p2, p3, p4, p5 = (f"{p}::UHUGEINT" for p in PRIMES)
    mask = f"{(1 << 64) - 1}::UHUGEINT"
    mul = lambda a, b: f"((({a}) * ({b})) & {mask})"
    add = lambda *x: f"(({' + '.join(x)}) & {mask})"
    turn = lambda x, r: f"((({x}) * {1 << r}::UHUGEINT & {mask}) + ({x}) // {1 << (64 - r)}::UHUGEINT)"
    mixed = lambda x: mul(turn(mul(x, p2), 31), p1)
    number = lambda size, at: "CAST('0x' || " + " || ".join(f"substr(h, CAST(2 * ({at}) + {2 * k + 1} AS BIGINT), 2)" for k in range(size - 1, -1, -1)) + " AS UBIGINT)::UHUGEINT"
    seeds = ((seed + PRIMES[0] + PRIMES[1]) % (1 << 64), (seed + PRIMES[1]) % (1 << 64), seed, (seed - PRIMES[0]) % (1 << 64))
    start = "{" + ", ".join(f"'{c}': {v}::UHUGEINT" for c, v in zip("abcd", seeds, strict=True)) + "}"
    stripe = "{" + ", ".join(f"'{c}': {mul(f'lanes[CAST(4 * k + {i} AS BIGINT)]', p2)}" for i, c in enumerate("abcd", 1)) + "}"
    one = "{" + ", ".join(f"'{c}': {mul(turn(add(f's.{c}', f'x.{c}'), 31), p1)}" for c in "abcd") + "}"
    joined = add(*(turn(f"acc.{c}", r) for c, r in zip("abcd", (1, 7, 12, 18), strict=True)))
    capital = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    counts = ", ".join(f"CAST(sum(CAST(x >> {k} & 1::UHUGEINT AS INTEGER)) AS BIGINT) AS b{k}" for k in range(64))
    print_bits = " + ".join(f"CASE WHEN 2 * b{k} > n THEN {1 << k}::UHUGEINT ELSE 0::UHUGEINT END" for k in range(64))
    return f"""
WITH RECURSIVE d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{capital}', '{capital.lower()}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), g AS MATERIALIZED (
  SELECT rid, array_to_string(w[i:i + {shingle - 1}], ' ') AS t FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - {shingle - 1}, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), h0 AS MATERIALIZED (SELECT t, hex(encode(t)) AS h, CAST(octet_length(encode(t)) AS BIGINT) AS n FROM (SELECT DISTINCT t FROM g)),
h1 AS (SELECT *, list_transform(range(n // 8), lambda k: {number(8, "8 * k")}) AS lanes FROM h0),
h2 AS (SELECT *, list_transform(range(n // 32), lambda k: {stripe}) AS stripes FROM h1),
h3 AS (SELECT *, list_reduce(list_prepend({start}, stripes), lambda s, x: {one}) AS acc FROM h2),
h4 AS (SELECT t, h, n, list_transform(lanes[4 * (n // 32) + 1:], lambda x: {mixed("x")}) AS rest,
  {add(f"CASE WHEN n < 32 THEN {(seed + PRIMES[4]) % (1 << 64)}::UHUGEINT ELSE list_reduce([{joined}, {', '.join(mixed(f'acc.{c}') for c in 'abcd')}], lambda s, x: {add(mul('xor(s, x)', p1), p4)}) END", "n::UHUGEINT")} AS v FROM h3),
h5 AS (SELECT t, h, n, list_reduce(list_prepend(v, rest), lambda s, x: {add(mul(turn("xor(s, x)", 27), p1), p4)}) AS v FROM h4),
h6 AS (SELECT t, h, n, CASE WHEN n % 8 >= 4 THEN xor(v, {mul(number(4, "n // 8 * 8"), p1)}) END AS y, v FROM h5),
h7 AS (SELECT t, CASE WHEN y IS NULL THEN v ELSE {add(mul(turn("y", 23), p2), p3)} END AS v, list_transform(range(n // 4 * 4, n), lambda k: {mul(number(1, "k"), p5)}) AS rest FROM h6),
h8 AS (SELECT t, list_reduce(list_prepend(v, rest), lambda s, x: {mul(turn("xor(s, x)", 11), p1)}) AS v FROM h7),
h9 AS (SELECT t, {mul("xor(v, v >> 33)", p2)} AS v FROM h8),
h10 AS (SELECT t, {mul("xor(v, v >> 29)", p3)} AS v FROM h9),
hashed AS MATERIALIZED (SELECT t, xor(v, v >> 32) AS x FROM h10),
c AS (SELECT rid, count(*) AS n, {counts} FROM g JOIN hashed USING (t) GROUP BY rid),
f AS MATERIALIZED (SELECT rid, doc_id, CAST(coalesce({print_bits}, 0::UHUGEINT) AS UBIGINT) AS fp FROM d LEFT JOIN c USING (rid)),
fps AS MATERIALIZED (SELECT fp, min(doc_id) AS least FROM f GROUP BY fp),
pairs AS MATERIALIZED (SELECT a.fp AS a, b.fp AS b FROM fps a JOIN fps b ON a.fp <> b.fp AND bit_count(xor(a.fp, b.fp)) <= {bits}),
reach AS (SELECT fp, fp AS other FROM fps UNION SELECT reach.fp, b FROM reach JOIN pairs ON other = a),
part AS (SELECT reach.fp, min(least) AS component_id FROM reach JOIN fps ON other = fps.fp GROUP BY reach.fp)
SELECT doc_id, lower(lpad(hex(fp), 16, '0')) AS fingerprint, component_id FROM f JOIN part USING (fp)
"""


OP3_SQL = op3_sql()
