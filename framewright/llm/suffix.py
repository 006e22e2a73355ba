"""Operator 2: repeated byte strings, by external induced sorting of suffixes with common prefixes.

A byte is removed if a window of ``SPAN`` bytes covers it that also starts elsewhere, in this text
or another. No text or shard is ever sorted whole:

1. Every window has an anchor, chosen by the window's own bytes (``induce.anchors``), so equal
   windows have anchors of one hash at one place. Neighbouring windows of one anchor are a
   snippet. Anchors that occur once cannot repeat; where all snippets of an anchor are equal, all
   of their windows repeat. Both are settled by one aggregate over hashes.
2. Of the rest, each different snippet is fetched once, with its number of copies. Shards are
   ranges of anchors, sorted on disk by Spark's external sort (a merge of spilled runs through a
   priority queue), and streamed through memory some thousand snippets at a time.
3. In each, the suffixes at the anchors are sorted with their common prefixes, and all suffixes
   before them are induced from those, byte by byte (``induce.induce``).

An anchor with more than ``WIDE`` different snippets (a passage that a third of all documents share
has as many contexts) recurs: its windows are cut into parts by how far before the anchor they
start, and the windows of a part have a longer text in common (64 bytes, then 166, 192, 198 and the
whole 200), which is the anchor of the next level (``induce.parts``). A level's tuples are a table on disk:
the group, the piece, its copies, and the range of starts that gives its common prefix. On each
level pieces whose anchor occurs once are done, and so are those whose anchor has one context
alone; equal ones are counted as one; a group that is still wide goes on, others go to the
shards. So a level has ``FAN`` rows at most for each piece, a task never has more than ``WIDE`` rows of a
group, and copies never meet in one task: they are counted before the shuffle. Spans found on a
level are carried back up through its table. Snippets are told apart by two 64-bit hashes.

Defined results: null text is empty; texts shorter than ``SPAN`` lose nothing; repeated rows are
texts of their own, so they repeat each other; rows of one id and one text get one result each;
an empty table gives no rows; other columns are kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import induce
from .common import Scratch, column, table

#: Different snippets of a group beyond which it recurs; snippets in memory at a time.
WIDE, BATCH = 256, 4096


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A binary column's bytes end to end, and the values' ends."""
    column = column.cast(pa.binary())
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return data, (offsets[1:] - offsets[0]).astype(np.int64)


def snippets(texts: DataFrame) -> DataFrame:
    """(did, th, place, h, s) from (did, th, data): place packs the start, the size and the anchor's distance."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            did, th = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            flat, ends = _flat(batch.column(2))
            at = 0
            while at < len(ends):  # a few megabytes at a time
                from_byte = ends[at - 1] if at else 0
                to = max(at + 1, int(np.searchsorted(ends, from_byte + 8 * induce.BLOCK, side="right")))
                text, start, d, size, h, s = induce.anchors(flat[from_byte : ends[to - 1]], ends[at:to] - from_byte)
                place = start << 17 | size << 8 | d
                yield pa.RecordBatch.from_arrays([pa.array(did[at + text]), pa.array(th[at + text]), pa.array(place), pa.array(h), pa.array(s)], names=["did", "th", "place", "h", "s"])
                at = to

    return texts.mapInArrow(run, "did long, th long, place long, h long, s long")


def cut_up(wide: DataFrame) -> DataFrame:
    """A level of the recursion: from (h, s, n, d, size, low, high, data) rows (ph, ps, off, h, s, n, d, size, low, high, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            h, s, n, *shape = (batch.column(c).to_numpy() for c in ("h", "s", "n", "d", "size", "low", "high"))
            flat, ends = _flat(batch.column("data"))
            row, off, d, size, low, high, group, own = induce.parts(*(x.astype(np.int64) for x in shape), flat, ends)
            at = (ends - shape[1])[row] + off
            data = [flat[a : a + k].tobytes() for a, k in zip(at.tolist(), size.tolist(), strict=True)]
            small = [pa.array(x.astype(np.int32)) for x in (d, size, low, high)]
            yield pa.RecordBatch.from_arrays([pa.array(h[row]), pa.array(s[row]), pa.array(off.astype(np.int32)), pa.array(group), pa.array(own), pa.array(n[row]), *small, pa.array(data, pa.binary())], names=["ph", "ps", "off", "h", "s", "n", "d", "size", "low", "high", "data"])

    return wide.mapInArrow(run, "ph long, ps long, off int, h long, s long, n long, d int, size int, low int, high int, data binary")


def sort_shards(shards: DataFrame) -> DataFrame:
    """From (h, s, n, d, size, data), a group's rows together: the spans of a snippet that repeat, (h, s, begin, end)."""

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        get = lambda c: rows.column(c).combine_chunks()
        h, s, n, d, size = (get(c).to_numpy() for c in ("h", "s", "n", "d", "size"))
        group = np.cumsum(np.r_[True, h[1:] != h[:-1]])
        flat, ends = _flat(get("data"))
        row = np.repeat(np.arange(len(h)), size)
        place = np.arange(len(flat)) - (ends - size)[row] + (induce.REACH - d)[row]
        chars = np.zeros((2 * induce.SPAN - induce.GRAM, len(h)), np.uint8)
        chars[place, row] = flat
        marks = induce.induce(group, n, d.astype(np.int64), size.astype(np.int64), chars)
        edge = np.diff(np.pad(marks, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        (of, begin), (_, end) = np.nonzero(edge == 1), np.nonzero(edge == -1)
        yield pa.RecordBatch.from_arrays([pa.array(h[of]), pa.array(s[of]), pa.array(begin.astype(np.int32)), pa.array((end - 1 + induce.SPAN).astype(np.int32))], names=["h", "s", "begin", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        have = 0
        for batch in batches:
            held.append(batch)
            have += batch.num_rows
            if have < BATCH:
                continue
            rows = pa.Table.from_batches(held)
            h = rows.column("h").to_numpy()
            cuts = np.flatnonzero(h[1:] != h[:-1]) + 1
            at = 0
            while len(more := cuts[cuts >= at + BATCH]) or len(cuts) and cuts[-1] > at:  # up to the last group, which may go on
                cut = int(more[0]) if len(more) else int(cuts[-1])
                yield from compare(rows.slice(at, cut - at))
                at = cut
            held, have = rows.slice(at).to_batches(), rows.num_rows - at
        if have:
            yield from compare(pa.Table.from_batches(held))

    return shards.mapInArrow(run, "h long, s long, begin int, end int")


def recur(pieces: DataFrame, scratch: Scratch) -> DataFrame:
    """Spans (h, s, begin, end) of the pieces (h, s, n, d, size, data), all different and of mixed anchors."""
    shape = ["h", "s", "n", "d", "size", "data"]
    open_ = pieces.withColumns({"low": F.lit(0), "high": F.lit(induce.REACH)})
    levels: list[tuple[DataFrame, DataFrame]] = []
    narrow: list[DataFrame] = []
    while True:
        level = len(levels)
        different = open_.groupBy("h").agg(F.count("*").alias("different"))
        wide = scratch.write(different.where(F.col("different") > WIDE).select("h"), f"wide-{level}")
        if not wide.limit(1).count():
            narrow.append(open_.select(*shape))
            break
        narrow.append(scratch.write(open_.join(wide, "h", "left_anti").select(*shape), f"narrow-{level}"))
        cut = scratch.write(cut_up(open_.join(wide, "h", "left_semi").select("h", "s", "n", "d", "size", "low", "high", "data")), f"cut-{level}")
        seen = cut.groupBy("h").agg(F.sum("n").alias("all"), F.min("s").alias("first"), F.max("s").alias("last")).where(F.col("all") > 1)
        seen = scratch.write(seen.select("h", (F.col("first") != F.col("last")).alias("mixed")), f"seen-{level}")
        levels.append((cut.select("ph", "ps", "off", "h", "s", "size"), seen))
        mixed = cut.join(seen.where("mixed").select("h"), "h", "left_semi")
        open_ = scratch.write(mixed.groupBy("h", "s").agg(F.sum("n").alias("n"), *(F.first(c).alias(c) for c in ("d", "size", "data", "low", "high"))), f"open-{level}")
    shards = narrow[0]
    for more in narrow[1:]:
        shards = shards.unionByName(more)
    # the external sort: each task merges its runs on disk in order, and streams them
    found = scratch.write(sort_shards(shards.repartition("h").sortWithinPartitions("h", "s")), "found")
    up = found
    for cut, seen in reversed(levels):
        lifted = up.join(cut, ["h", "s"]).select(F.col("ph").alias("h"), F.col("ps").alias("s"), (F.col("begin") + F.col("off")).alias("begin"), (F.col("end") + F.col("off")).alias("end"))
        every = cut.join(seen.where("NOT mixed").select("h"), "h", "left_semi").select(F.col("ph").alias("h"), F.col("ps").alias("s"), F.col("off").alias("begin"), (F.col("off") + F.col("size")).alias("end"))
        up = scratch.write(lifted.union(every).union(found).distinct(), f"up-{level}")
        level -= 1
    return up


def repeated_spans(texts: DataFrame, scratch: Scratch) -> DataFrame:
    """(did, th, spans): for each text with repeats, the byte spans (start << 32 | end) that repeat, as found."""
    # anchors are found twice rather than kept: they are more than the texts' own size
    seen = snippets(texts).select("h", "s").groupBy("h").agg(F.count("*").alias("n"), F.min("s").alias("low"), F.max("s").alias("high"))
    often = scratch.write(seen.where("n > 1").select("h", (F.col("low") != F.col("high")).alias("mixed")), "often")
    placed = scratch.write(snippets(texts).join(often, "h"), "placed")
    scratch.drop("often")
    mixed = placed.where("mixed")
    one = scratch.write(mixed.groupBy("h", "s").agg(F.count("*").alias("n"), F.first("did").alias("did"), F.first("th").alias("th"), F.first("place").alias("place")), "one")

    wanted = one.groupBy("did", "th").agg(F.collect_list(F.struct("h", "s", "n", "place")).alias("wanted"))
    start, size, d = F.shiftright("w.place", 17), F.shiftright("w.place", 8).bitwiseAND(511), F.col("w.place").bitwiseAND(255)
    # rows of one id and one text give the same bytes: they meet before the shuffle, so copies of a row never do in a task
    whole = texts.groupBy("did", "th").agg(F.first("data").alias("data"))
    fetched = whole.join(wanted, ["did", "th"]).select("data", F.explode("wanted").alias("w"))
    fetched = fetched.select("w.h", "w.s", "w.n", d.cast("int").alias("d"), size.cast("int").alias("size"), F.substring("data", (start + 1).cast("int"), size.cast("int")).alias("data"))
    pieces = scratch.write(fetched, "pieces")
    scratch.drop("one")
    spans = recur(pieces, scratch)

    span = lambda low, high: F.shiftleft((F.shiftright("place", 17) + low).cast("long"), 32) + F.shiftright("place", 17) + high
    some = mixed.select("did", "th", "place", "h", "s").join(spans, ["h", "s"]).select("did", "th", span(F.col("begin"), F.col("end")).alias("span"))
    every = placed.where("NOT mixed").select("did", "th", span(F.lit(0), F.shiftright("place", 8).bitwiseAND(511)).alias("span"))
    # a set: copies of a row have the same spans, which meet before the shuffle
    out = scratch.write(some.union(every).groupBy("did", "th").agg(F.collect_set("span").alias("spans")), "spans")
    scratch.drop_but("spans")
    return out


def whole_characters(piece: memoryview, head: bool, tail: bool) -> memoryview:
    """A piece of UTF-8 without what is left of the characters cut at its head and tail."""
    low, high = 0, len(piece)
    while head and low < min(high, 3) and piece[low] & 0xC0 == 0x80:
        low += 1
    for k in range(1, min(4, high - low + 1) if tail else 1):
        byte = piece[high - k] & 0xFF  # Arrow buffers are of signed bytes
        if byte & 0xC0 != 0x80:
            if k < (byte >= 0xC0) + (byte >= 0xE0) + (byte >= 0xF0) + 1:
                high -= k
            break
    return piece[low:high]


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text", keep: list[str] | None = None, whole: bool = False) -> DataFrame:
    """The columns in ``keep`` (all) with n_bytes, n_removed, n_spans and kept, the bytes that are left.

    With ``whole`` kept has no parts of characters that a removed span has cut.
    """
    scratch = Scratch(docs.sparkSession, "suffix")
    did = F.coalesce(column(ident).cast("long"), F.lit(0))
    th = F.xxhash64(column(ident).isNull(), column(text))
    data = F.coalesce(column(text), F.lit("")).cast("binary")
    spans = repeated_spans(docs.select(did.alias("did"), th.alias("th"), data.alias("data")), scratch)
    own = [c for c in (keep if keep is not None else docs.columns) if c not in ("n_bytes", "n_removed", "n_spans", "kept")]
    rows = docs.select(did.alias("did"), th.alias("th"), F.struct(*map(column, own)).alias("own"), data.alias("data"))
    both = rows.join(spans, ["did", "th"], "left").select("own", "data", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, runs, kept = [], [], [], []
            for value, found in zip(batch.column(1), batch.column(2), strict=True):
                value = value.as_buffer()
                left, gone, n, at = [], 0, 0, 0
                if found.is_valid:
                    spans = np.sort(found.values.to_numpy())
                    low, high = spans >> 32, np.maximum.accumulate(spans & 0xFFFFFFFF)
                    new = np.flatnonzero(np.r_[True, low[1:] > high[:-1]])
                    view = memoryview(value)
                    for a, b in zip(low[new].tolist(), high[np.r_[new[1:], len(high)] - 1].tolist(), strict=True):
                        left.append(whole_characters(view[at:a], at > 0, True) if whole else view[at:a])
                        gone, n, at = gone + b - a, n + 1, b
                    left.append(whole_characters(view[at:], at > 0, False) if whole else view[at:])
                    kept.append(b"".join(left))
                else:
                    kept.append(value.to_pybytes())
                sizes.append(value.size)
                removed.append(gone)
                runs.append(n)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, removed, runs)), pa.array(kept, pa.binary())], names=["own", "n_bytes", "n_removed", "n_spans", "kept"])

    counts = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")]
    schema = T.StructType([T.StructField("own", rows.schema["own"].dataType), *counts, T.StructField("kept", T.BinaryType())])
    return both.mapInArrow(run, schema).select("own.*", "n_bytes", "n_removed", "n_spans", "kept")


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: what is left of every document."""
    got = remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


OP2_SQL = """
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS MATERIALIZED (
  SELECT rid, i, md5_number(b[i + 1:i + 200]) AS m FROM (SELECT rid, b, unnest(range(octet_length(b) - 199)) AS i FROM d WHERE octet_length(b) >= 200)
), r AS (
  SELECT rid, i FROM w JOIN (SELECT m FROM w GROUP BY m HAVING count(*) > 1) USING (m)
), g AS (
  SELECT rid, i, CASE WHEN i - lag(i) OVER (PARTITION BY rid ORDER BY i) <= 200 THEN 0 ELSE 1 END AS new FROM r
), s AS (
  SELECT rid, min(i) AS a, max(i) + 200 AS z FROM (SELECT rid, i, sum(new) OVER (PARTITION BY rid ORDER BY i) AS n FROM g) GROUP BY rid, n
), k AS (
  SELECT rid, a, z, coalesce(lag(z) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM s
), p AS (
  SELECT rid, count(*) AS n_spans, CAST(sum(z - a) AS BIGINT) AS n_removed, string_agg(hex(b[before + 1:a]), '' ORDER BY a) AS head, max(z) AS last FROM k JOIN d USING (rid) GROUP BY rid
)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(CASE WHEN last IS NULL THEN b ELSE from_hex(head || hex(b[last + 1:octet_length(b)])) END) AS kept_sha256
FROM d LEFT JOIN p USING (rid)
"""
