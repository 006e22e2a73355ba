"""Operator 10: near-duplicate vectors by a pivot-permutation index.

Reference points (pivots) are vectors of the table, drawn by a hash; one that has a cosine of
``APART`` or more with an earlier one is passed over, so a dense group holds one pivot however
many vectors it has, and not its share of them.

A vector within ``CORE`` of its nearest pivot is in that pivot's region, and all its links are found
exactly: whatever is linked to it is at most the link's angle farther from the pivot, so every
vector that near visits the region's list, and the list compares its own vectors with each other
and with all visitors. Of two regions the one of the smaller pivot has the visitor.

Vectors in no region are described by their nearest pivots in order. Inverted lists stand under
pairs of pivots: a vector is in the list of every pair among its ``NEAREST`` nearest, so two vectors
meet in a list exactly if they share two pivots or more, and the number they share is counted
from their descriptions. Those that share ``MIN_SHARED`` are verified by cosine in double precision;
a pair is verified in the list of its two first shared pivots alone, so it counts once.

Equal vectors of a label are one vector with a multiplicity from the start. A list longer than
``LIST_ROWS`` (a region's than ``REGION_ROWS``) is dealt into blocks, and each pair of blocks is a
task's group of its own, so no list is capped and none lands in one task. A group gives a row per
vector (how many it is linked to, and one of its component within the group), not a row per pair.

Links are within a label, over vectors of as many components. Vectors that are null, empty, zero
or hold a null or non-finite component, and rows without a label, link with nothing. Repeated
rows and ids are vectors of their own: a class of equal vectors has a number of its own, and ids
only name the components in the end. A null id links like any other, but names no component: one
without another id has the component null. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, table
from .components import connected_components

THRESHOLD = 0.93
NEAREST, MIN_SHARED = 8, 2
#: Pivots for this many different vectors; their number grows as the root of the vectors', so lists do not.
PIVOTS, PIVOTS_FOR, MOST_PIVOTS = 128, 10_000, 4096
LIST_ROWS = 1024
#: Pivots have a smaller cosine than this with each other, and are found among this many times their number.
APART, CANDIDATES = 0.5, 4
#: Cosine with its pivot from which a vector is in a region, and rows of a region compared in one group.
CORE, REGION_ROWS = 3**0.5 / 2, 8192
#: In place of a pivot where there are fewer than ``NEAREST``.
FAR = np.iinfo(np.int32).max
#: Rows of a region multiplied with all others at a time.
STRIP = 256
#: Rows compared at a time within a task; groups of more rows than ``SMALL`` are each one product of matrices.
BATCH, SMALL = 16_384, 16


def usable(vector: Column, label: Column) -> Column:
    """Whether a vector can link."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return label.isNotNull() & vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(True)) & F.exists(vector, lambda x: x != 0)


def unit(rows: np.ndarray) -> np.ndarray:
    scale = np.abs(rows).max(axis=1, keepdims=True)  # first to 1 at most: no square over- or underflows
    rows = rows / np.where(scale > 0, scale, 1)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def net(candidates: list[np.ndarray], most: int) -> list[np.ndarray]:
    """Of the candidates in order, up to ``most`` that are apart from all before them; those of a length are compared."""
    chosen, units, count = [], {}, {}
    for c in candidates:
        if len(chosen) == most:
            break
        x, d = unit(c[None])[0], len(c)
        have, k = units.setdefault(d, np.empty((16, d))), count.get(d, 0)
        if k and (have[:k] @ x).max() >= APART:
            continue
        if k == len(have):
            have = units[d] = np.concatenate([have, np.empty_like(have)])
        have[k], count[d] = x, k + 1
        chosen.append(c)
    return chosen


def describe(classes: DataFrame, pivots: list[np.ndarray], threshold: float) -> DataFrame:
    """(label, rep, n, dim, vec, near, home, keys).

    vec holds the unit vector's doubles, near its nearest pivots in order; home is the pivot of its
    region or -1; keys are its lists, a region's has the pivot twice.
    """
    of = {d: i for d in sorted({len(p) for p in pivots}) if len(i := [k for k, p in enumerate(pivots) if len(p) == d])}
    sent = classes.sparkSession.sparkContext.broadcast({d: (np.array(i), unit(np.stack([pivots[k] for k in i]))) for d, i in of.items()})
    # no nearer than this to the pivot, a vector is linked to none of the region
    visit = np.cos(min(np.pi, np.arccos(CORE) + np.arccos(np.clip(threshold, -1, 1)))) - 1e-9

    pairs = np.array(list(combinations(range(NEAREST), 2))).T

    def some(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
        """near, home and (row, key) of unit vectors of a length."""
        ids, points = sent.value.get(x.shape[1], (np.zeros(0, np.int64), np.zeros((0, x.shape[1]))))
        sims = x @ points.T
        k = min(NEAREST, len(ids))
        near = np.full((len(x), NEAREST), FAR, np.int64)
        home = np.full(len(x), -1, np.int64)
        if k:
            first = np.argpartition(-sims, k - 1, axis=1)[:, :k]
            first = np.take_along_axis(first, np.lexsort((first, -np.take_along_axis(sims, first, axis=1))), axis=1)
            home = np.where(np.take_along_axis(sims, first[:, :1], axis=1)[:, 0] >= CORE, ids[first[:, 0]], -1)
            near[:, :k] = ids[first]
        if k < 2:  # of vectors of a length with one pivot or none, those in no region stand in one list
            near[:, :2] = 0, 1
        row, p = np.nonzero(sims >= visit)
        mine = (home[row] < 0) | (ids[p] <= home[row])
        row, key = row[mine], ids[p[mine]] * (MOST_PIVOTS + 1)
        out = np.flatnonzero(home < 0)
        one, two = near[out][:, pairs[0]], near[out][:, pairs[1]]
        of, which = np.nonzero(np.maximum(one, two) < FAR)
        both = np.minimum(one, two)[of, which] * MOST_PIVOTS + np.maximum(one, two)[of, which]
        return near, home, (np.r_[row, out[of]], np.r_[key, both])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                column = batch.column(3)
                dims = np.diff(offsets := column.offsets.to_numpy())
                flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
                n = len(dims)
                near, home, vecs, row, key = np.full((n, NEAREST), FAR, np.int32), np.zeros(n, np.int32), [b""] * n, [], []
                for d in np.unique(dims):
                    own = np.flatnonzero(dims == d)
                    x = unit(flat[offsets[own][:, None] + np.arange(d)])
                    near[own], home[own], (r, k) = some(x)
                    row.append(own[r])
                    key.append(k)
                    for i, v in zip(own.tolist(), x, strict=True):
                        vecs[i] = v.tobytes()
                row, key = np.concatenate(row), np.concatenate(key)
                order = np.argsort(row, kind="stable")
                keys = pa.ListArray.from_arrays(pa.array(np.searchsorted(row[order], np.arange(n + 1)), pa.int32()), pa.array(key[order], pa.int64()))
                columns = [pa.array(dims, pa.int32()), pa.array(vecs, pa.binary()), pa.array([v.tobytes() for v in near], pa.binary()), pa.array(home), keys]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), *columns], names=["label", "rep", "n", "dim", "vec", "near", "home", "keys"])

    return classes.mapInArrow(run, "label string, rep long, n long, dim int, vec binary, near binary, home int, keys array<long>")


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component labels of the links (a, b) among n vectors."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def pivot_count(vectors: int) -> int:
    return int(min(MOST_PIVOTS, max(PIVOTS, PIVOTS * (vectors / PIVOTS_FOR) ** 0.5)))


def verify(group: np.ndarray, key: np.ndarray, block: np.ndarray, cross: np.ndarray, near: np.ndarray, vecs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Linked pairs (i, j) of rows within groups; rows of a group are neighbours.

    cross: the group holds two blocks, and only pairs of both are its own.
    """
    size = np.bincount(group)
    few = size[group] <= SMALL
    found_a, found_b = [], []
    for step in range(1, int(size[size <= SMALL].max(initial=0))):
        i = np.flatnonzero(few[step:] & (group[step:] == group[:-step]) & ((block[step:] != block[:-step]) | ~cross[step:]))
        if len(i):
            ok = np.einsum("ij,ij->i", vecs[i], vecs[i + step]) >= threshold
            found_a.append(i[ok])
            found_b.append(i[ok] + step)
    first = np.cumsum(size) - size
    for g in np.flatnonzero(size > SMALL):
        rows = slice(first[g], first[g] + size[g])
        linked = np.triu(vecs[rows] @ vecs[rows].T >= threshold, 1)
        if cross[rows.start]:
            linked &= block[rows][:, None] != block[rows]
        a, b = np.nonzero(linked)
        found_a.append(a + rows.start)
        found_b.append(b + rows.start)
    none = [np.zeros(0, np.int64)]
    i, j = np.concatenate(found_a or none), np.concatenate(found_b or none)
    own = np.zeros(len(i), bool)
    for at in range(0, len(i), BATCH):
        a, b = near[i[at : at + BATCH]], near[j[at : at + BATCH]]
        shared = np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, FAR)
        shared.sort(axis=1)
        own[at : at + BATCH] = ((shared < MOST_PIVOTS).sum(axis=1) >= MIN_SHARED) & (shared[:, 0].astype(np.int64) * MOST_PIVOTS + shared[:, 1] == key[i[at : at + BATCH]])
    return i[own], j[own]


def verify_region(core: np.ndarray, block: np.ndarray, cross: bool, n: np.ndarray, vecs: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(hits, root) of the rows of one region's group: pairs of which one at least is of the region."""
    hits, root = np.zeros(len(n), np.int64), np.arange(len(n))
    for at in range(0, len(n), STRIP):
        i = np.arange(at, min(at + STRIP, len(n)))
        linked = (vecs[i] @ vecs.T >= threshold) & (core[i][:, None] | core)
        if cross:
            linked &= block[i][:, None] != block
        linked[np.arange(len(i)), i] = False
        hits[i] = linked @ n
        a, b = np.nonzero(linked)
        a, b = root[i[a]], root[b]
        new = a != b
        if new.any():
            root = roots(len(n), a[new], b[new])[root]
    return hits, root


def search(lists: DataFrame, threshold: float) -> DataFrame:
    """(rep, hits, root) from groups: how many vectors each is linked to, and a vector it is connected with."""

    def compare(rows: pa.Table) -> pa.RecordBatch:
        get = lambda c: rows.column(c).combine_chunks()
        mark = np.stack([get(c).to_numpy() for c in ("key", "one", "two", "dim")], axis=1)
        label = get("label").dictionary_encode().indices.to_numpy()
        new = np.r_[True, (mark[1:] != mark[:-1]).any(axis=1) | (label[1:] != label[:-1])]
        group, rep, n = np.cumsum(new) - 1, get("rep").to_numpy(), get("n").to_numpy()
        near = np.frombuffer(b"".join(get("near").to_pylist()), np.int32).reshape(-1, NEAREST)
        hits, root = np.zeros(len(rep), np.int64), np.arange(len(rep))
        home, block, cross = get("home").to_numpy(), get("block").to_numpy(), mark[:, 1] != mark[:, 2]
        region = mark[:, 0] % (MOST_PIVOTS + 1) == 0
        read = lambda at: np.frombuffer(b"".join(get("vec").take(pa.array(at)).to_pylist()), np.float64).reshape(len(at), -1)
        for first, last in zip(starts := np.flatnonzero(new), np.r_[starts[1:], len(rep)], strict=True):
            core = home[first:last] == mark[first, 0] // (MOST_PIVOTS + 1)
            if region[first] and last - first > 1 and core.any():
                at = np.arange(first, last)
                hits[at], found = verify_region(core, block[at], cross[first], n[at], read(at), threshold)
                root[at] = at[found]
        for dim in np.unique(mark[~region, 3]):
            at = np.flatnonzero(~region & (mark[:, 3] == dim))
            vecs = read(at)
            a, b = verify(np.unique(group[at], return_inverse=True)[1], mark[at, 0], block[at], cross[at], near[at], vecs, threshold)
            np.add.at(hits, at[a], n[at[b]])
            np.add.at(hits, at[b], n[at[a]])
            root[at] = at[roots(len(at), a, b)]
        some = np.flatnonzero(hits)
        return pa.RecordBatch.from_arrays([pa.array(rep[some]), pa.array(hits[some]), pa.array(rep[root[some]])], names=["rep", "hits", "root"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) < BATCH:
                continue
            rows = pa.Table.from_batches(held)
            get = lambda c: rows.column(c).combine_chunks()
            columns = [get(c).to_numpy() for c in ("key", "one", "two", "dim")] + [get("label").dictionary_encode().indices.to_numpy()]
            new = np.flatnonzero(np.logical_or.reduce([c[1:] != c[:-1] for c in columns]))
            at = int(new[-1]) + 1 if len(new) else 0  # the last group may go on
            if at:
                yield compare(rows.slice(0, at))
            held = rows.slice(at).to_batches()
        if held and sum(b.num_rows for b in held):
            yield compare(pa.Table.from_batches(held))

    return lists.mapInArrow(run, "rep long, hits long, root long")


def near_vectors(vectors: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """(id, n_links, component) for each row.

    The pivots' candidates, at most ``CANDIDATES`` times ``MOST_PIVOTS``, are the one thing that is collected, and
    the pivots the one that is broadcast.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    rows = vectors.select(F.col(ident).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.col(vector).cast("array<double>").alias("vec"))
    good = rows.where(usable(F.col("vec"), F.col("label")))
    # negative zero and zero are one value, as in a comparison; a class is numbered once, as it is written
    classes = good.groupBy("label", "vec").agg(F.min("id").alias("least"), F.count("*").alias("n"))
    classes = scratch.write(classes.withColumn("rep", F.monotonically_increasing_id()), "classes")
    chosen = classes.select("vec", F.xxhash64("vec").alias("h"), "label").orderBy("h", "vec", "label").limit(CANDIDATES * (most := pivot_count(classes.count()))).collect()
    pivots = net([np.array(r["vec"], dtype=np.float64) for r in chosen], most)
    described = scratch.write(describe(classes.select("label", "rep", "n", "vec"), pivots, threshold), "described")

    keyed = described.select("*", F.explode("keys").alias("key")).drop("keys")
    count = keyed.groupBy("label", "dim", "key").agg(F.count("*").alias("rows"))
    most = F.when(F.col("key") % (MOST_PIVOTS + 1) == 0, REGION_ROWS).otherwise(LIST_ROWS)
    long_lists = scratch.write(count.where(F.col("rows") > most), "long")
    blocks = F.ceil(F.coalesce("rows", F.lit(1)) / F.floor(most / 2)).cast("int")
    keyed = keyed.join(long_lists, ["label", "dim", "key"], "left").withColumn("blocks", F.when(F.col("rows").isNull(), 1).otherwise(blocks)).drop("rows")
    keyed = keyed.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    both = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("x")
    dealt = keyed.select("*", both).withColumns({"one": F.least("block", "x"), "two": F.greatest("block", "x")})
    group = ["label", "dim", "key", "one", "two"]
    lists = dealt.select("label", "key", "one", "two", "dim", "block", "rep", "n", "vec", "near", "home").repartition(*group).sortWithinPartitions(*group, "rep")
    found = scratch.write(search(lists, threshold), "found")
    parts = connected_components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")).distinct(), scratch).withColumnRenamed("vertex", "rep")
    linked = found.groupBy("rep").agg(F.sum("hits").alias("hits"))
    counted = classes.join(linked, "rep", "left").join(parts, "rep", "left").select("label", "vec", "least", (F.col("n") - 1 + F.coalesce("hits", F.lit(0))).alias("n_links"), "component")
    counted = scratch.write(counted, "counted")
    named = scratch.write(counted.where("component IS NOT NULL").groupBy("component").agg(F.min("least").alias("name")), "named")
    named = counted.join(named, "component", "left").select("label", "vec", "n_links", F.when(F.col("component").isNull(), F.col("least")).otherwise(F.col("name")).alias("component"))
    known = scratch.write(named, "known")
    scratch.drop_but("known")
    out = rows.join(known, ["label", "vec"], "left")
    alone = F.col("n_links").isNull()
    return out.select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(alone, F.col("id")).otherwise(F.col("component")).alias("component"))


def op10_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: links and component of every row of ``embeddings``."""
    got = near_vectors(table(spark, sf_dir, "embeddings"))
    return got.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), F.col("id").eqNullSafe(F.col("component")).alias("kept"))


OP10_SQL = """
WITH RECURSIVE v AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), known AS MATERIALIZED (
  SELECT rid, label, CASE WHEN label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0 THEN e END AS e FROM v
), good AS MATERIALIZED (
  SELECT rid, label, len(e) AS d, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS u FROM known WHERE e IS NOT NULL
), pairs AS MATERIALIZED (
  SELECT a.rid AS a, b.rid AS b FROM good a JOIN good b ON a.label = b.label AND a.d = b.d AND a.rid <> b.rid WHERE list_dot_product(a.u, b.u) >= 0.93::DOUBLE
), reach AS (
  SELECT rid, rid AS other FROM v UNION SELECT reach.rid, b FROM reach JOIN pairs ON other = a
), part AS (
  SELECT r.rid, min(v.vec_id) AS component_id FROM reach r JOIN v ON v.rid = other GROUP BY r.rid
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM v JOIN part USING (rid) LEFT JOIN (SELECT a AS rid, count(*) AS n FROM pairs GROUP BY a) USING (rid)
"""
