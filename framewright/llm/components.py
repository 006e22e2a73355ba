"""Connected components by distributed label propagation with pointer jumping.

Each round a vertex takes the smallest label among its own and its neighbours' (one join on the
edges, one aggregate with a map-side part), then every label is replaced by its label's label.
Rounds end when no label changes; each one's labels are a written table, so lost executors cost
one round at most. No link or component reaches the driver, only whether any label changed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """(vertex, component) for every vertex of ``edges`` (a, b: long); component is the smallest vertex.

    Loops and repeated edges are allowed; no edges give no rows.
    """
    both = edges.where("a <> b").select("a", "b").union(edges.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = scratch.write(both.distinct(), f"{name}-links")
    labels = scratch.write(links.groupBy(F.col("a").alias("vertex")).agg(F.min("b").alias("m")).select("vertex", F.least("vertex", "m").alias("label")), f"{name}-0")
    at = 0
    while True:
        seen = links.join(labels.select(F.col("vertex").alias("b"), "label"), "b").select(F.col("a").alias("vertex"), "label", F.lit(None).cast("long").alias("old"))
        own = labels.select("vertex", "label", F.col("label").alias("old"))
        heard = scratch.write(own.union(seen).groupBy("vertex").agg(F.min("label").alias("label"), F.max("old").alias("old")), f"{name}-{at}-heard")
        far = heard.select(F.col("vertex").alias("label"), F.col("label").alias("far"))
        jumped = scratch.write(heard.join(far, "label").select("vertex", F.col("far").alias("label"), "old"), f"{name}-{at + 1}")
        scratch.drop(f"{name}-{at}")
        scratch.drop(f"{name}-{at}-heard")
        labels, at = jumped, at + 1
        if not labels.where("label <> old").limit(1).count():
            break
    scratch.drop(f"{name}-links")
    return labels.select("vertex", F.col("label").alias("component"))
