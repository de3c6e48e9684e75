"""Connected components of a distributed edge list by rounds of contraction."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltql.llm.common import written

#: Edges that are followed on the driver; more are contracted in rounds.
LOCAL_EDGES = 100_000


def _followed(links: pa.Table) -> pa.Table:
    """(node, root) of ``links`` (a, b)."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root[up]
        return x

    for a, b in zip(links["a"].to_pylist(), links["b"].to_pylist(), strict=True):
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return pa.table({"node": pa.array(root, pa.int64()), "root": pa.array([find(x) for x in root], pa.int64())})


def _shortened(parents: DataFrame) -> DataFrame:
    """One pointer jump: parent becomes the parent's parent."""
    up = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    return parents.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of ``edges`` (a, b): nodes of one component share a root; empty for no edges.

    Each round hangs every node below its smallest neighbour, shortens the chains, and rewrites the edges
    between what is left; at most half of the nodes are left, so rounds grow with the logarithm. Minima are
    summed before the shuffle and each round is a written table, so neither a hub nor a lost
    executor costs more than its own edges. Few edges are followed on the driver instead, which saves the rounds.
    """
    links = written(edges.where("a <> b").select("a", "b"), "links")
    if 0 < links.count() <= LOCAL_EDGES:
        return written(edges.sparkSession.createDataFrame(_followed(links.toArrow())), "roots")
    links = written(links.union(links.select("b", "a")).distinct(), "edges")
    labels: DataFrame | None = None
    while not links.isEmpty():
        below = links.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root"))
        parents = written(_shortened(written(below, "parents")), "parents")
        if labels is None:
            labels = parents
        else:
            up = parents.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
            labels = labels.join(up, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
            labels = written(labels, "labels")
        left = parents.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        right = parents.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        links = links.join(left, "a").join(right, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
        links = written(links.distinct(), "edges")
    return labels if labels is not None else links.select(F.col("a").alias("node"), F.col("b").alias("root"))
