"""Connected components of a link table, by local union-find and star contraction.

Each task first joins the links it reads with union-find and passes on a forest: at most
one link a node. Then rounds of large-star and small-star (Kiveris et al. 2014) pull every
node to the least node of its component, until no node has both a parent and a child, nor two
parents; each round is one aggregation and one join by node, written to the shared folder.
Nothing of it comes to the driver but whether such a node is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import durable, in_arrow


def _forest(batches):
    import numpy as np
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x: int) -> int:
        path = []
        while (y := up.get(x, x)) != x:
            path.append(x)
            x = y
        for p in path:
            up[p] = x
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                a, b = min(a, b), max(a, b)
                up[b] = a
                up.setdefault(a, a)
        if len(up) > 250_000:  # pass the forest on and begin again: memory stays bounded
            yield _links(up, root, np, pa)
            up.clear()
    yield _links(up, root, np, pa)


def _links(up, root, np, pa):
    child = np.array([x for x in up if root(x) != x], dtype=np.int64)
    parent = np.array([root(int(x)) for x in child], dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(parent), pa.array(child)], ["a", "b"])


def _stars(edges: DataFrame) -> bool:
    """Whether every node is a least node or has one link, to a least node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("b", F.lit(0), F.lit(1)))
    return not ends.groupBy("node").agg(F.max("up").alias("up"), F.sum("down").alias("down")).filter("down > 1 OR (up > 0 AND down > 0)").limit(1).count()


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a bigint, b bigint), component being its least node."""
    edges = durable(in_arrow(links.select("a", "b"), _forest, "a bigint, b bigint").distinct(), "cc-forest", light=True)
    while not _stars(edges):
        # large-star: what is larger than u goes to the least around u
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = durable(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "cc-least", light=True)
        large = durable(both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").union(least.filter("m < a").select(F.col("m").alias("a"), F.col("a").alias("b"))).filter("a < b").distinct(), "cc-large", light=True)
        # small-star: of u and what is smaller, all go to the least
        down = durable(large.groupBy("b").agg(F.min("a").alias("m")), "cc-down", light=True)
        edges = durable(
            large.join(down, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b")).union(down.select(F.col("m").alias("a"), "b")).distinct(), "cc-edges"
        )
    return edges.select(F.col("b").alias("node"), F.col("a").alias("component")).union(edges.select(F.col("a").alias("node"), F.col("a").alias("component"))).distinct()
