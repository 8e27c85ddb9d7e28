"""Connected components of a table of links: in one task while they are few, else by alternating star contraction (Kiveris et al., 2014)."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import written

#: Links up to which one task finds the components (some 200 bytes each); beyond, rounds of joins do.
ONE_TASK_LINKS = 500_000


def _in_one_task(edges: DataFrame) -> DataFrame:
    """(node, root) of edges (u, v), whose number has been checked."""
    kind = edges.schema["u"].dataType.simpleString()

    def run(batches):
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = x = root[root[x]]
            return x

        arrow = None
        for b in batches:
            arrow = b.column(0).type
            for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                u, v = find(u), find(v)
                if u != v:
                    root[max(u, v)] = min(u, v)
        nodes = list(root)
        for at in range(0, len(nodes), 10_000):
            part = nodes[at : at + 10_000]
            yield pa.record_batch({"node": pa.array(part, arrow), "root": pa.array([find(x) for x in part], arrow)})

    return edges.coalesce(1).mapInArrow(run, f"node {kind}, root {kind}")


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that has a link, with the least node that links lead to.

    Beyond ONE_TASK_LINKS each round hangs every node's larger neighbours to its least one, then its smaller ones; trees halve in depth, so the
    number of rounds grows with the logarithm of the longest path. Rounds are written tables in the shared folder; only
    counts reach the driver. Links that are null, repeated or lead back to their node are allowed.
    """
    edges = written(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v"), "links")
    if edges.count() <= ONE_TASK_LINKS:
        return written(_in_one_task(edges), "components")
    edges = edges.distinct()
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.least("least", "u").alias("v"))
        large = written(large.distinct(), "large-star")
        low = large.groupBy("u").agg(F.min("v").alias("least"))
        small = large.join(low, "u")
        small = small.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(low.select("u", F.col("least").alias("v")))
        small = written(small.distinct(), "small-star")
        # done when all are stars: no root hangs on another node, and nothing changed
        changed = small.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(small, ["u", "v"], "left_anti").limit(1).count()
        edges = small
        if not changed:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
