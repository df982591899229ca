"""Connected components by hooking and contraction, as joins; no link or component comes to the driver.

Defined results: links with a null end and links of a node with itself say nothing, and a node of no other link has no row; repeated and turned links are one; an empty
table gives an empty table; columns other than a and b are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.operators.table import checkpointed, remove_kept

#: Edges that one task finishes: 16 MB of them.
ONE_TASK = 1 << 20


def _flat(parent: DataFrame) -> DataFrame:
    """a, p: the root above each node, by pointer doubling."""
    while True:
        above = parent.select(F.col("a").alias("p"), F.col("p").alias("q"))
        twice = checkpointed(parent.join(above, "p", "left").select("a", F.coalesce("q", "p").alias("p"), F.col("q").isNotNull().alias("moved")))
        remove_kept(parent)
        parent = twice.select("a", "p")
        if twice.where("moved").isEmpty():
            return parent


def _in_one_task(edges: DataFrame) -> DataFrame:
    """a, p: the component of each node of edges that one task can hold."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        a, b = (np.concatenate([x.column(i).to_numpy() for x in held]) for i in (0, 1))
        nodes, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        u, v = place[: len(a)], place[len(a) :]
        label = np.arange(len(nodes))
        while True:
            x, y = label[u], label[v]
            if (x == y).all():
                break
            low = np.minimum(x, y)
            np.minimum.at(label, x, low)
            np.minimum.at(label, y, low)
            while (label[label] != label).any():
                label = label[label]
        for s in range(0, len(nodes), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[s : s + 100_000]), pa.array(nodes[label[s : s + 100_000]])], names=["a", "p"])

    return edges.coalesce(1).mapInArrow(run, "a long, p long")


def components(edges: DataFrame) -> DataFrame:
    """id, component (the smallest id reachable) of every node of edges (a long, b long). In each round every node hooks onto its
    smallest neighbour if that is smaller, trees are flattened by pointer doubling, and edges are carried over to the roots; the
    edges between different roots are those of the next round, until they are so few (ONE_TASK) that one task can finish. A node of very
    many edges is met by partial aggregation and by joins that can be split."""
    label = None
    edges = checkpointed(edges.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a <> b").distinct())
    while True:
        last = edges.count() <= ONE_TASK
        if last:
            root = checkpointed(_in_one_task(edges))
        else:
            # Roots have no row here: they hook nowhere.
            both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
            root = _flat(checkpointed(both.groupBy("a").agg(F.min("b").alias("p")).where("p < a")))
        if label is None:
            every = root.select(F.col("a").alias("id")) if last else both.select(F.col("a").alias("id")).distinct()
            new = every.join(root, F.col("id") == F.col("a"), "left").select("id", F.coalesce("p", "id").alias("component"))
        else:
            new = label.join(root, F.col("component") == F.col("a"), "left").select("id", F.coalesce("p", "component").alias("component"))
        new = checkpointed(new)
        if not last:
            to_a, to_b = root.select("a", F.col("p").alias("x")), root.select(F.col("a").alias("b"), F.col("p").alias("y"))
            left = edges.join(to_a, "a", "left").join(to_b, "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")).where("a <> b").distinct()
            left = checkpointed(left)
        remove_kept(edges, root, *([label] if label is not None else []))
        if last:
            return new
        edges, label = left, new
