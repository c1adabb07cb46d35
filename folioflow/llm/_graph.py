"""Connected components of an edge table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import release, written

#: Edges of 16 bytes that the driver may hold; more are joined up by the executors.
DRIVER_EDGES = 500_000


def local_components(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest node reachable from each of nodes 0 to n - 1, by hooking and pointer jumping."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        open_ = la != lb
        a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
        low = np.minimum(la, lb)
        np.minimum.at(label, la, low)
        np.minimum.at(label, lb, low)
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up
    return label


def connected_components(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, component) of every node in ``edges`` (a, b: long); component is the smallest node reachable.

    Rows with a null end or with a = b only name nodes. Up to ``driver_edges`` edges (a checked
    count) are joined up on the driver, in numpy; more by alternating large-star and small-star
    steps, which keep every step a pre-aggregated minimum and a join, with a written table after each.
    """
    spark = edges.sparkSession
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL").select(
        F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    ).distinct()
    pairs = written(pairs, "edges")
    if pairs.count() <= driver_edges:
        got = pairs.toArrow()
        release(pairs)
        a, b = (np.asarray(got[c].combine_chunks()) for c in ("a", "b"))
        nodes, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = nodes[local_components(inverse[: len(a)], inverse[len(a) :], len(nodes))] if len(nodes) else nodes
        return spark.createDataFrame(
            pa.table({"node": pa.array(nodes, pa.int64()), "component": pa.array(label, pa.int64())})
        )
    seen, loops = None, pairs.where("a = b").select(F.col("a").alias("node"))
    pairs, last = pairs.where("a <> b"), None
    while True:
        # Large star: neighbours above u move to the least of u and its neighbours.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        pairs = large = written(both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large")
        if last is not None:
            release(last)
        # Small star: u and its neighbours below it move to the least of those.
        down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = last = written(moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small")
        release(large)
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == seen:
            roots = pairs.select(F.col("b").alias("node")).distinct()
            named = pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
                roots.select("node", F.col("node").alias("component"))
            )
            return named.unionByName(loops.join(named, "node", "left_anti").select("node", F.col("node").alias("component")))
        seen = state


class LinkTally:
    """Links among the nodes of one task, kept as counts by node and a spanning forest."""

    def __init__(self, weight: np.ndarray):
        self.weight, self.near = weight, np.zeros(len(weight), np.int64)
        self.a: list[np.ndarray] = [np.zeros(0, np.int64)]
        self.b: list[np.ndarray] = [np.zeros(0, np.int64)]

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        n = len(self.weight)
        self.near += np.bincount(a, self.weight[b], n).astype(np.int64) + np.bincount(b, self.weight[a], n).astype(np.int64)
        self.a.append(a)
        self.b.append(b)
        if sum(map(len, self.a)) > 4 * n:
            self.a, self.b = ([x] for x in self.forest())

    def forest(self) -> tuple[np.ndarray, np.ndarray]:
        label = local_components(np.concatenate(self.a), np.concatenate(self.b), len(self.weight))
        child = np.flatnonzero(label != np.arange(len(label)))
        return child, label[child]

    def rows(self, names: np.ndarray) -> pa.RecordBatch:
        """(a, b, near): edges of the forest, and with b null the weight linked to a."""
        child, parent = self.forest()
        some = np.flatnonzero(self.near)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate([names[child], names[some]])),
            pa.array(np.concatenate([names[parent], names[some]]), mask=np.arange(len(child) + len(some)) >= len(child)),
            pa.array(np.concatenate([np.zeros(len(child), np.int64), self.near[some]])),
        ], names=["a", "b", "near"])


LINK_SCHEMA = "a long, b long, near long"
