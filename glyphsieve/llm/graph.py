"""Connected components of an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphsieve.llm.shared import written

#: Up to so many edges go to one task; more are spread over the cluster.
LOCAL_EDGES = 2_000_000


def local_components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of each one's component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)  # hook the roots
        np.minimum.at(new, label[y], low)
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table = [b for b in batches if b.num_rows]
    if not table:
        return
    t = pa.Table.from_batches(table)
    k, a, b = (t[c].to_numpy() for c in ("k", "a", "b"))
    for one in np.unique(k):
        on = k == one
        nodes, least = local_components(a[on], b[on])
        for i in range(0, len(nodes), 1 << 16):
            part = slice(i, i + (1 << 16))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(nodes[part]), one, np.int32)), pa.array(nodes[part]), pa.array(least[part])], ["k", "node", "component"])


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(k, node, component) from edges (k int, a bigint, b bigint), each k a graph of its own.

    A component is named by its least node. Edges must be a table that is cheap to read again.
    A self edge makes a node known; nulls don't stand in edges."""
    edges = edges.select(F.col("k").cast("int"), F.col("a").cast("long"), F.col("b").cast("long"))
    if edges.count() <= local_edges:
        return edges.repartition(1).mapInArrow(_one_task, "k int, node long, component long")
    both = written(edges.union(edges.select("k", F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = both.groupBy("k", F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component"))
    while True:
        label = written(label)
        near = both.join(label.withColumnRenamed("node", "b"), ["k", "b"]).groupBy("k", F.col("a").alias("node")).agg(F.min("component").alias("near"))
        low = label.join(near, ["k", "node"]).select("k", "node", F.col("component").alias("old"), F.least("component", "near").alias("component"))
        up = label.select("k", F.col("node").alias("component"), F.col("component").alias("above"))
        new = written(low.join(up, ["k", "component"]).select("k", "node", "old", F.least("component", "above").alias("component")))
        label = new.drop("old")
        if not new.filter("old <> component").head(1):
            return label
