"""Connected components of a graph given as an edge table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlab.session import materialize

#: Edges, of 16 bytes each, that one task joins.
FEW_EDGES = 300_000


def _stars(parents: DataFrame) -> DataFrame:
    """(node, comp): paths of (node, comp) followed to their ends; each step doubles how far a node looks."""
    while True:
        up = parents.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        stepped = parents.join(up, "comp").select("node", F.col("further").alias("comp"), (F.col("further") < F.col("comp")).alias("moved"))
        stepped = materialize(stepped, "stars")
        parents = stepped.select("node", "comp")
        if stepped.filter("moved").isEmpty():
            return parents


def _relabelled(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Distinct ``edges`` (a, b) between different components."""
    left = labels.select(F.col("node").alias("a"), F.col("comp").alias("x"))
    right = labels.select(F.col("node").alias("b"), F.col("comp").alias("y"))
    between = edges.join(left, "a").join(right, "b").filter("x <> y")
    return between.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of the edges of one task: every node points to a smaller one of its component, the last to itself."""
    parent: dict[int, int] = {}

    def top(node: int) -> int:
        while (up := parent.setdefault(node, node)) != node:
            parent[node] = parent[up]
            node = parent[node]
        return node

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x, y = top(a), top(b)
            if x != y:
                parent[max(x, y)] = min(x, y)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(n) for n in nodes], pa.int64())], names=["node", "comp"])


def components(edges: DataFrame, few: int = FEW_EDGES) -> DataFrame:
    """(node, comp) for the nodes of ``edges`` (a, b): comp is the smallest node of the component.

    Up to ``few`` edges are joined in one task. More are contracted in rounds with the same result: each round hooks every node to its smallest neighbour if that is smaller, follows the hooks to their ends and keeps
    only the edges between the ends, so each round at least halves the nodes that have edges left.
    """
    left = materialize(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct(), "edges")
    if left.count() <= few:
        return materialize(left.coalesce(1).mapInArrow(_joined, "node long, comp long"), "labels")
    labels = None
    while True:
        both = left.union(left.select("b", "a"))
        hooked = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp"))
        found = _stars(materialize(hooked, "hooks"))
        if labels is None:
            labels = found
        else:
            further = found.select(F.col("node").alias("comp"), F.col("comp").alias("to"))
            labels = materialize(labels.join(further, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
        left = materialize(_relabelled(left, found), "edges")
        if left.isEmpty():
            return labels


def joined_components(labels: DataFrame | None, edges: DataFrame) -> DataFrame:
    """``labels`` (node, comp) after ``edges`` (a, b) are added: only components that the new edges touch are worked on."""
    if labels is None:
        return components(edges)
    ends = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    fresh = ends.join(labels, "node", "left_anti").select("node", F.col("node").alias("comp"))
    every = materialize(labels.union(fresh), "labels")
    merged = components(_relabelled(edges, every)).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return materialize(every.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")), "labels")
