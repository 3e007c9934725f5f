"""Connected components of an edge table: trees within each task, then alternating large-star and small-star steps.

First each task replaces the edges that it reads by stars, in blocks of a bounded number of edges: as many links as nodes, at
most.  Then stars of different tasks meet.  No step collects edges to the driver or a hub's neighbours to one task: each is
a minimum per node (combined on the map side) and an equi-join on the node, whose skewed partitions adaptive execution
splits.  Every round is written to the shared folder, so lineage stays short.  The number of rounds grows with the
logarithm of the number of nodes; edges that one task read need none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratalex.llm.common import discard, materialise

#: Edges (of 16 bytes) that a task joins at a time.
FEW = 1_000_000


def _star(edges: DataFrame, large: bool) -> tuple[DataFrame, DataFrame]:
    """large: link every larger neighbour of a node to the least of the node and its neighbours.
    small: link the smaller neighbours of a node, and the node, to the least of them.
    Also returns the table of minima, for discard()."""
    if large:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialise(least, "least")  # read anew, so that the join can split a hub
        out = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = materialise(down.groupBy("a").agg(F.min("b").alias("m")), "least")
        out = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select("a", F.col("m").alias("b")))
    return out.filter("a <> b").distinct(), least


def _stars(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Edges -> (node, least node of its component among them) of the nodes that are not the least."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while len(a):
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root[root] != root).any():
            root = root[root]
        open_ = root[a] != root[b]
        a, b = a[open_], b[open_]
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[child]), pa.array(nodes[root[child]])], names=["a", "b"])


def _within_tasks(edges: DataFrame) -> DataFrame:
    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got, n = [], 0
        for x in batches:
            got.append((x.column(0).to_numpy(), x.column(1).to_numpy()))
            n += x.num_rows
            if n >= FEW:
                yield _stars(*map(np.concatenate, zip(*got)))
                got, n = [], 0
        if n:
            yield _stars(*map(np.concatenate, zip(*got)))

    return edges.mapInArrow(join, "a long, b long")


def _settled(edges: DataFrame) -> bool:
    """Whether each node has one root, which itself has none."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("root")).unionAll(edges.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("root").alias("root")).filter("up > 1 or up = 1 and root = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b) of longs, undirected, loops and repeats allowed -> (node, root), root the least node of each component.
    Nodes of no edge to another node do not occur.  An empty table gives an empty table."""
    edges = materialise(_within_tasks(edges.filter("a <> b").select("a", "b")), "edges")
    while not _settled(edges):
        large, least = _star(edges, True)
        large = materialise(large, "edges")
        discard(edges, least)
        small, least = _star(large, False)
        edges = materialise(_within_tasks(small), "edges")
        discard(large, least)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
