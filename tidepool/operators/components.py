"""Connected components by alternating large-star and small-star steps.

A graph of few edges (checked) is settled in one task.  Above that, every step is one minimum per node and one join of the edges with those minima: no neighbour
list is ever collected, so a hub node is only a skewed join key, which adaptive execution splits.
Lineage is cut after each round with a reliable checkpoint.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.blocks import list_column, vector_matrix
from tidepool.session import LIMITS, Limits, cut_lineage, ship_package


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = _both_ways(edges)
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return (both.filter("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = down.groupBy("a").agg(F.min("b").alias("m"))
    joined = down.join(low, "a")
    moved = joined.filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest node of each node's component, for nodes 0..n-1 and links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, root):
            return root
        root = new


def _settle(edges: DataFrame) -> DataFrame:
    """All edges in one task: each node with the smallest node of its component."""

    def run(batches):
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        lists = pa.types.is_list(table.column("a").type)
        ends = [vector_matrix(table.column(c)).astype(np.int64) if lists else table.column(c).to_numpy()
                for c in ("a", "b")]
        nodes, where = np.unique(np.concatenate(ends), axis=0, return_inverse=True)
        where = where.ravel()
        root = forest(len(nodes), where[:table.num_rows], where[table.num_rows:])
        link = root != np.arange(len(nodes))
        left, right = nodes[link], nodes[root[link]]
        if lists:
            kind = table.column("a").type
            yield pa.RecordBatch.from_arrays([list_column(left).cast(kind), list_column(right).cast(kind)], names=["a", "b"])
        else:
            yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right)], names=["a", "b"])

    ship_package(edges.sparkSession)
    return edges.coalesce(1).mapInArrow(run, edges.schema)


def _mark(edges: DataFrame):
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(nodes: DataFrame, edges: DataFrame, *, node: str = "node", src: str = "src",
                         dst: str = "dst", limits: Limits = LIMITS) -> DataFrame:
    """(node, component): the smallest node of the component; isolated nodes are their own.

    Nodes are numbers or arrays of whole numbers.
    """
    work = cut_lineage(edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a <> b")
                       .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    mark = _mark(work)
    while mark[0]:
        if mark[0] <= 4 * limits.block_rows:
            work = cut_lineage(_settle(work))
            break
        work = cut_lineage(_small_star(_large_star(work)))
        new = _mark(work)
        if new == mark:
            break
        mark = new
    roots = work.select(F.col("a").alias(node), F.col("b").alias("component"))
    return nodes.select(node).distinct().join(roots, node, "left").select(
        node, F.coalesce("component", node).alias("component"))
