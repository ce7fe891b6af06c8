"""Neighbourhood joins among summaries: closest pair, range neighbours, grid adjacency, k-NN.

None of them emits the pairs of a group: distances are taken inside Arrow batches against
bounded blocks and only what the operator returns leaves the task.  A large window does not pass
through the driver: its blocks meet the blocks of points (``operators.pairs``).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.blocks import read_blocks, squared_distances, vector_matrix
from tidepool.operators.pairs import Nearest, meet_all
from tidepool.operators.rows import check_size
from tidepool.session import LIMITS, Limits, cut_lineage, ship_package

WINDOW_ROWS = 4096  # a window of no more rows goes to every task


def closest_pair(centres: DataFrame, *, limits: Limits = LIMITS) -> DataFrame:
    """(id_a, id_b, gap) of the two closest centres, id_a < id_b; ties to the smallest ids.

    Each row keeps its nearest partner with a larger id; one small reduction picks the pair.
    """
    schema = T.StructType([T.StructField("d2", T.DoubleType()), T.StructField("id_a", T.LongType()),
                           T.StructField("id_b", T.LongType())])
    parts = None
    for block in read_blocks(centres.select("mc_id", "centre"), "mc_id", limits):
        if len(block) == 0:
            continue
        shared = centres.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            ids, c = shared.value["mc_id"], shared.value["centre"]
            for batch in batches:
                own = batch.column("mc_id").to_numpy(zero_copy_only=False)
                rows = vector_matrix(batch.column("centre"), c.shape[1])
                step = max(1, (1 << 20) // len(c))
                best = None
                for lo in range(0, len(rows), step):
                    mine = own[lo:lo + step]
                    d2 = squared_distances(rows[lo:lo + step], c)
                    d2[ids[None, :] <= mine[:, None]] = np.inf
                    j = np.argmin(d2, axis=1)
                    v = d2[np.arange(len(mine)), j]
                    i = np.lexsort((mine, v))[0]
                    if np.isfinite(v[i]):
                        cand = (float(v[i]), int(mine[i]), int(ids[j[i]]))
                        best = cand if best is None else min(best, cand)
                if best:
                    yield pa.RecordBatch.from_pylist([dict(zip(("d2", "id_a", "id_b"), best))],
                                                     schema=pa.schema([("d2", pa.float64()), ("id_a", pa.int64()),
                                                                       ("id_b", pa.int64())]))

        part = centres.select("mc_id", "centre").mapInArrow(run, schema)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return centres.sparkSession.createDataFrame([], "id_a long, id_b long, gap double")
    best = parts.agg(F.min(F.struct("d2", "id_a", "id_b")).alias("b")).filter("b IS NOT NULL")
    return best.select("b.id_a", "b.id_b", F.sqrt("b.d2").alias("gap"))


def near_lists(points: DataFrame, window: DataFrame, k: int, *, x: str = "x", key: str = "id",
               group: str = "class", limits: Limits = LIMITS) -> DataFrame:
    """(key, group, near): sorted distances of every point to its k nearest window rows of each group.

    The point itself (same key) does not count.  Groups with no other row are left out.  Lists of two
    groups merge into the list of their union, see ``merge_lists``.
    """
    schema = T.StructType([
        T.StructField(key, T.LongType()), T.StructField(group, T.LongType()),
        T.StructField("near", T.ArrayType(T.DoubleType()))])
    pts = points.select(F.col(key).cast("long").alias("key"), F.col(x).alias("x"))
    refs = window.select(F.col(key).cast("long").alias("key"), F.col(group).cast("long").alias("group"), F.col(x).alias("x"))
    if not check_size(refs, min(WINDOW_ROWS, limits.block_rows)):
        return _near_in_blocks(pts, refs, k, limits).select(F.col("key").alias(key), F.col("group").alias(group), "near")
    ship_package(points.sparkSession)
    held = refs.toArrow().combine_chunks()
    if held.num_rows == 0:
        return points.sparkSession.createDataFrame([], schema)
    shared = points.sparkSession.sparkContext.broadcast(Nearest(*_columns(held), k))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                rows, groups, near = shared.value.lists(batch.column("key"), vector_matrix(batch.column("x"), shared.value.reference.c.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("key").take(pa.array(rows)), pa.array(groups), near], names=schema.names)

    return pts.mapInArrow(run, schema)


def _columns(table: pa.Table):
    key, group, x = (c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (table.column(n) for n in ("key", "group", "x")))
    return key, group, vector_matrix(x)


def _near_in_blocks(pts: DataFrame, refs: DataFrame, k: int, limits: Limits) -> DataFrame:
    """(key, group, near) against a window of any size: blocks of points meet blocks of the window, lists of a point merge."""
    pts, refs = pts.filter("x IS NOT NULL"), refs.filter("x IS NOT NULL")  # the others are near nothing
    laid = cut_lineage(pts.withColumn("id", F.monotonically_increasing_id()))

    def kernel(groups, keys, ref, _):
        nearest = Nearest(keys, groups, ref, k)

        def see(ids, own, rows, _):
            at, names, near = nearest.lists(own, rows)
            at = pa.array(at)
            return [ids.take(at), own.take(at), pa.array(names), near]

        return see, lambda: None

    zero = F.lit(0.0).alias("value")
    parts = meet_all(refs.select(F.col("group").alias("id"), "key", "x", zero), laid.select("id", "key", "x", zero),
                     "id long, key long, group long, near array<double>", kernel, limits=limits)
    merged = parts.groupBy("id", "group").agg(F.first("key").alias("key"), F.flatten(F.collect_list("near")).alias("near"))
    return merged.select("key", "group", F.slice(F.array_sort("near"), 1, k).alias("near"))


def merge_lists(lists: DataFrame, k: int, key: str = "id", group: str = "class") -> DataFrame:
    """One sorted list of at most k distances per (key, group)."""
    merged = lists.groupBy(key, group).agg(F.flatten(F.collect_list("near")).alias("near"))
    return merged.withColumn("near", F.slice(F.array_sort("near"), 1, k))


def mean_of(near) -> Column:
    return F.aggregate(near, F.lit(0.0), lambda s, v: s + v) / F.size(near)


def knn_distances(points: DataFrame, window: DataFrame, k: int, *, x: str = "x", key: str = "id",
                  group: str = "class", limits: Limits = LIMITS) -> DataFrame:
    """(key, group, kd, n_found): mean distance of every point to its k nearest window rows of each group."""
    lists = near_lists(points, window, k, x=x, key=key, group=group, limits=limits)
    return lists.select(key, group, mean_of("near").alias("kd"), F.size("near").alias("n_found"))
