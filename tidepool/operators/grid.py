"""Density-grid operators on a table of cells: counts, bounds, classes, adjacency, clusters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.functions import grid as g
from tidepool.operators.components import connected_components


def cell_counts(points: DataFrame, gaps: list[float], *, x: str = "x") -> DataFrame:
    """(cell, count): one partial-then-final count, whatever the skew of the cells."""
    return points.groupBy(g.cell_of(x, gaps).alias("cell")).agg(F.count("*").cast("double").alias("count"))


def bounds(cells: DataFrame, d: int, cell: str = "cell") -> DataFrame:
    """One row (lo, hi, n_cells): box of all cells and the number of cells in it."""
    c = F.col(cell)
    lows, highs = [F.min(c[j]) for j in range(d)], [F.max(c[j]) for j in range(d)]
    return cells.agg(F.array(*lows).alias("lo"), F.array(*highs).alias("hi")).withColumn(
        "n_cells", F.aggregate(F.zip_with("hi", "lo", lambda h, l: (h - l + 1).cast("double")), F.lit(1.0),  # noqa: E741
                               lambda s, v: s * v))


def classify(cells: DataFrame, n_cells: Column, *, lam: float, cm: float, cl: float) -> DataFrame:
    """Append ``attr`` (2 dense, 1 transitional, 0 sparse) and whether it changed."""
    attr = g.density_class("density", g.dense_floor(n_cells, lam, cm), g.sparse_ceiling(n_cells, lam, cl))
    if "attr" in cells.columns:
        return cells.withColumn("_old", F.col("attr")).withColumn("attr", attr).withColumn(
            "changed", ~F.col("attr").eqNullSafe(F.col("_old"))).drop("_old")
    return cells.withColumns({"attr": attr, "changed": F.lit(True)})


def average_thresholds(cells: DataFrame, cm: float, cl: float) -> DataFrame:
    """The other published choice of thresholds: multiples of the mean density (one row dm, dl)."""
    return cells.agg((F.lit(cm) * F.avg("density")).alias("dm"), (F.lit(cl) * F.avg("density")).alias("dl"))


def neighbours_of(cell: Column, d: int, upward: bool = False) -> Column:
    """Array of the 2d cells one step away in one dimension (d upward ones only, if asked)."""
    steps = []
    for j in range(d):
        for s in ((1,) if upward else (-1, 1)):
            steps.append(F.array(*[cell[i] + (s if i == j else 0) for i in range(d)]))
    return F.array(*steps)


def adjacency(cells: DataFrame, d: int, others: DataFrame | None = None) -> DataFrame:
    """(cell, neighbour) among existing cells, each unordered pair once, or towards ``others`` both ways.

    Neighbour keys are exploded (at most 2d per cell) and matched by an equi-join.
    """
    within = others is None
    keys = cells.select("cell", F.explode(neighbours_of(F.col("cell"), d, upward=within)).alias("neighbour"))
    there = (cells if within else others).select(F.col("cell").alias("neighbour"))
    return keys.join(there, "neighbour", "left_semi").select("cell", "neighbour")


def grid_clusters(cells: DataFrame, d: int) -> DataFrame:
    """(cell, cluster_id) of clustered cells.

    Clusters are components of dense cells; a transitional cell next to clusters joins the one
    with most dense cells, ties to the smallest id; sparse cells belong to none.
    """
    dense = cells.filter(F.col("attr") == g.DENSE).select("cell")
    edges = adjacency(dense, d).select(F.col("cell").alias("src"), F.col("neighbour").alias("dst"))
    core = connected_components(dense.withColumnRenamed("cell", "node"), edges).select(
        F.col("node").alias("cell"), F.col("component").alias("cluster_id"))
    rim = _attach(cells.filter(F.col("attr") == g.TRANSITIONAL).select("cell"), core, d)
    return core.unionByName(rim)


def _attach(rim: DataFrame, core: DataFrame, d: int) -> DataFrame:
    size = core.groupBy("cluster_id").agg(F.count("*").alias("size"))
    near = adjacency(rim, d, core)
    owner = core.select(F.col("cell").alias("neighbour"), "cluster_id").join(size, "cluster_id")
    best = F.min(F.struct((-F.col("size")).alias("s"), F.col("cluster_id").alias("c")))
    return near.join(owner, "neighbour").groupBy("cell").agg(best.alias("b")).select("cell", F.col("b.c").alias("cluster_id"))


def repair_clusters(cells: DataFrame, d: int) -> DataFrame:
    """Clusters after some cells changed class, recomputing only the clusters they touch.

    ``cells`` carries the old ``cluster_id`` and the new ``attr`` and ``changed``.  A cluster is
    touched if one of its cells changed or vanished, or lies next to a changed cell; the dense cells of
    untouched clusters keep their id, which is their smallest dense cell and cannot have moved.
    """
    changed = cells.filter("changed").select("cell")
    reach = changed.unionByName(
        changed.select(F.explode(neighbours_of(F.col("cell"), d)).alias("cell"))).distinct()
    touched = (cells.filter("cluster_id IS NOT NULL").join(reach, "cell", "left_semi")
               .select("cluster_id").distinct())
    dense = cells.filter(F.col("attr") == g.DENSE)
    kept = dense.filter("cluster_id IS NOT NULL").join(touched, "cluster_id", "left_anti").select("cell", "cluster_id")
    again = dense.select("cell").join(kept.select("cell"), "cell", "left_anti")
    edges = adjacency(again, d).select(F.col("cell").alias("src"), F.col("neighbour").alias("dst"))
    fresh = connected_components(again.withColumnRenamed("cell", "node"), edges).select(
        F.col("node").alias("cell"), F.col("component").alias("cluster_id"))
    core = kept.unionByName(fresh)
    rim = _attach(cells.filter(F.col("attr") == g.TRANSITIONAL).select("cell"), core, d)
    return core.unionByName(rim)


def inside_flags(clustered: DataFrame, d: int) -> DataFrame:
    """Append ``is_inside``: all 2d neighbours belong to the same cluster."""
    keys = clustered.select("cell", "cluster_id", F.explode(neighbours_of(F.col("cell"), d)).alias("n"))
    same = clustered.select(F.col("cell").alias("n"), "cluster_id")
    full = keys.join(same, ["n", "cluster_id"]).groupBy("cell").agg(F.count("*").alias("k"))
    return clustered.join(full, "cell", "left").withColumn(
        "is_inside", F.coalesce(F.col("k"), F.lit(0)) == 2 * d).drop("k")


def cluster_weights(clustered: DataFrame) -> DataFrame:
    """(cluster_id, weight): number of cells."""
    return clustered.groupBy("cluster_id").agg(F.count("*").alias("weight"))


def clusters_to_features(clustered: DataFrame, gaps: list[float]) -> DataFrame:
    """Grid clusters as cluster features: n = cells, sums over the cell centres."""
    from tidepool.operators.cf import cf_aggregate

    pts = clustered.select("cluster_id", g.cell_centre("cell", gaps).alias("x"))
    return cf_aggregate(pts, "cluster_id", t=None, d=len(gaps)).select("cluster_id", "n", "ls", "ss")


def points_in_clusters(points: DataFrame, clustered: DataFrame, gaps: list[float], *, x: str = "x") -> DataFrame:
    """Rows with the id of the grid cluster whose cell they fall into (NULL if none)."""
    return points.withColumn("cell", g.cell_of(x, gaps)).join(clustered.select("cell", "cluster_id"), "cell", "left")
