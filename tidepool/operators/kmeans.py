"""Weighted k-means over summaries or raw rows.

One pass per iteration: rows are assigned and summed in the same scan (``operators.fold``), k
rows of sums come back.  A cluster that loses all its rows leaves the game for good; the first
centre wins ties.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.clustering import KMeans as MLKMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import summary
from tidepool.operators.assign import assign_nearest
from tidepool.operators.cf import cf_merge, vector_sum
from tidepool.operators.fold import fold_rows
from tidepool.operators.rows import sample_fixed, small_side
from tidepool.schema import VECTOR
from tidepool.session import LIMITS, Limits, width_of

CENTRES = T.StructType([T.StructField("mc_id", T.LongType()), T.StructField("centre", VECTOR)])


def seed_centres(points: DataFrame, k: int, key: list[str], *, x: str = "x", seed: int = 0) -> DataFrame:
    """k rows drawn without replacement as (mc_id, centre)."""
    drawn = sample_fixed(points, k, key, seed).select(x).collect()
    return points.sparkSession.createDataFrame([(i, list(r[0])) for i, r in enumerate(drawn)], CENTRES)


def lloyd(points: DataFrame, centres: DataFrame, iterations: int, *, x: str = "x", weight: str | None = None,
          until_stable: bool = False, limits: Limits = LIMITS) -> DataFrame:
    """(mc_id, centre) after the given number of iterations from the given centres.

    ``until_stable`` stops as soon as no centre moves.
    """
    spark = points.sparkSession
    centres = spark.createDataFrame(centres.select("mc_id", "centre").collect(), CENTRES)
    held = not points.storageLevel.useMemory and not points.storageLevel.useDisk
    rows = points.select(x, *([weight] if weight else []))
    rows = rows.persist() if held else rows
    for _ in range(iterations):
        sums = fold_rows(rows, centres, x=x, t=None, weight=weight, limits=limits).filter("mc_id >= 0")
        d = width_of(centres, "centre")
        moved = sums.groupBy("mc_id").agg(F.sum("n").alias("n"), vector_sum(F.col("ls"), d).alias("ls")).filter("n > 0")
        fresh = sorted((r["mc_id"], [v / r["n"] for v in r["ls"]]) for r in moved.collect())
        if until_stable:
            old = {r["mc_id"]: np.array(r["centre"]) for r in centres.collect()}
            if len(old) == len(fresh) and all(np.array_equal(old[i], np.array(c)) for i, c in fresh):
                break
        centres = spark.createDataFrame(fresh, CENTRES)
    if held:
        rows.unpersist()
    return centres


def weighted_clusters(examples: DataFrame, centres: DataFrame, iterations: int, *, x: str = "x",
                      weight: str = "weight", until_stable: bool = False, limits: Limits = LIMITS) -> DataFrame:
    """(cluster_id, centre, weight): final centres with the weight they carry, empty ones dropped."""
    final = lloyd(examples, centres, iterations, x=x, weight=weight, until_stable=until_stable, limits=limits)
    labelled = label_rows(examples, final, x=x, limits=limits)
    sums = labelled.groupBy("cluster_id").agg(F.sum(weight).alias("weight"))
    return (sums.join(small_side(final.withColumnRenamed("mc_id", "cluster_id")), "cluster_id")
            .select("cluster_id", "centre", "weight"))


def label_rows(points: DataFrame, centres: DataFrame, *, x: str = "x", out: str = "cluster_id",
               limits: Limits = LIMITS) -> DataFrame:
    return assign_nearest(points, centres, x=x, out=out, dist="dist", limits=limits)


def as_examples(model: DataFrame, form: str = "centre") -> DataFrame:
    """Micro-clusters as weighted examples: their centroids, or their linear sums."""
    x = summary.centroid() if form == "centre" else F.col("ls")
    return model.filter("n > 0").select("mc_id", x.alias("x"), F.col("n").alias("weight"))


def macro_clusters(model: DataFrame, centres: DataFrame, iterations: int, *, d: int | None = None,
                   until_stable: bool = False, limits: Limits = LIMITS) -> DataFrame:
    """Weighted k-means on centroids, then the cluster features of each label added up."""
    ex = as_examples(model)
    final = lloyd(ex, centres, iterations, weight="weight", until_stable=until_stable, limits=limits)
    labels = label_rows(ex, final, limits=limits).select("mc_id", "cluster_id")
    return cf_merge(model.filter("n > 0").join(labels, "mc_id"), "cluster_id", d=d)


def library_kmeans(points: DataFrame, k: int, *, x: str = "x", weight: str | None = None, seed: int = 0,
                   iterations: int = 20) -> DataFrame:
    """(mc_id, centre) from Spark's own distributed k-means."""
    kept = [array_to_vector(F.col(x)).alias("features")] + ([F.col(weight).alias("w")] if weight else [])
    km = MLKMeans(k=k, seed=seed, maxIter=iterations)
    if weight:
        km = km.setWeightCol("w")
    fitted = km.fit(points.select(*kept))
    rows = [(i, c.tolist()) for i, c in enumerate(fitted.clusterCenters())]
    return points.sparkSession.createDataFrame(rows, CENTRES)


def drawn_kmeans(model: DataFrame, k: int, draws: int, *, seed: int = 0, iterations: int = 20) -> DataFrame:
    """k-means on centroids drawn in proportion to their weight; a draw count acts as the weight."""
    from tidepool.operators.rows import draw_weighted

    drawn = draw_weighted(as_examples(model), "weight", draws, ["mc_id"], seed)
    return library_kmeans(drawn.withColumn("copies", F.col("copies").cast("double")), k, weight="copies", seed=seed,
                          iterations=iterations)


