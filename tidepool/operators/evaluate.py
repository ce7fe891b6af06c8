"""Sum-of-squares quality of a clustering: batch functions, also usable inside foreachBatch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.assign import assign_nearest
from tidepool.operators.fold import fold_rows
from tidepool.session import LIMITS, Limits, width_of


def cluster_centroids(labelled: DataFrame, *, cluster: str = "cluster_id", x: str = "x", d: int | None = None) -> DataFrame:
    """(cluster, centre, size)."""
    d = d or width_of(labelled, x)
    return (labelled.groupBy(cluster)
            .agg(*[F.avg(F.col(x)[j]).alias(f"_c{j}") for j in range(d)], F.count("*").alias("size"))
            .select(cluster, F.array(*[f"_c{j}" for j in range(d)]).alias("centre"), "size"))


def sse(labelled: DataFrame, *, cluster: str = "cluster_id", x: str = "x", d: int | None = None) -> DataFrame:
    """Squared distances of rows to the centroid of their own cluster: one row (sse, n).

    sum |x - c|^2 over a cluster is n * sum of variances, so one aggregation does it; the
    variance is Spark's, which is numerically stable.
    """
    d = d or width_of(labelled, x)
    per = labelled.groupBy(cluster).agg(
        F.count("*").alias("n"), *[F.var_pop(F.col(x)[j]).alias(f"_v{j}") for j in range(d)])
    parts = per.select("n", (sum((F.col(f"_v{j}") for j in range(d)), F.lit(0.0)) * F.col("n")).alias("e"))
    return parts.agg(F.coalesce(F.sum("e"), F.lit(0.0)).alias("sse"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def sse_given(points: DataFrame, centres: DataFrame, *, x: str = "x", limits: Limits = LIMITS) -> DataFrame:
    """Squared distances of rows to the nearest of the supplied (mc_id, centre): one row (sse, n)."""
    folded = fold_rows(points, centres, x=x, t=None, limits=limits)
    return folded.agg(F.coalesce(F.sum("sq_err"), F.lit(0.0)).alias("sse"),
                      F.coalesce(F.sum("n"), F.lit(0.0)).cast("long").alias("n"))


def sse_carried(rows: DataFrame, *, x: str = "x", centre: str = "centre", d: int | None = None) -> DataFrame:
    """Every row brings its own centre."""
    d = d or width_of(rows, x)
    e = sum(((F.col(x)[j] - F.col(centre)[j]) * (F.col(x)[j] - F.col(centre)[j]) for j in range(d)), F.lit(0.0))
    return rows.agg(F.coalesce(F.sum(e), F.lit(0.0)).alias("sse"), F.count("*").alias("n"))


def ssb(labelled: DataFrame, *, cluster: str = "cluster_id", x: str = "x", d: int | None = None) -> DataFrame:
    """Sizes times squared distances of the centroids from the grand mean: one row (ssb, k)."""
    d = d or width_of(labelled, x)
    per = cluster_centroids(labelled, cluster=cluster, x=x, d=d)
    grand = labelled.agg(*[F.avg(F.col(x)[j]).alias(f"g{j}") for j in range(d)]).select(
        F.array(*[f"g{j}" for j in range(d)]).alias("g")).scalar()
    with_grand = per.withColumn("_g", grand)
    e = sum(((F.col("centre")[j] - F.col("_g")[j]) * (F.col("centre")[j] - F.col("_g")[j]) for j in range(d)), F.lit(0.0))
    return with_grand.agg(F.coalesce(F.sum(F.col("size") * e), F.lit(0.0)).alias("ssb"), F.count("*").alias("k"))


def assign_final(points: DataFrame, clusters: DataFrame, *, x: str = "x", limits: Limits = LIMITS) -> DataFrame:
    """Rows (batch or streaming) with the nearest final cluster (cluster_id, centre)."""
    centres = clusters.select(F.col("cluster_id").alias("mc_id"), "centre")
    return assign_nearest(points, centres, x=x, out="cluster_id", dist="dist", limits=limits)
