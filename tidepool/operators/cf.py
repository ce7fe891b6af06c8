"""Cluster-feature aggregates: plain, decayed, batch-time; merging and weights.

Sums commute, so a per-group sort before folding changes nothing and is not done; the ordered
variants differ only in which time a row carries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.functions import summary
from tidepool.session import width_of


def _key(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def vector_sum(x: Column, d: int) -> Column:
    return F.array(*[F.sum(x[j]) for j in range(d)])


def cf_aggregate(points: DataFrame, by="mc_id", *, x: str = "x", t: str | None = "t",
                 d: int | None = None) -> DataFrame:
    """Count, vector sums and time sums per group, in one hash aggregation with map-side combine."""
    d = d or width_of(points, x)
    xc = F.col(x)
    when = F.col(t).cast("double") if t else F.lit(0.0)
    aggs = [F.count("*").cast("double").alias("n"),
            *[F.sum(xc[j]).alias(f"_ls{j}") for j in range(d)],
            *[F.sum(xc[j] * xc[j]).alias(f"_ss{j}") for j in range(d)],
            F.sum(when).alias("lst"), F.sum(when * when).alias("sst"), F.max(when).alias("t_max")]
    return (points.groupBy(*_key(by)).agg(*aggs)
            .withColumns({"ls": F.array(*[f"_ls{j}" for j in range(d)]),
                          "ss": F.array(*[f"_ss{j}" for j in range(d)])})
            .select(*_key(by), "n", "ls", "ss", "lst", "sst", "t_max"))


def cf_batch_time(points: DataFrame, tick: int, by="mc_id", *, x: str = "x", d: int | None = None) -> DataFrame:
    """Every row counts as arrived at the batch's tick; no decay within the batch."""
    return cf_aggregate(points.withColumn("_tick", F.lit(tick).cast("long")), by, x=x, t="_tick", d=d)


def decayed_cf(points: DataFrame, by="mc_id", *, lam: float, x: str = "x", t: str = "t",
               d: int | None = None, anchor: Column | None = None) -> DataFrame:
    """Sums weighted by 2^(-lam (T - t)); T is the latest time of the group unless ``anchor`` is given.

    First rows are summed per group and span of time against the end of the span (map-side
    combine, any key skew); a span is short enough for the weights to stay far from underflow.
    Then the few span sums of a group are moved to T and added.
    """
    d = d or width_of(points, x)
    keys = _key(by)
    span = max(1, int(500 / lam)) if lam > 0 else 1 << 40
    xc, tc = F.col(x), F.col(t)
    end = (F.floor(tc / span) + 1) * span
    f = summary.decay(F.col("_end") - tc, lam)
    parts = (points.withColumn("_end", end.cast("long")).withColumn("_f", f)
             .groupBy(*keys, "_end").agg(
                 F.sum("_f").alias("w"), F.count("*").alias("n_rows"),
                 F.max(tc).cast("long").alias("_last"), F.min(tc).cast("long").alias("t0"),
                 *[F.sum(F.col("_f") * xc[j]).alias(f"_ls{j}") for j in range(d)],
                 *[F.sum(F.col("_f") * xc[j] * xc[j]).alias(f"_ss{j}") for j in range(d)]))
    last = F.max("_last").over(W.partitionBy(*keys)) if anchor is None else anchor.cast("long")
    g = F.col("_g")
    return (parts.withColumn("t_last", last)
            .withColumn("_g", summary.decay(F.col("t_last") - F.col("_end"), lam))
            .groupBy(*keys).agg(
                F.sum(F.col("w") * g).alias("w"), F.sum("n_rows").alias("n_rows"), F.min("t0").alias("t0"),
                F.max("t_last").alias("t_last"),
                F.array(*[F.sum(F.col(f"_ls{j}") * g) for j in range(d)]).alias("ls"),
                F.array(*[F.sum(F.col(f"_ss{j}") * g) for j in range(d)]).alias("ss")))


def cf_merge(features: DataFrame, by="mc_id", *, d: int | None = None, extra: tuple[Column, ...] = ()) -> DataFrame:
    """Add cluster features that share a target (n, ls, ss, lst, sst)."""
    d = d or width_of(features, "ls")
    return (features.groupBy(*_key(by)).agg(
        F.sum("n").alias("n"), vector_sum(F.col("ls"), d).alias("ls"), vector_sum(F.col("ss"), d).alias("ss"),
        F.sum("lst").alias("lst"), F.sum("sst").alias("sst"), *extra))


def decayed_merge(features: DataFrame, now: Column, lam: float, by="mc_id", *, d: int | None = None) -> DataFrame:
    """Add decaying clusters after moving each from its own t_last to ``now``."""
    d = d or width_of(features, "ls")
    moved = features.withColumn("_f", summary.decay(now - F.col("t_last"), lam))
    f = F.col("_f")
    return (moved.groupBy(*_key(by)).agg(
        F.sum(F.col("w") * f).alias("w"),
        F.array(*[F.sum(F.col("ls")[j] * f) for j in range(d)]).alias("ls"),
        F.array(*[F.sum(F.col("ss")[j] * f) for j in range(d)]).alias("ss"),
        F.min("t0").alias("t0"))
        .withColumn("t_last", now.cast("long")))


def point_features(points: DataFrame, *, x: str = "x", t: str = "t") -> DataFrame:
    """Every point as a cluster feature of one member."""
    when = F.col(t).cast("double")
    return points.select(
        "*", F.lit(1.0).alias("n"), F.col(x).alias("ls"), F.transform(x, lambda v: v * v).alias("ss"),
        when.alias("lst"), (when * when).alias("sst"))


def mc_weights(model: DataFrame) -> DataFrame:
    """(mc_id, centre, weight): centres of non-empty clusters, weights adding up to 1."""
    filled = model.filter("n > 0")
    total = filled.agg(F.sum("n").alias("s")).scalar()
    return filled.select("mc_id", summary.centroid().alias("centre"), (F.col("n") / total).alias("weight"))


def to_long(features: DataFrame, keys: list[str], vectors: tuple[str, ...] = ("ls", "ss")) -> DataFrame:
    """One row per group and dimension."""
    zipped = F.arrays_zip(*[F.col(v) for v in vectors])
    rest = [c for c in features.columns if c not in vectors and c not in keys]
    return (features.select(*keys, *rest, F.posexplode(zipped).alias("dim", "_v"))
            .select(*keys, *rest, "dim", *[F.col(f"_v.{v}").alias(v) for v in vectors]))
