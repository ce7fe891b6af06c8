"""Forgetful k-means: per batch c' = (c n a + sum x) / (n a + m)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.assign import assign_nearest
from tidepool.operators.cf import vector_sum
from tidepool.operators.evaluate import sse_given
from tidepool.operators.fold import fold_rows
from tidepool.schema import VECTOR
from tidepool.session import LIMITS, Limits, width_of

MODEL = T.StructType([T.StructField("mc_id", T.LongType()), T.StructField("centre", VECTOR),
                      T.StructField("weight", T.DoubleType())])


def random_centres(spark: SparkSession, k: int, d: int, *, weight: float = 0.0, seed: int = 0) -> DataFrame:
    return spark.range(k).select(F.col("id").alias("mc_id"), F.array(*[F.randn(seed + j) for j in range(d)]).alias("centre"),
                                 F.lit(float(weight)).alias("weight")).coalesce(1)


def update(model: DataFrame, batch: DataFrame, alpha: float, *, x: str = "x", time_unit: str = "batches",
           limits: Limits = LIMITS) -> DataFrame:
    """The model (mc_id, centre, weight) after one batch.

    Old weights are discounted by alpha per batch (or per point); a cluster whose weight has died
    away takes half of the heaviest cluster, just beside it.  The k rows of the model are
    all that comes back to the driver.
    """
    spark = batch.sparkSession
    base = model.collect()
    fixed = spark.createDataFrame(base, MODEL)
    d = width_of(fixed, "centre")
    sums = fold_rows(batch, fixed.select("mc_id", "centre"), x=x, t=None, limits=limits).filter("mc_id >= 0")
    per = sums.groupBy("mc_id").agg(F.sum("n").alias("n"), vector_sum(F.col("ls"), d).alias("ls"))
    got = {r["mc_id"]: (r["n"], list(r["ls"])) for r in per.collect()}
    points = sum(n for n, _ in got.values())
    discount = alpha if time_unit == "batches" else alpha ** points
    rows = []
    for r in sorted(base, key=lambda r: r["mc_id"]):
        weight, centre = r["weight"] * discount, list(r["centre"])
        if r["mc_id"] in got:
            n, ls = got[r["mc_id"]]
            share = n / max(weight + n, 1e-16)
            centre = [c * (1.0 - share) + v / n * share for c, v in zip(centre, ls)]
            weight += n
        rows.append([r["mc_id"], centre, weight])
    big, small = max(rows, key=lambda r: r[2]), min(rows, key=lambda r: r[2])
    if small[2] < 1e-8 * big[2]:
        half = (big[2] + small[2]) / 2.0
        nudge = [1e-14 * max(abs(c), 1.0) for c in big[1]]
        small[1], big[1] = [c - p for c, p in zip(big[1], nudge)], [c + p for c, p in zip(big[1], nudge)]
        small[2] = big[2] = half
    return spark.createDataFrame([tuple(r) for r in rows], MODEL)


@dataclass
class CentreState:
    """The centres between batches."""

    model: DataFrame
    batches: int = 0


def step(state: CentreState, batch: DataFrame, alpha: float, *, x: str = "x", time_unit: str = "batches",
         keep=lambda df: df, limits: Limits = LIMITS) -> CentreState:
    """One batch; the new model is k literal rows, so it carries no lineage."""
    return CentreState(keep(update(state.model, batch, alpha, x=x, time_unit=time_unit, limits=limits)), state.batches + 1)


def predict(model: DataFrame, points: DataFrame, *, x: str = "x", limits: Limits = LIMITS) -> DataFrame:
    """Rows (batch or streaming) with ``cluster_id`` and ``dist``."""
    return assign_nearest(points, model.select("mc_id", "centre"), x=x, out="cluster_id", dist="dist", limits=limits)


def cost(model: DataFrame, points: DataFrame, *, x: str = "x", limits: Limits = LIMITS) -> DataFrame:
    return sse_given(points, model.select("mc_id", "centre"), x=x, limits=limits)
