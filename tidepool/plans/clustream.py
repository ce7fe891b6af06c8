"""CluStream: a fixed number of micro-clusters, one batch step, several initial models.

How event time is used within a batch is the ``order`` option:
``merge`` and ``event_time`` carry each record's own time (their sums are equal, addition
commutes); ``batch_time`` stamps every record with the batch's tick.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import vec
from tidepool.operators import kmeans, record_fold
from tidepool.operators.assign import absorb_radii
from tidepool.operators.cf import cf_merge
from tidepool.operators.fold import fold_rows
from tidepool.operators.rows import sample_fixed
from tidepool.operators.settle import settle_in_slots
from tidepool.schema import MICRO_CLUSTER
from tidepool.session import LIMITS, Limits, cut_lineage, width_of

ORDERS = ("merge", "event_time", "batch_time")


@dataclass(frozen=True)
class CluStreamParams:
    """m: last points that count as recent; horizon: how far the stamp may lag before deletion."""

    q: int = 100
    m: int = 500
    horizon: float = 2.0
    t_factor: float = 2.0
    recheck: bool = True
    order: str = "merge"
    tick_step: int = 10_000
    exact: bool = False  # settle left-over rows one by one, in one task
    left_most: int = 4096  # sums of left-over rows that one task settles

    def __post_init__(self):
        if self.order not in ORDERS:
            raise ValueError(f"order must be one of {ORDERS}")

    @classmethod
    def per_record(cls, q: int, **kw) -> "CluStreamParams":
        """The record-at-a-time flavour: wide horizon, radius of two standard deviations."""
        return cls(**{"q": q, "m": 100, "horizon": 1000.0, "t_factor": 2.0, **kw})


@dataclass
class Clustering:
    """A model between batches."""

    model: DataFrame
    clock: float = 0.0
    batches: int = 0
    rows: int = 0
    left_over: int = 0


# ---- initial models --------------------------------------------------------------------------


def _model(centres: DataFrame, t: float = 0.0) -> DataFrame:
    """(mc_id, centre) as micro-clusters of one member."""
    c = F.col("centre")
    out = centres.select(
        F.col("mc_id").cast("long").alias("mc_id"), F.lit(1.0).alias("n"), c.alias("ls"), vec.square(c).alias("ss"),
        F.lit(float(t)).alias("lst"), F.lit(float(t) ** 2).alias("sst"), F.array(F.col("mc_id").cast("long")).alias("ids"))
    return cut_lineage(out.select(*[f.name for f in MICRO_CLUSTER.fields]))


def init_kmeans(points: DataFrame, q: int, *, x: str = "x", seed: int = 0, t: float = 0.0) -> DataFrame:
    return _model(kmeans.library_kmeans(points, q, x=x, seed=seed), t)


def init_points(points: DataFrame, q: int, key: list[str], *, x: str = "x", seed: int = 0, t: float = 0.0) -> DataFrame:
    """One cluster per drawn point."""
    return _model(kmeans.seed_centres(points, q, key, x=x, seed=seed), t)


def init_random(points: DataFrame, q: int, *, d: int | None = None, seed: int = 0, t: float = 0.0) -> DataFrame:
    """Standard normal centres."""
    d = d or width_of(points)
    spark = points.sparkSession
    centres = spark.range(q).select(F.col("id").alias("mc_id"), F.array(*[F.randn(seed + j) for j in range(d)]).alias("centre"))
    return _model(centres, t)


def init_streaming_kmeans(points: DataFrame, q: int, *, d: int | None = None, seed: int = 0, t: float = 0.0) -> DataFrame:
    """Centres of one forgetful k-means update from random centres."""
    from tidepool.plans import streaming_kmeans as skm

    d = d or width_of(points)
    start = skm.random_centres(points.sparkSession, q, d, seed=seed)
    return _model(skm.update(start, points, alpha=1.0).select("mc_id", "centre"), t)


# ---- batch step --------------------------------------------------------------------------------


def step(state: Clustering, batch: DataFrame, params: CluStreamParams, *, x: str = "x", t: str = "t",
         keep=cut_lineage, limits: Limits = LIMITS) -> Clustering:
    """Fold one batch into the model.

    ``keep`` materialises the new model (a checkpoint by default, a versioned table in the
    streaming runner).
    """
    batch_time = params.order == "batch_time"
    tick = state.clock + params.tick_step
    points = batch.select(F.col(x).alias("x"), (F.lit(tick) if batch_time else F.col(t).cast("double")).alias("t"))
    parts = fold_rows(points, absorb_radii(state.model, factor=params.t_factor, limits=limits), limits=limits).persist()
    missed = F.col("mc_id") < 0
    seen = parts.agg(F.sum("n").alias("n"), F.max("t_max").alias("t"), F.count_if(missed).alias("left")).first()
    if seen["n"] is None:
        parts.unpersist()
        return replace(state, batches=state.batches + 1)
    now = max(state.clock, seen["t"])
    d = width_of(state.model, "ls")
    deltas = parts.filter(~missed).select("mc_id", "n", "ls", "ss", "lst", "sst", F.lit(None).cast("array<bigint>").alias("ids"))
    model = cf_merge(state.model.unionByName(deltas), d=d, extra=(F.first("ids", ignorenulls=True).alias("ids"),))
    if seen["left"]:
        left = parts.filter(missed).select("n", "ls", "ss", "lst", "sst", F.col("t_max").alias("t"))
        model = settle_in_slots(
            model, left, now=now, m=params.m, horizon=params.horizon, factor=params.t_factor, recheck=params.recheck,
            keep_merged_open=not batch_time, newest_first=batch_time, exact=params.exact,
            most=params.left_most, rows=seen["left"])
    model = keep(model.select(*[f.name for f in MICRO_CLUSTER.fields]))
    parts.unpersist()
    return Clustering(model, now, state.batches + 1, state.rows + int(seen["n"]), state.left_over + seen["left"])


def record_step(state: Clustering, batch: DataFrame, params: CluStreamParams, *, x: str = "x", t: str = "t",
                keep=cut_lineage, limits: Limits = LIMITS) -> Clustering:
    """Fold one batch record by record: every record meets the model its predecessor in the task left.

    The tasks are the batch's partitions; repartition it beforehand for another number.  The model carries no lineage.
    ``left_over`` counts the clusters that tasks opened and still had at the end.
    """
    model = state.model.select("mc_id", *record_fold.FEATURES)
    parts = cut_lineage(record_fold.changes(batch, model, m=params.m, horizon=params.horizon, factor=params.t_factor, x=x, t=t, limits=limits))
    opened = (F.size("origins") == 0) & (F.col("n") > 0)
    seen = parts.agg(F.sum("met").alias("n"), F.max("t").alias("t"), F.count_if(opened).alias("opened")).first()
    if seen["n"] is None:
        return replace(state, model=keep(model), batches=state.batches + 1)
    model = keep(record_fold.apply_changes(model, parts, params.q))
    return Clustering(model, max(state.clock, seen["t"]), state.batches + 1, state.rows + int(seen["n"]), state.left_over + seen["opened"])


def final_clusters(model: DataFrame, k: int, *, iterations: int = 100, seed: int = 0, limits: Limits = LIMITS) -> DataFrame:
    """(cluster_id, n, ls, ss, lst, sst): macro clusters by weighted k-means, features added up."""
    filled = model.filter("n > 0")
    start = kmeans.seed_centres(kmeans.as_examples(filled), k, ["mc_id"], seed=seed)
    return kmeans.macro_clusters(filled, start, iterations, until_stable=True, limits=limits)


def init_sample(points: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    return sample_fixed(points, n, key, seed)
