"""DenStream: decaying p- and o-micro-clusters without a size limit, one batch step, pruning."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.functions import summary, vec
from tidepool.operators import dbscan, kmeans
from tidepool.operators.cf import decayed_merge
from tidepool.operators.fold import fold_decaying
from tidepool.operators.rows import number_rows
from tidepool.operators.settle import settle_born
from tidepool.schema import DECAYING_CLUSTER
from tidepool.session import LIMITS, Limits, cut_lineage, width_of

ORDERS = ("merge", "batch_time")
PRUNE_MODES = ("period", "multiple", "every_batch", "every_4", "never")


@dataclass(frozen=True)
class DenStreamParams:
    """eps: largest radius; mu: core weight; beta: p-weight fraction; lam: decay per tick.

    prune: ``period`` when at least tp ticks have passed, ``multiple`` when the latest tick is a
    multiple of tp, or by batch count.  ``reuse_old_outliers=False`` sends every p-miss to the
    birth of new o-clusters.
    """

    eps: float = 16.0
    mu: float = 10.0
    beta: float = 0.2
    lam: float = 0.25
    t_factor: float = 1.0
    tp: int | None = None
    recheck: bool = True
    reuse_old_outliers: bool = True
    prune: str = "period"
    order: str = "merge"
    tick_step: int = 10_000
    exact: bool = False  # let o-clusters be born row by row, in one task

    def __post_init__(self):
        if self.order not in ORDERS:
            raise ValueError(f"order must be one of {ORDERS}")
        if self.prune not in PRUNE_MODES:
            raise ValueError(f"prune must be one of {PRUNE_MODES}")

    @property
    def period(self) -> int:
        return self.tp if self.tp is not None else summary.check_period(self.lam, self.beta, self.mu)

    @property
    def p_floor(self) -> float:
        return self.beta * self.mu


@dataclass
class DecayingState:
    model: DataFrame
    clock: int = 0
    last_prune: int = 0
    batches: int = 0
    left_over: int = 0


FIELDS = [f.name for f in DECAYING_CLUSTER.fields]


# ---- initial models --------------------------------------------------------------------------


def init_dbscan(points: DataFrame, eps: float, mu: float, *, x: str = "x", t: int = 0, d: int | None = None,
                limits: Limits = LIMITS) -> DataFrame:
    """One p-cluster per density cluster of the initial points."""
    found = dbscan.initial_clusters(points, eps, mu, x=x, d=d, limits=limits)
    numbered = number_rows(found, ["cluster"], "mc_id")
    return cut_lineage(numbered.select(
        "mc_id", F.lit("p").alias("kind"), "w", "ls", "ss", F.lit(t).cast("long").alias("t0"),
        F.lit(t).cast("long").alias("t_last")))


def init_kmeans(points: DataFrame, k: int = 2, *, x: str = "x", t: int = 0, seed: int = 0) -> DataFrame:
    """k-means centres as p-clusters of weight 1."""
    c = F.col("centre")
    return cut_lineage(kmeans.library_kmeans(points, k, x=x, seed=seed).select(
        "mc_id", F.lit("p").alias("kind"), F.lit(1.0).alias("w"), c.alias("ls"), vec.square(c).alias("ss"),
        F.lit(t).cast("long").alias("t0"), F.lit(t).cast("long").alias("t_last")))


# ---- batch step --------------------------------------------------------------------------------


def promote(model: DataFrame, floor: float, eligible=None) -> DataFrame:
    """o-clusters heavy enough become p-clusters."""
    ripe = (F.col("kind") == "o") & (F.col("w") >= floor)
    ripe = ripe if eligible is None else ripe & eligible
    return model.withColumn("kind", F.when(ripe, F.lit("p")).otherwise(F.col("kind")))


def prune(model: DataFrame, now: int, params: DenStreamParams, kinds: tuple[str, ...] = ("p", "o")) -> DataFrame:
    """Drop faded p-clusters, and o-clusters below what their age demands."""
    w = summary.decayed("w", F.lit(now) - F.col("t_last"), params.lam)
    floor = summary.outlier_floor(F.lit(now), "t0", params.lam, params.period)
    keep_p = (F.col("kind") != "p") | (w >= params.p_floor) if "p" in kinds else F.lit(True)
    keep_o = (F.col("kind") != "o") | (w >= floor) if "o" in kinds else F.lit(True)
    return model.filter(keep_p & keep_o)


def prune_due(state: DecayingState, now: int, params: DenStreamParams) -> bool:
    if params.prune == "never":
        return False
    if params.prune == "period":
        return now - state.last_prune >= params.period
    if params.prune == "multiple":
        return now % params.period == 0
    return params.prune == "every_batch" or (state.batches + 1) % 4 == 0


def step(state: DecayingState, batch: DataFrame, params: DenStreamParams, *, x: str = "x", t: str = "t",
         keep=cut_lineage, limits: Limits = LIMITS) -> DecayingState:
    """Fold one batch: p and old o absorb by trial insertion, the rest is born as o, then promote and prune."""
    batch_time = params.order == "batch_time"
    tick = state.clock + params.tick_step
    points = batch.select(F.col(x).alias("x"), (F.lit(tick) if batch_time else F.col(t)).cast("long").alias("t"))
    kinds = ("p", "o") if params.reuse_old_outliers else ("p",)
    parts = fold_decaying(points, state.model, eps=params.eps, lam=params.lam, factor=params.t_factor, kinds=kinds,
                          limits=limits).persist()
    missed = F.col("mc_id") < 0
    seen = parts.agg(F.count("*").alias("k"), F.max("t_last").alias("t"), F.count_if(missed).alias("left"),
                     F.min(F.size("ls")).alias("d")).first()
    if not seen["k"]:
        parts.unpersist()
        return replace(state, batches=state.batches + 1)
    now, d = max(state.clock, seen["t"]), seen["d"]
    hits = parts.filter(~missed).select(*FIELDS)
    # A hit row brings its own first time; the cluster keeps the earlier one (its birth).
    merged = decayed_merge(state.model.unionByName(hits.withColumn("t0", F.lit(None).cast("long"))), F.lit(now), params.lam,
                           ["mc_id", "kind"], d=d)
    model = promote(merged.select(*FIELDS), params.p_floor)
    if seen["left"]:
        top = state.model.agg(F.coalesce(F.max("mc_id"), F.lit(-1)).alias("m")).first()["m"]
        left = parts.filter(missed)
        if params.recheck:
            born = settle_born(left, eps=params.eps, lam=params.lam, factor=params.t_factor, exact=params.exact)
        else:  # unchecked, every row is a cluster of its own
            born = left.select("w", "ls", "ss", "t0", "t_last")
        born = number_rows(born, ["t0", "ls"], "mc_id").withColumn("mc_id", F.col("mc_id") + F.lit(top + 1))
        fade = summary.decay(F.lit(now) - F.col("t_last"), params.lam)
        born = born.withColumn("kind", F.lit("o"))
        if params.recheck:
            born = promote(born, params.p_floor)
        model = model.unionByName(born.select(
            "mc_id", "kind", (F.col("w") * fade).alias("w"), F.transform("ls", lambda v: v * fade).alias("ls"),
            F.transform("ss", lambda v: v * fade).alias("ss"), "t0", F.lit(now).cast("long").alias("t_last")))
    due = prune_due(state, now, params)
    if due:
        model = prune(model, now, params)
    model = keep(model.select(*FIELDS))
    parts.unpersist()
    return DecayingState(model, now, now if due else state.last_prune, state.batches + 1, state.left_over + seen["left"])


def finish(state: DecayingState, params: DenStreamParams) -> DecayingState:
    """Final prune at the end of the stream."""
    return replace(state, model=cut_lineage(prune(state.model, state.clock, params)))


def final_clusters(model: DataFrame, eps: float, mu: float, *, d: int | None = None, limits: Limits = LIMITS) -> DataFrame:
    """(cluster_id, w, ls, ss) of the p-clusters by density, or the p-clusters themselves."""
    return dbscan.offline_clusters(model.filter("kind = 'p'"), eps, mu, d=d or width_of(model, "ls"), limits=limits)


def final_kmeans(model: DataFrame, k: int, *, iterations: int = 100, seed: int = 0, limits: Limits = LIMITS) -> DataFrame:
    """(cluster_id, centre, weight) of the p-clusters by weighted k-means."""
    ex = model.filter("kind = 'p'").select("mc_id", summary.centroid("w", "ls").alias("x"), F.col("w").alias("weight"))
    start = kmeans.seed_centres(ex, k, ["mc_id"], seed=seed)
    return kmeans.weighted_clusters(ex, start, iterations, until_stable=True, limits=limits)
