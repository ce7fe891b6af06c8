"""Density-grid clustering of a stream: one tick folds a batch into the table of cells."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import grid as g
from tidepool.operators.grid import bounds, cell_counts, classify, clusters_to_features, grid_clusters, repair_clusters
from tidepool.schema import GRID_CELL
from tidepool.session import cut_lineage


@dataclass(frozen=True)
class DStreamParams:
    gaps: tuple[float, ...]
    lam: float = 0.998
    cm: float = 3.0
    cl: float = 0.8
    beta: float = 0.3
    time_gap: int = 1

    @property
    def d(self) -> int:
        return len(self.gaps)


def empty_grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], GRID_CELL)


def absorb(state: DataFrame, counts: DataFrame, tick: int, params: DStreamParams) -> DataFrame:
    """Upsert the batch's counts.  A cell that was removed before comes back with its removal tick."""
    joined = state.join(counts, "cell", "full_outer")
    fading = g.faded(F.coalesce("density", F.lit(0.0)), F.lit(tick) - F.coalesce("t_update", F.lit(tick)), params.lam)
    hit = F.col("count").isNotNull()
    return joined.select(
        "cell",
        F.when(hit, fading + F.col("count")).otherwise(F.col("density")).alias("density"),
        F.when(hit, F.lit(tick)).otherwise(F.col("t_update")).cast("int").alias("t_update"),
        "t_removed", "attr", F.coalesce("changed", F.lit(False)).alias("changed"), "cluster_id")


def remove_sporadic(state: DataFrame, tick: int, params: DStreamParams, n_cells: Column) -> DataFrame:
    """Drop thin cells but remember when; removed rows have density NULL and class -1."""
    gone = F.col("density").isNotNull() & g.sporadic(
        g.faded("density", F.lit(tick) - F.col("t_update"), params.lam), "t_update", "t_removed", F.lit(tick),
        n_cells, params.lam, params.cl, params.beta)
    flagged = state.withColumn("_gone", F.coalesce(gone, F.lit(False)))
    return flagged.withColumns({
        "t_removed": F.when(F.col("_gone"), F.lit(tick)).otherwise(F.col("t_removed")).cast("int"),
        "density": F.when(F.col("_gone"), F.lit(None)).otherwise(F.col("density"))}).drop("_gone")


def recluster(state: DataFrame, tick: int, params: DStreamParams, n_cells: Column, first: bool) -> DataFrame:
    """Decay all cells to the tick, classify them, and build or repair the clusters."""
    live = F.col("density").isNotNull()
    faded = state.withColumns({
        "density": g.faded("density", F.lit(tick) - F.col("t_update"), params.lam),
        "t_update": F.when(live, F.lit(tick)).otherwise(F.col("t_update")).cast("int"), "_was": F.col("attr")})
    table = classify(faded, n_cells, lam=params.lam, cm=params.cm, cl=params.cl)
    was = F.col("cluster_id").isNotNull() | (F.coalesce("_was", F.lit(g.UNSET)) != g.UNSET)
    table = cut_lineage(table.withColumns({
        "changed": F.when(live, F.col("changed")).otherwise(was), "attr": F.when(live, F.col("attr")).otherwise(F.lit(g.UNSET))}).drop("_was"))
    clusters = grid_clusters(table, params.d) if first else repair_clusters(table, params.d)
    return table.drop("cluster_id").join(clusters, "cell", "left").select(*[f.name for f in GRID_CELL.fields])


def forget(state: DataFrame, tick: int, params: DStreamParams) -> DataFrame:
    """Without the removed cells whose removal has no say any more: the next test does not look at it from ``(1 + beta) * t_removed`` on."""
    return state.filter(F.col("density").isNotNull() | (F.lit(tick) < F.lit(1.0 + params.beta) * F.col("t_removed")))


@dataclass
class GridState:
    """The table of cells between batches, and the box of all cells ever seen."""

    model: DataFrame
    tick: int = 0
    low: list[int] | None = None
    high: list[int] | None = None


def _box(state: GridState, counts: DataFrame, d: int) -> tuple[list[int] | None, list[int] | None]:
    """The box with the cells of the batch in it; a state without one (a table from elsewhere) is looked through once."""
    boxes = [bounds(counts, d).first()]
    boxes.append({"lo": state.low, "hi": state.high} if state.low or not state.tick else bounds(state.model, d).first())
    lows, highs = ([b[side] for b in boxes if b[side] and b[side][0] is not None] for side in ("lo", "hi"))
    return ([min(v) for v in zip(*lows)], [max(v) for v in zip(*highs)]) if lows else (None, None)


def step(state: GridState, batch: DataFrame, params: DStreamParams, *, x: str = "x", keep=cut_lineage) -> GridState:
    """One tick: count cells, upsert, and every ``time_gap`` ticks prune and recluster."""
    tick = state.tick + 1
    counts = cut_lineage(cell_counts(batch, list(params.gaps), x=x))
    low, high = _box(state, counts, params.d)
    if low is None:
        return GridState(keep(state.model), tick)
    first = state.model.isEmpty()
    new = absorb(state.model, counts, tick, params)
    if first or tick % params.time_gap == 0:
        n_cells = F.lit(float(math.prod(h - v + 1 for v, h in zip(low, high))))
        new = new if first else remove_sporadic(new, tick, params, n_cells)
        new = forget(recluster(new, tick, params, n_cells, first), tick, params)
    return GridState(keep(new), tick, low, high)


def clusters_of(state: DataFrame) -> DataFrame:
    return state.filter("cluster_id IS NOT NULL").select("cell", "cluster_id", "density", "attr")


def micro_clusters_of(state: DataFrame, params: DStreamParams) -> DataFrame:
    return clusters_to_features(clusters_of(state), list(params.gaps))
