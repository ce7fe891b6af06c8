"""Nearest-cluster lookups: plain, radius-bound, weight-scaled and with trial insertion.

The model reaches the tasks in bounded blocks (``operators.blocks``); the points are scanned
once and never shuffled, and a row looks into the blocks near it.  A small model is inlined as column expressions and stays in
whole-stage code generation; a large one carries a two-level index (``operators.centroid_index``).  Ties go to the smallest id.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import summary
from tidepool.operators.blocks import Block, list_column, map_batches, read_blocks, squared_distances, vector_matrix
from tidepool.operators.centroid_index import indexed, nearest
from tidepool.session import LIMITS, MAX_FLOAT, Limits

NONE = -1


def centres_of(model: DataFrame, *, n: str = "n", ls: str = "ls", mc_id: str = "mc_id") -> DataFrame:
    """(mc_id, centre) of cluster features."""
    return model.select(F.col(mc_id).alias("mc_id"), summary.centroid(n, ls).alias("centre"))


def assign_nearest(points: DataFrame, centres: DataFrame, *, x: str = "x", out: str = "mc_id",
                   dist: str = "dist", carry: tuple[str, ...] = (), limits: Limits = LIMITS) -> DataFrame:
    """Append the nearest centre's id and distance; ``centres`` is (mc_id, centre, *carry).

    ``carry`` names further model columns (numbers or vectors) to bring along.  With no centres,
    or for a NULL vector, the id is -1 and the distance the largest double.
    """
    fields = [f for f in centres.schema.fields if f.name in carry]
    blocks = (b for b in read_blocks(centres.select("mc_id", "centre", *carry), "mc_id", limits, place="centre") if len(b))
    block, more = next(blocks, None), next(blocks, None)
    if block is None:
        return points.withColumns({out: F.lit(NONE).cast("long"), dist: F.lit(MAX_FLOAT),
                                   **{f.name: F.lit(None).cast(f.dataType) for f in fields}})
    if more is not None:
        return _blocks_nearest(points, chain([block, more], blocks), x, out, dist, fields, limits)
    flat = all(not isinstance(f.dataType, T.ArrayType) for f in fields)
    if flat and block["centre"].size <= limits.inline_terms and len(block) <= 32:
        return _inline_nearest(points, block, x, out, dist, fields)
    return _block_nearest(points, indexed(block, limits), x, out, dist, fields)


def _inline_nearest(points, block: Block, x, out, dist, fields) -> DataFrame:
    parts = [F.col(x)[j] for j in range(block["centre"].shape[1])]
    options = []
    for i, centre in enumerate(block["centre"]):
        terms = [(p - F.lit(float(c))) * (p - F.lit(float(c))) for p, c in zip(parts, centre)]
        d2 = terms[0]
        for term in terms[1:]:
            d2 = d2 + term
        carried = [F.lit(block[f.name][i].item()).cast(f.dataType).alias(f.name) for f in fields]
        options.append(F.struct(d2.alias("d2"), F.lit(int(block["mc_id"][i])).cast("long").alias("id"), *carried))
    best = F.least(*options) if len(options) > 1 else options[0]
    return (points.withColumn("_best", F.when(F.col(x).isNotNull(), best))
            .withColumns({out: F.coalesce(F.col("_best.id"), F.lit(NONE).cast("long")),
                          dist: F.coalesce(F.sqrt("_best.d2"), F.lit(MAX_FLOAT)),
                          **{f.name: F.col(f"_best.{f.name}") for f in fields}})
            .drop("_best"))


def _nearest_columns(out, dist, fields) -> list[T.StructField]:
    return [T.StructField(out, T.LongType()), T.StructField(dist, T.DoubleType()), *fields]


def _told(label, d2, carried) -> list:
    """Columns of the nearest rows; without a finite distance there is none."""
    found = np.sqrt(d2)
    lost = ~np.isfinite(found)
    found[lost] = MAX_FLOAT
    return [np.where(lost, NONE, label), found, *[list_column(c) if c.ndim == 2 else c for c in carried]]


def _block_nearest(points, block: Block, x, out, dist, fields) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(block)
    names = [f.name for f in fields]

    def kernel(batch: pa.RecordBatch):
        b = shared.value
        idx, d2 = nearest(vector_matrix(batch.column(x), b["centre"].shape[1]), b)
        return _told(b["mc_id"][idx], d2, [b[n][idx] for n in names])

    return map_batches(points, _nearest_columns(out, dist, fields), kernel)


def _blocks_nearest(points, blocks, x, out, dist, fields, limits) -> DataFrame:
    """A model of several blocks, visited by one worker a task: a row looks into those blocks only whose box reaches as near as its best."""
    context, names = points.sparkSession.sparkContext, [f.name for f in fields]
    shared, low, high = [], [], []
    for block in blocks:
        c = block["centre"]
        c = c[np.isfinite(c).all(axis=1)]
        if c.size:  # the others are infinitely far
            low.append(c.min(axis=0))
            high.append(c.max(axis=0))
            shared.append(context.broadcast(indexed(block, limits)))
    if not shared:
        return points.withColumns({out: F.lit(NONE).cast("long"), dist: F.lit(MAX_FLOAT),
                                   **{f.name: F.lit(None).cast(f.dataType) for f in fields}})
    low, high = np.array(low), np.array(high)

    def look(rows, carried):
        near = np.zeros((len(rows), len(low)))
        for j in range(rows.shape[1]):
            gap = np.maximum(0.0, np.maximum(low[None, :, j] - rows[:, None, j], rows[:, None, j] - high[None, :, j]))
            near += gap * gap
        near *= 1 - 1e-12  # more than the rounding of the sums
        label, best = np.full(len(rows), NONE), np.full(len(rows), np.inf)
        home = near.argmin(axis=1)

        def visit(i, mine):
            b = shared[i].value
            idx, d2 = nearest(rows[mine], b)
            ids = b["mc_id"][idx]
            better = np.isfinite(d2) & ((d2 < best[mine]) | ((d2 == best[mine]) & (ids < label[mine])))
            to, idx = mine[better], idx[better]
            label[to], best[to] = ids[better], d2[better]
            for column, n in zip(carried, names):
                column[to] = b[n][idx]

        for first in (True, False):
            for i in range(len(shared)):
                mine = np.flatnonzero((home == i) if first else (home != i) & (near[:, i] <= best))
                if len(mine):
                    visit(i, mine)
        return label, best

    def kernel(batch: pa.RecordBatch):
        rows, b = vector_matrix(batch.column(x), low.shape[1]), shared[0].value
        carried = [np.repeat(b[n][:1], len(rows), axis=0) for n in names]
        step = max(64, (1 << 21) // len(low))
        found = [look(rows[lo:lo + step], [c[lo:lo + step] for c in carried]) for lo in range(0, len(rows), step)]
        label, best = (np.concatenate(c) for c in zip(*found))
        return _told(label, best, carried)

    return map_batches(points, _nearest_columns(out, dist, fields), kernel)


def absorb_radii(model: DataFrame, *, factor: float = 2.0, limits: Limits = LIMITS) -> DataFrame:
    """(mc_id, centre, radius): spread radius, or the distance to the nearest other centre for a
    cluster of at most one point."""
    base = model.select("mc_id", "n", summary.centroid().alias("centre"),
                        summary.spread_radius(factor=factor).alias("radius"))
    lone = nearest_other_centre(base.filter("n <= 1").select("mc_id", "centre"),
                                base.select("mc_id", "centre"), limits=limits)
    gaps = lone.select("mc_id", F.col("gap"))
    return (base.join(gaps, "mc_id", "left")
            .select("mc_id", "centre", F.when(F.col("n") > 1, F.col("radius"))
                    .otherwise(F.coalesce("gap", F.lit(MAX_FLOAT))).alias("radius")))


def nearest_other_centre(centres: DataFrame, others: DataFrame, *, limits: Limits = LIMITS) -> DataFrame:
    """Append ``gap``: distance to the nearest centre with another id (largest double if none)."""
    result, first = centres, True
    for block in read_blocks(others.select("mc_id", "centre"), "mc_id", limits):
        if len(block) == 0:
            continue
        shared = centres.sparkSession.sparkContext.broadcast(block)

        def kernel(batch, shared=shared, first=first):
            ids, c = shared.value["mc_id"], shared.value["centre"]
            own = batch.column("mc_id").to_numpy(zero_copy_only=False)
            rows = vector_matrix(batch.column("centre"), c.shape[1])
            out = np.empty(len(rows))
            step = max(1, (1 << 20) // len(c))
            for lo in range(0, len(rows), step):
                d2 = squared_distances(rows[lo:lo + step], c)
                d2[own[lo:lo + step, None] == ids[None, :]] = np.inf
                out[lo:lo + step] = np.sqrt(d2.min(axis=1))
            out[~np.isfinite(out)] = MAX_FLOAT
            if not first:
                out = np.minimum(out, batch.column("gap").to_numpy(zero_copy_only=False))
            return [out]

        result = map_batches(result, [T.StructField("gap", T.DoubleType())], kernel, () if first else ("gap",))
        first = False
    return result.withColumn("gap", F.lit(MAX_FLOAT)) if first else result


def assign_within_radius(points: DataFrame, model: DataFrame, *, factor: float = 2.0, x: str = "x",
                         out: str = "mc_id", dist: str = "dist", limits: Limits = LIMITS) -> DataFrame:
    """Nearest micro-cluster if the point lies within its radius, else -1."""
    radii = absorb_radii(model, factor=factor, limits=limits)
    return assign_to_spheres(points, radii, x=x, out=out, dist=dist, limits=limits)


def assign_to_spheres(points: DataFrame, radii: DataFrame, *, x: str = "x", out: str = "mc_id",
                      dist: str = "dist", limits: Limits = LIMITS) -> DataFrame:
    """Nearest centre, id kept only within that centre's radius; ``radii`` is (mc_id, centre, radius)."""
    near = assign_nearest(points, radii, x=x, out=out, dist=dist, carry=("radius",), limits=limits)
    inside = F.coalesce(F.col(dist) <= F.col("radius"), F.lit(False))
    return near.withColumn(out, F.when(inside, F.col(out)).otherwise(F.lit(NONE).cast("long"))).drop("radius")


def assign_weighted(points: DataFrame, centres: DataFrame, *, x: str = "x", weight: str = "weight",
                    out: str = "cluster", limits: Limits = LIMITS) -> DataFrame:
    """Nearest centre of rows given as weighted sums: distance |c - x/w| * w."""
    means = points.withColumn("_mean", F.transform(F.col(x), lambda v: v / F.col(weight)))
    return (assign_nearest(means, centres, x="_mean", out=out, dist="dist", limits=limits)
            .withColumn("dist", F.col("dist") * F.col(weight)).drop("_mean"))


# ---- trial insertion ------------------------------------------------------------------------


def assign_decaying(points: DataFrame, model: DataFrame, *, eps: float, lam: float, factor: float = 1.0,
                    kinds: tuple[str, ...] = ("p", "o"), x: str = "x", t: str = "t",
                    limits: Limits = LIMITS) -> DataFrame:
    """Append ``kind`` ('p', 'o' or NULL) and ``mc_id`` (-1 if rejected) by trial insertion.

    The nearest cluster of the first kind is decayed to the point's time and given the point on
    trial; the point is taken if the resulting radius stays within eps.  Rejected points try
    the next kind.  All kinds are tried against the model before the batch, in one scan.
    """
    result = points.withColumns({"kind": F.lit(None).cast("string"), "mc_id": F.lit(NONE).cast("long")})
    for kind in kinds:
        part = model.filter(F.col("kind") == kind)
        result = _try_kind(result, part, kind, eps, lam, factor, x, t, limits)
    return result


def _try_kind(points, model, kind, eps, lam, factor, x, t, limits) -> DataFrame:
    columns = model.select("mc_id", "w", "ls", "ss", "t_last", summary.centroid("w", "ls").alias("centre"))
    blocks = read_blocks(columns, "mc_id", limits)
    block = next(blocks, None)
    if block is None or len(block) == 0:
        return points
    if next(blocks, None) is None:
        return _trial_one_block(points, indexed(block, limits), kind, eps, lam, factor, x, t)
    # A model of several blocks: carry the nearest cluster's sums along and test afterwards.
    renamed = columns.select("mc_id", "centre", F.col("w").alias("_w"), F.col("ls").alias("_ls"),
                             F.col("ss").alias("_ss"), F.col("t_last").cast("double").alias("_tl"))
    near = assign_nearest(points, renamed, x=x, out="_id", dist="_d", carry=("_w", "_ls", "_ss", "_tl"), limits=limits)
    f = summary.decay(F.col(t) - F.col("_tl"), lam)
    w = F.col("_w") * f + 1.0
    ls = F.zip_with("_ls", x, lambda a, b: a * f + b)
    ss = F.zip_with("_ss", x, lambda a, b: a * f + b * b)
    take = (F.col("mc_id") == NONE) & (F.col("_id") != NONE) & (summary.widest_radius(w, ls, ss, factor) <= eps)
    return (near.withColumn("_ok", F.coalesce(take, F.lit(False)))
            .withColumns({"kind": F.when(F.col("_ok"), F.lit(kind)).otherwise(F.col("kind")),
                          "mc_id": F.when(F.col("_ok"), F.col("_id")).otherwise(F.col("mc_id"))})
            .select(*points.columns))


def trial_radius(rows, ages, w, ls, ss, lam, factor):
    """Radius after decaying each row's cluster by its age and adding the row (numpy)."""
    f = np.exp2(-lam * ages)
    w1 = w * f + 1.0
    mean = (ls * f[:, None] + rows) / w1[:, None]
    var = (ss * f[:, None] + rows * rows) / w1[:, None] - mean * mean
    radius = factor * np.sqrt(np.maximum(var.max(axis=1), 0.0))
    return np.where(w1 > 1, radius, np.inf)


def _trial_one_block(points, block, kind, eps, lam, factor, x, t) -> DataFrame:
    shared = points.sparkSession.sparkContext.broadcast(block)

    def kernel(batch):
        b = shared.value
        rows = vector_matrix(batch.column(x), b["centre"].shape[1])
        when = batch.column(t).to_numpy(zero_copy_only=False).astype(float)
        old = batch.column("mc_id").to_numpy(zero_copy_only=False)
        old_kind = np.array(batch.column("kind").to_pylist(), dtype=object)
        open_rows = np.flatnonzero(old == NONE)
        label = old.copy()
        if len(open_rows):
            part = rows[open_rows]
            idx, _ = nearest(part, b)
            radius = trial_radius(part, when[open_rows] - b["t_last"][idx], b["w"][idx], b["ls"][idx], b["ss"][idx],
                                  lam, factor)
            ok = radius <= eps
            label[open_rows[ok]] = b["mc_id"][idx[ok]]
            old_kind[open_rows[ok]] = kind
        return [pa.array(old_kind, pa.string()), label]

    return map_batches(points, [T.StructField("kind", T.StringType()), T.StructField("mc_id", T.LongType())],
                       kernel, ("kind", "mc_id"))
