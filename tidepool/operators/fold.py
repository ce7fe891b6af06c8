"""Assign rows and add them up in the same pass over the data.

Each task keeps one row of sums per cluster while it streams its Arrow batches and emits those
sums at the end, plus the rows no cluster took (each as a cluster feature of one member).  What
is shuffled afterwards is clusters x tasks rows, however many points there are and however
unevenly they fall on the clusters.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import summary
from tidepool.operators.assign import NONE, assign_decaying, assign_nearest, assign_to_spheres, trial_radius
from tidepool.operators.blocks import list_column, read_blocks, vector_matrix
from tidepool.operators.centroid_index import indexed, nearest
from tidepool.operators.cf import point_features
from tidepool.schema import CLUSTER_FEATURE, VECTOR
from tidepool.session import LIMITS, Limits

FEATURE_ROW = T.StructType([T.StructField("mc_id", T.LongType()), *CLUSTER_FEATURE,
                            T.StructField("t_max", T.DoubleType()), T.StructField("sq_err", T.DoubleType())])

DECAYED_ROW = T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("mc_id", T.LongType()), T.StructField("w", T.DoubleType()),
    T.StructField("ls", VECTOR), T.StructField("ss", VECTOR), T.StructField("t0", T.LongType()),
    T.StructField("t_last", T.LongType())])


def one_block(model: DataFrame, order: str, limits: Limits = LIMITS):
    """The model as a single block, or None if it is too large for that."""
    blocks = read_blocks(model, order, limits)
    first = next(blocks, None)
    second = next(blocks, None) if first is not None else None
    blocks.close()
    if first is None or second is not None:
        return None
    return indexed(first, limits) if "centre" in first else first


def _group_sums(label, values, q):
    if values.ndim == 1:
        return np.bincount(label, weights=values, minlength=q)
    return np.stack([np.bincount(label, weights=values[:, j], minlength=q) for j in range(values.shape[1])], axis=1)


def _feature_batch(ids, n, ls, ss, lst, sst, t_max, err):
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(n), list_column(ls), list_column(ss), pa.array(lst), pa.array(sst),
         pa.array(t_max), pa.array(err)],
        names=[f.name for f in FEATURE_ROW.fields])


def fold_rows(points: DataFrame, spheres: DataFrame, *, x: str = "x", t: str | None = "t",
              weight: str | None = None, limits: Limits = LIMITS) -> DataFrame:
    """Partial cluster features per task for (mc_id, centre[, radius]) and the rows left over.

    Left-over rows have mc_id -1.  Group by mc_id and add to get the batch's deltas.  ``sq_err``
    is the summed squared distance to the centre.
    """
    bound = "radius" in spheres.columns
    columns = ["mc_id", "centre"] + (["radius"] if bound else [])
    block = one_block(spheres.select(*columns), "mc_id", limits)
    if block is None:
        return _fold_large(points, spheres, bound, x, t, weight, limits)
    shared = points.sparkSession.sparkContext.broadcast(block)
    used = [F.col(x).alias("x"), (F.col(t).cast("double") if t else F.lit(0.0)).alias("t"),
            (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w")]

    def run(batches):
        b = shared.value
        q = len(b)
        acc = None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = vector_matrix(batch.column("x"), b["centre"].shape[1] if q else None)
            when = batch.column("t").to_numpy(zero_copy_only=False)
            w = batch.column("w").to_numpy(zero_copy_only=False)
            d = rows.shape[1]
            if q:
                idx, d2 = nearest(rows, b)
                hit = np.isfinite(d2)
                if bound:
                    hit &= np.sqrt(d2) <= b["radius"][idx]
            else:
                hit = np.zeros(len(rows), bool)
            if not hit.all():
                m = ~hit
                r, tm, wm = rows[m], when[m], w[m]
                yield _feature_batch(np.full(len(r), NONE), wm, r * wm[:, None], r * r * wm[:, None], tm * wm,
                                     tm * tm * wm, tm, np.zeros(len(r)))
            if hit.any():
                i, r, tm, wm = idx[hit], rows[hit], when[hit], w[hit]
                if acc is None:
                    acc = [np.zeros(q), np.zeros((q, d)), np.zeros((q, d)), np.zeros(q), np.zeros(q),
                           np.full(q, -np.inf), np.zeros(q)]
                rw = r * wm[:, None]
                parts = (wm, rw, rw * r, tm * wm, tm * tm * wm)
                for a, v in zip(acc[:5], parts):
                    a += _group_sums(i, v, q)
                np.maximum.at(acc[5], i, tm)
                acc[6] += np.bincount(i, weights=d2[hit] * wm, minlength=q)
        if acc is not None:
            keep = np.isfinite(acc[5])
            yield _feature_batch(b["mc_id"][keep], *[a[keep] for a in acc])

    return points.select(*used).mapInArrow(run, FEATURE_ROW)


def _fold_large(points, spheres, bound, x, t, weight, limits) -> DataFrame:
    base = points.select(F.col(x).alias("x"), (F.col(t).cast("double") if t else F.lit(0.0)).alias("t"),
                         (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("_wt"))
    assign = assign_to_spheres if bound else assign_nearest
    near = assign(base, spheres, limits=limits)
    wt = F.col("_wt")
    return point_features(near).select(
        "mc_id", (F.col("n") * wt).alias("n"), F.transform("ls", lambda v: v * wt).alias("ls"),
        F.transform("ss", lambda v: v * wt).alias("ss"), (F.col("lst") * wt).alias("lst"),
        (F.col("sst") * wt).alias("sst"), F.col("t").alias("t_max"), (F.col("dist") * F.col("dist") * wt).alias("sq_err"))


def fold_decaying(points: DataFrame, model: DataFrame, *, eps: float, lam: float, factor: float = 1.0,
                  kinds: tuple[str, ...] = ("p", "o"), x: str = "x", t: str = "t",
                  limits: Limits = LIMITS) -> DataFrame:
    """Trial-insert rows into decaying clusters and add up the takers, decayed to each task's latest time.

    Rejected rows have kind NULL and mc_id -1, weight 1 at their own time.
    """
    columns = model.select("mc_id", "kind", "w", "ls", "ss", F.col("t_last").cast("double").alias("t_last"),
                           summary.centroid("w", "ls").alias("centre"))
    blocks = {}
    for kind in kinds:
        block = one_block(columns.filter(F.col("kind") == kind).drop("kind"), "mc_id", limits)
        if block is None:
            return _fold_decaying_large(points, model, eps, lam, factor, kinds, x, t, limits)
        if len(block):
            blocks[kind] = block
    shared = points.sparkSession.sparkContext.broadcast(blocks)

    def emit(kind, ids, w, ls, ss, t0, last):
        n = len(ids)
        return pa.RecordBatch.from_arrays(
            [pa.array([kind] * n, pa.string()), pa.array(ids, pa.int64()), pa.array(w), list_column(ls), list_column(ss),
             pa.array(t0.astype(np.int64)), pa.array(last.astype(np.int64))],
            names=[f.name for f in DECAYED_ROW.fields])

    def run(batches):
        models = shared.value
        acc, anchor = {}, -np.inf
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = vector_matrix(batch.column("x"))
            when = batch.column("t").to_numpy(zero_copy_only=False).astype(float)
            top = max(anchor, when.max())
            if np.isfinite(anchor) and top > anchor:
                fade = np.exp2(-lam * (top - anchor))
                for sums in acc.values():
                    for a in sums[:3]:
                        a *= fade
            anchor = top
            open_rows = np.arange(len(rows))
            for kind, b in models.items():
                if not len(open_rows):
                    break
                part = rows[open_rows]
                idx, _ = nearest(part, b)
                ok = trial_radius(part, when[open_rows] - b["t_last"][idx], b["w"][idx], b["ls"][idx], b["ss"][idx],
                                  lam, factor) <= eps
                if ok.any():
                    i, r, tm = idx[ok], part[ok], when[open_rows[ok]]
                    q = len(b)
                    if kind not in acc:
                        acc[kind] = [np.zeros(q), np.zeros((q, rows.shape[1])), np.zeros((q, rows.shape[1])), np.full(q, np.inf)]
                    f = np.exp2(-lam * (anchor - tm))
                    sums = acc[kind]
                    fr = r * f[:, None]
                    sums[0] += np.bincount(i, weights=f, minlength=q)
                    sums[1] += _group_sums(i, fr, q)
                    sums[2] += _group_sums(i, fr * r, q)
                    np.minimum.at(sums[3], i, tm)
                open_rows = open_rows[~ok]
            if len(open_rows):
                r, tm = rows[open_rows], when[open_rows]
                yield emit(None, np.full(len(r), NONE), np.ones(len(r)), r, r * r, tm, tm)
        for kind, (w, ls, ss, t0) in acc.items():
            hit = np.isfinite(t0)
            ids = models[kind]["mc_id"][hit]
            yield emit(kind, ids, w[hit], ls[hit], ss[hit], t0[hit], np.full(hit.sum(), anchor))

    return points.select(F.col(x).alias("x"), F.col(t).alias("t")).mapInArrow(run, DECAYED_ROW)


def _fold_decaying_large(points, model, eps, lam, factor, kinds, x, t, limits) -> DataFrame:
    base = points.select(F.col(x).alias("x"), F.col(t).cast("long").alias("t"))
    hit = assign_decaying(base, model, eps=eps, lam=lam, factor=factor, kinds=kinds, limits=limits)
    return hit.select("kind", "mc_id", F.lit(1.0).alias("w"), F.col("x").alias("ls"),
                      F.transform("x", lambda v: v * v).alias("ss"), F.col("t").alias("t0"), F.col("t").alias("t_last"))
