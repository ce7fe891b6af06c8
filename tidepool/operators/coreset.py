"""Weighted coresets by merge and reduce.

Every task keeps a stack of coresets, at most one of size m per level, like the digits of a
binary counter: two of a level are reduced to one of the next.  The tasks' stacks are reduced
again on fewer tasks until one coreset is left.  Total weight is conserved throughout.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators.blocks import list_column, vector_matrix
from tidepool.schema import CORESET
from tidepool.session import LIMITS, Limits, cut_lineage, ship_package


BASE = 16


def reduce_points(x: np.ndarray, w: np.ndarray, m: int, rng: np.random.Generator):
    """m weighted representatives by a tree of splits.

    Start with one group around a drawn point.  Split the group drawn in proportion to its
    cost at a member drawn in proportion to its squared distance, until there are m groups.
    """
    if len(x) <= m:
        return x, w
    def draw(mass):
        running = np.cumsum(mass)
        return min(int(np.searchsorted(running, rng.random() * running[-1], side="right")), len(mass) - 1)

    centres = [draw(w)]
    d2 = ((x - x[centres[0]]) ** 2).sum(axis=1)
    members = [np.arange(len(x))]
    costs = np.zeros(m)
    costs[0] = (w * d2).sum()
    while len(centres) < m:
        k = len(centres)
        if costs[:k].sum() <= 0:
            break
        leaf = draw(costs[:k])
        idx = members[leaf]
        share = w[idx] * d2[idx]
        if share.sum() <= 0:
            costs[leaf] = 0.0
            continue
        new = int(idx[draw(share)])
        d_new = ((x[idx] - x[new]) ** 2).sum(axis=1)
        moves = d_new < d2[idx]
        d2[idx[moves]] = d_new[moves]
        stay, gone = idx[~moves], idx[moves]
        members[leaf] = stay
        members.append(gone)
        centres.append(new)
        costs[leaf], costs[k] = (w[stay] * d2[stay]).sum(), (w[gone] * d2[gone]).sum()
    keep = [i for i, idx in enumerate(members) if len(idx)]
    return x[[centres[i] for i in keep]], np.array([w[members[i]].sum() for i in keep])


class Buckets:
    """Levels of coresets of size m; level counts are capped at ``levels``, the last keeps merging.

    Incoming rows are gathered ``BASE`` coreset sizes at a time before the first reduction.
    """

    def __init__(self, m: int, levels: int, rng: np.random.Generator):
        self.m, self.levels, self.rng = m, levels, rng
        self.full: dict[int, tuple] = {}
        self.x, self.w, self.size = [], [], 0

    def feed(self, x, w):
        lo = 0
        while lo < len(x):
            take = min(len(x) - lo, BASE * self.m - self.size)
            self.x.append(x[lo:lo + take])
            self.w.append(w[lo:lo + take])
            self.size += take
            lo += take
            if self.size == BASE * self.m:
                piece = (np.concatenate(self.x), np.concatenate(self.w))
                self.x, self.w, self.size = [], [], 0
                self.carry(0, reduce_points(*piece, self.m, self.rng))

    def carry(self, level, piece):
        while level in self.full:
            other = self.full.pop(level)
            x, w = np.concatenate([other[0], piece[0]]), np.concatenate([other[1], piece[1]])
            piece = reduce_points(x, w, self.m, self.rng)
            level = min(level + 1, self.levels - 1)
        self.full[level] = piece

    def parts(self):
        out = [(level, x, w) for level, (x, w) in sorted(self.full.items())]
        if self.size:
            out.append((0, np.concatenate(self.x), np.concatenate(self.w)))
        return out


def levels_for(window: int, m: int) -> int:
    return max(2, int(np.ceil(np.log2(max(window / m, 1.0)))) + 2)


def _emit(parts):
    for level, x, w in parts:
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(x), level, np.int32)), list_column(x), pa.array(w)], names=[f.name for f in CORESET.fields])


def _fold(rows: DataFrame, m: int, levels: int, seed: int, final: bool) -> DataFrame:
    def run(batches):
        ctx = TaskContext.get()
        rng = np.random.default_rng([seed, ctx.partitionId() if ctx else 0])
        buckets = Buckets(m, levels, rng)
        for batch in batches:
            if batch.num_rows:
                buckets.feed(vector_matrix(batch.column("x")), batch.column("weight").to_numpy(zero_copy_only=False))
        parts = buckets.parts()
        if final and parts:
            x, w = np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts])
            parts = [(parts[-1][0], *reduce_points(x, w, m, rng))]
        yield from _emit(parts)

    ship_package(rows.sparkSession)
    return rows.select("x", "weight").mapInArrow(run, CORESET)


def coreset(points: DataFrame, m: int, *, x: str = "x", weight: str | None = None, window: int = 1_100_000, seed: int = 0,
            limits: Limits = LIMITS) -> DataFrame:
    """(level, x, weight): at most m weighted rows standing for all points."""
    levels = levels_for(window, m)
    rows = points.select(F.col(x).alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("weight"))
    work = cut_lineage(_fold(rows, m, levels, seed, True))
    bound = max(limits.fold_rows, 2 * m)
    count, rounds = work.count(), 0
    while count > bound:
        rounds += 1
        tasks = max(1, count // bound)
        work = cut_lineage(_fold(work.repartition(tasks, F.xxhash64("x", "weight")).sortWithinPartitions("x", "weight"),
                                 m, levels, seed + rounds, True))
        count = work.count()
    return cut_lineage(_fold(work.coalesce(1).sortWithinPartitions("x", "weight"), m, levels, seed + rounds + 1, True))


def carry_in(state: DataFrame, batch_coreset: DataFrame, m: int, *, window: int = 1_100_000, seed: int = 0) -> DataFrame:
    """The bucket table after one batch's coreset is added at level 0 (at most levels * m rows)."""
    ship_package(state.sparkSession)
    levels = levels_for(window, m)
    both = state.withColumn("new", F.lit(False)).unionByName(
        batch_coreset.withColumns({"new": F.lit(True), "level": F.lit(0).cast("int")}))

    def run(pdf):
        import pandas as pd

        buckets = Buckets(m, levels, np.random.default_rng(seed))
        pdf = pdf.assign(_k=pdf["x"].map(tuple)).sort_values(["new", "level", "_k", "weight"])
        for (new, level), part in pdf.groupby(["new", "level"], sort=True):
            piece = (np.array(part["x"].tolist(), dtype=float), part["weight"].to_numpy(float))
            if new:
                buckets.carry(0, piece)
            else:
                buckets.full[int(level)] = piece
        return pd.concat([pd.DataFrame({"level": np.full(len(x), lv, np.int32), "x": list(x), "weight": w})
                          for lv, x, w in buckets.parts()], ignore_index=True)

    return both.groupBy(F.lit(1).alias("_k1")).applyInPandas(lambda pdf: run(pdf.drop(columns="_k1", errors="ignore")), CORESET)


def extract(state: DataFrame, m: int, *, seed: int = 0) -> DataFrame:
    """One coreset of at most m rows from all levels of the bucket table."""
    return cut_lineage(_fold(state.coalesce(1).sortWithinPartitions("level", "x", "weight"), m, 64, seed, True))
