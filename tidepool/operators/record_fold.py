"""Folding records one by one: every record of a task meets the model its predecessor left.

A task walks through its records in time order (ties by place) and keeps a copy of the model.  The nearest cluster takes the record if it lies
within the cluster's radius; else the stalest cluster that has expired is given up for it, or the two closest clusters become one
and the record takes the free slot.  The clock is the latest time seen so far.

What a task hands on is not its copy but its changes: per slot, which clusters of the common model went into it and the sums of the
records it took.  Changes of many tasks therefore add up, and the common model counts once:

* clusters that any task joined are joined;
* a cluster is given up if some task gave it up and none gave it a record;
* new clusters stay apart, and if more than q are left the closest ones are merged, by trees of features first where there are many.

With one task the result is that of the sequential rule.  With several it depends on which rows share a task, but counts and sums are
conserved whenever nothing expires.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.blocks import list_column, squared_distances, vector_matrix
from tidepool.operators.cf import cf_merge
from tidepool.operators.components import connected_components
from tidepool.operators.feature_tree import bounded
from tidepool.operators.fold import one_block
from tidepool.operators.settle import Slots
from tidepool.schema import CLUSTER_FEATURE
from tidepool.session import LIMITS, Limits, cut_lineage, ship_package, width_of

FEATURES = [f.name for f in CLUSTER_FEATURE]
FEW = 7  # dimensions up to which plain numbers beat arrays
CHANGE = T.StructType([T.StructField("task", T.LongType()), T.StructField("slot", T.LongType()),
                       T.StructField("origins", T.ArrayType(T.LongType())), *CLUSTER_FEATURE, T.StructField("t", T.DoubleType()),
                       T.StructField("met", T.LongType())])


class RecordSlots(Slots):
    """The model while records come in; ``ids`` holds the places of the clusters that went into a slot, ``more`` what records added.

    A record changes one or two slots: their centres at once, their stamps, radii and gaps when they are asked for.
    """

    def __init__(self, pdf, m: float, horizon: float, factor: float):
        super().__init__(pdf, m, horizon, factor, -math.inf)
        self.more = [np.zeros_like(a) for a in (self.n, self.ls, self.ss, self.lst, self.sst)]
        self.across = np.ascontiguousarray(self.centre.T)  # a row a dimension: differences of all centres at once
        self.across[:, self.n == 0] = np.inf
        self.radii: dict[int, float] = {}
        self.late, self.moved = set(), set()  # slots whose stamp, whose gaps are to be taken anew

    def _refresh(self, i):
        self.centre[i] = self.ls[i] / max(self.n[i], 1e-300)
        self.across[:, i] = self.centre[i] if self.n[i] != 0 else np.inf
        self.radii.pop(i, None)
        self.late.add(i)
        self.moved.add(i)

    def _radius(self, i):
        if not self.n[i] > 1:  # the gap to the nearest other centre, wherever that has moved
            return super()._radius(i)
        if i not in self.radii:
            n, ls, ss = float(self.n[i]), self.ls[i], self.ss[i]
            if len(ls) > FEW:
                self.radii[i] = super()._radius(i)
            else:  # the sums of ``spread``, without arrays
                var = [s / n - (v / n) * (v / n) for v, s in zip(ls.tolist(), ss.tolist())]
                self.radii[i] = self.factor * math.sqrt(sum(v if v > 1e-50 or v != v else 1e-50 for v in var))
        return self.radii[i]

    def _stale(self):
        for i in self.late:
            self.stamp[i] = self._stamp(i)
        self.late.clear()
        return super()._stale()

    def _closest(self):
        if self.gaps is not None:
            for i in self.moved:
                row = np.sqrt(squared_distances(self.centre[i:i + 1], self.centre)[0])
                row[self.n == 0] = np.inf
                row[i] = np.inf
                self.gaps[i, :] = self.gaps[:, i] = row
        self.moved.clear()
        return super()._closest()

    def _record(self, slot: int, row) -> None:
        self._add(slot, *row)
        for sums, value in zip(self.more, row):
            sums[slot] += value

    def take(self, x: np.ndarray, t: float) -> None:
        self.now = max(self.now, t)
        apart = self.across - x[:, None]
        apart *= apart
        d2 = apart.sum(axis=0)
        near = int(d2.argmin())
        row = (1.0, x, x * x, t, t * t)
        if math.isfinite(d2[near]) and math.sqrt(d2[near]) <= self._radius(near):
            self._record(near, row)
            return
        slot = self._stale()
        if slot is None:
            into, slot = self._closest()
            if into == slot or not np.isfinite(self.gaps[into, slot]):  # no second cluster
                self._record(near, row)
                return
            self._add(into, self.n[slot], self.ls[slot].copy(), self.ss[slot].copy(), self.lst[slot], self.sst[slot])
            self.ids[into] = self.ids[into] + self.ids[slot]
            for sums in self.more:
                sums[into] += sums[slot]
        self._put(slot, *row)
        self.ids[slot] = []
        for sums, value in zip(self.more, row):
            sums[slot] = value


def changes(points: DataFrame, model: DataFrame, *, m: float, horizon: float, factor: float, x: str = "x", t: str = "t",
            limits: Limits = LIMITS) -> DataFrame:
    """(task, slot, origins, sums, t, met): what the records of every task did to the model; ``t`` is the task's latest time and ``met``
    the number of its records, told with its first slot.

    Records without a time or with a component that is missing or not finite take no part.
    """
    ship_package(points.sparkSession)
    block = one_block(model.select("mc_id", *FEATURES), "mc_id", limits)
    if block is None or len(block) == 0:
        raise ValueError("records are folded into a model of at least one cluster that fits one block")
    shared = points.sparkSession.sparkContext.broadcast(block)
    whole = F.forall("x", lambda v: v.isNotNull() & (F.abs(v) < math.inf))
    rows = (points.select(F.col(x).cast("array<double>").alias("x"), F.col(t).cast("double").alias("t"))
            .filter(F.col("x").isNotNull() & F.col("t").isNotNull() & whole).sortWithinPartitions("t", "x"))

    def run(batches):
        b, slots, met = shared.value, None, 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            if slots is None:
                columns = {k: list(b[k]) if b[k].ndim == 2 else b[k] for k in ("mc_id", *FEATURES)}
                slots = RecordSlots(pd.DataFrame(columns).assign(ids=[[i] for i in range(len(b))]), m, horizon, factor)
            for place, when in zip(vector_matrix(batch.column("x"), b["ls"].shape[1]), batch.column("t").to_numpy()):
                slots.take(place, float(when))
            met += batch.num_rows
        if slots is not None:
            k = len(slots.n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, TaskContext.get().partitionId())), pa.array(np.arange(k)),
                 pa.array([[int(b["mc_id"][i]) for i in ids] for ids in slots.ids], pa.list_(pa.int64())),
                 pa.array(slots.more[0]), list_column(slots.more[1]), list_column(slots.more[2]), pa.array(slots.more[3]),
                 pa.array(slots.more[4]), pa.array(np.full(k, slots.now)), pa.array([met] + [0] * (k - 1))],
                names=CHANGE.names)

    return rows.mapInArrow(run, CHANGE)


def apply_changes(model: DataFrame, parts: DataFrame, q: int, *, most: int = 1024) -> DataFrame:
    """The common model with the changes of all tasks: (mc_id, n, ls, ss, lst, sst), at most q clusters.  ``parts`` is read several times."""
    d = width_of(model, "ls")
    tasks = parts.agg(F.count_distinct("task").alias("tasks")).first()["tasks"]
    held = parts.select(F.explode("origins").alias("mc_id"), (F.col("n") > 0).alias("fed"))
    lost = held.groupBy("mc_id").agg(F.count("*").alias("held"), F.max("fed").alias("fed")).filter((F.col("held") == tasks) | F.col("fed"))
    base = model.join(lost.select("mc_id"), "mc_id", "left_semi").select("mc_id", *FEATURES)
    first = F.col("origins")[0]
    links = parts.filter(F.size("origins") > 1).select(first.alias("src"), F.explode(F.slice("origins", 2, 2 ** 31 - 1)).alias("dst")).distinct()
    label = connected_components(model.select(F.col("mc_id").alias("node")), links)
    label = label.select(F.col("node").alias("mc_id"), F.col("component").alias("to"))
    # A cluster without origins is new: it gets a number below all others, its own for every task and slot.
    own = -1 - (F.col("task") * F.lit(1 << 32) + F.col("slot"))
    took = (parts.filter("n > 0").withColumn("mc_id", F.when(F.size("origins") > 0, first).otherwise(own)).select("mc_id", *FEATURES))
    summed = cut_lineage(cf_merge(base.unionByName(took).join(label, "mc_id", "left").withColumn("mc_id", F.coalesce("to", "mc_id")), d=d))
    filled = summed.filter("n > 0").count()
    if filled > q:
        rows = summed.filter("n > 0").withColumn("t", F.col("lst") / F.col("n"))
        return join_closest(bounded(rows, max(most, q), rows=filled), q)
    order = F.struct((F.col("mc_id") < 0).alias("new"), F.abs("mc_id").alias("id"))
    ranked = F.sort_array(F.collect_list(F.struct(order.alias("o"), *FEATURES)))  # little more than q rows: empty ones are old ones
    listed = summed.agg(ranked.alias("all")).select(F.posexplode("all").alias("mc_id", "c"))
    return listed.select(F.col("mc_id").cast("long"), *[F.col(f"c.{f}").alias(f) for f in FEATURES])


def join_closest(features: DataFrame, q: int) -> DataFrame:
    """(mc_id, n, ls, ss, lst, sst): the closest pair becomes one until q are left, in one task; for a bounded number of features."""
    schema = T.StructType([T.StructField("mc_id", T.LongType()), *CLUSTER_FEATURE])

    def run(batches):
        table = pa.Table.from_batches(list(batches), None) if (batches := [b for b in batches if b.num_rows]) else None
        if table is None:
            return
        n, lst, sst = (table.column(c).to_numpy().copy() for c in ("n", "lst", "sst"))
        ls, ss = (vector_matrix(table.column(c)).copy() for c in ("ls", "ss"))
        keep = closest_joined(n, ls, ss, lst, sst, q)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(keep))), pa.array(n[keep]), list_column(ls[keep]), list_column(ss[keep]), pa.array(lst[keep]),
             pa.array(sst[keep])], names=schema.names)

    ordered = features.select(*FEATURES, "t").repartition(1).sortWithinPartitions("t", "ls", "n")
    return ordered.mapInArrow(run, schema)


def closest_joined(n, ls, ss, lst, sst, q: int) -> np.ndarray:
    """Add up the closest pairs in place until q rows are left; returns those rows (numpy)."""
    centre = ls / n[:, None]
    gaps = squared_distances(centre, centre)
    gaps[np.diag_indices(len(n))] = np.inf
    partner, low = gaps.argmin(axis=1), gaps.min(axis=1)
    alive = np.ones(len(n), bool)
    for _ in range(len(n) - q):
        i = int(np.argmin(low))
        a, b = sorted((i, int(partner[i])))
        for sums in (n, ls, ss, lst, sst):
            sums[a] += sums[b]
        alive[b] = False
        centre[a] = ls[a] / n[a]
        gaps[b, :] = gaps[:, b] = low[b] = np.inf
        row = squared_distances(centre[a:a + 1], centre)[0]
        row[~alive] = row[a] = np.inf
        gaps[a, :] = gaps[:, a] = row
        anew = np.flatnonzero(alive & ((partner == a) | (partner == b) | (row <= low)))
        anew = np.union1d(anew, [a])
        partner[anew], low[anew] = gaps[anew].argmin(axis=1), gaps[anew].min(axis=1)
    return np.flatnonzero(alive)
