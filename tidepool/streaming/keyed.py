"""One clustering per key, held in Spark's keyed state; models merged across keys afterwards.

Keys are the scale-out axis: each key's model lives in the state store of one task.  To train one
model over all rows, use a random key of a chosen width and merge the models.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tidepool.operators.blocks import nearest_index, nearest_other
from tidepool.operators.feature_tree import bounded
from tidepool.operators.settle import Slots, condense, radius_scale, shrink, spread
from tidepool.plans.clustream import CluStreamParams
from tidepool.session import ship_package

OUT = "key bigint, mc_id bigint, n double, ls array<double>, ss array<double>, lst double, sst double"
STATE = "n array<double>, ls array<double>, ss array<double>, lst array<double>, sst array<double>, now double"


def _empty(q: int, d: int):
    return [np.zeros(q), np.zeros((q, d)), np.zeros((q, d)), np.zeros(q), np.zeros(q)]


def fold_batch(model: list, now: float, chunks, params: CluStreamParams):
    """One key's batch: absorb against the model before the batch, settle the rest in time order.

    ``chunks`` yields (x, t) arrays.  How the rows are cut into chunks does not matter: all are held
    against the same model, and only rows that no cluster takes are kept until the end.
    """
    n, ls, ss, lst, sst = model
    live = np.flatnonzero(n > 0)
    centre = ls[live] / n[live, None]
    # A single member has no spread; its radius is the distance to the nearest other centre.
    radius = np.where(n[live] > 1, spread(np.maximum(n[live], 1), ls[live], ss[live], params.t_factor), nearest_other(centre))
    more = [np.zeros_like(a) for a in model]
    rest = []
    for x, t in chunks:
        now = max(now, float(t.max()))
        ok = np.zeros(len(x), bool)
        if len(live):
            idx, d2 = nearest_index(x, centre)
            ok = np.sqrt(d2) <= radius[idx]
            for acc, v in zip(more, (np.ones(len(x)), x, x * x, t, t * t)):
                np.add.at(acc, live[idx[ok]], v[ok])
        rest.append((x[~ok], t[~ok]))
    n, ls, ss, lst, sst = model = [a + b for a, b in zip(model, more)]
    x, t = (np.concatenate(c) for c in zip(*rest))
    if len(x):
        frame = pd.DataFrame({"mc_id": np.arange(len(n)), "n": n, "ls": list(ls), "ss": list(ss), "lst": lst, "sst": sst,
                              "ids": [[] for _ in n]})
        slots = Slots(frame, params.m, params.horizon, params.t_factor, now)
        for i in np.lexsort((*x.T[::-1], t)):
            slots.settle((1.0, x[i], x[i] * x[i], t[i], t[i] * t[i]), params.recheck, True)
        model = [slots.n, slots.ls, slots.ss, slots.lst, slots.sst]
    return model, now


def keyed_clustream(stream: DataFrame, key: str, params: CluStreamParams, *, x: str = "x", t: str = "t",
                    timeout: str = "10 seconds") -> DataFrame:
    """Streaming (key, micro-cluster) rows: each key's model after every batch that touched it.

    Under ``availableNow`` set ``spark.sql.streaming.noDataMicroBatches.enabled`` to false, since
    a processing-time timeout keeps asking for batches without data.
    """
    ship_package(stream.sparkSession)
    q = params.q
    span = int(timeout.split()[0]) * 1000

    def run(keys, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        model, now = None, 0.0
        if state.exists:
            n, ls, ss, lst, sst, now = state.get
            d = len(ls) // q
            model = [np.array(n), np.array(ls).reshape(q, d), np.array(ss).reshape(q, d), np.array(lst), np.array(sst)]
        chunks = ((np.array(pdf["x"].tolist(), float), pdf["t"].to_numpy(float)) for pdf in frames if len(pdf))
        if model is None:
            first = next(chunks)
            model, chunks = _empty(q, first[0].shape[1]), chain([first], chunks)
        model, now = fold_batch(model, now, chunks, params)
        n, ls, ss, lst, sst = model
        state.update((n.tolist(), ls.ravel().tolist(), ss.ravel().tolist(), lst.tolist(), sst.tolist(), float(now)))
        state.setTimeoutDuration(span)
        live = np.flatnonzero(n > 0)
        yield pd.DataFrame({"key": np.full(len(live), keys[0]), "mc_id": live, "n": n[live], "ls": list(ls[live]),
                            "ss": list(ss[live]), "lst": lst[live], "sst": sst[live]})

    rows = stream.select(F.col(key).cast("long").alias("key"), F.col(x).alias("x"), F.col(t).cast("double").alias("t"))
    return rows.groupBy("key").applyInPandasWithState(run, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout)


def random_key(points: DataFrame, width: int, seed: int = 0) -> DataFrame:
    """Spread rows over ``width`` models."""
    return points.withColumn("key", F.floor(F.rand(seed) * width).cast("long"))


def merge_models(models: DataFrame, q: int, *, factor: float = 2.0, most: int = 4096) -> DataFrame:
    """One model of at most q clusters from many: nearest clusters are merged, counts conserved.

    Close clusters are added up by cells, then trees of features merge level by level until ``most`` are left; only these
    meet in the task that brings them to q.
    """
    rows = models.filter("n > 0").select("n", "ls", "ss", "lst", "sst", (F.col("lst") / F.col("n")).alias("t"))
    width = radius_scale(rows, factor)
    close = condense(rows, width=width) if width else rows
    return shrink(bounded(close, max(most, q), width=width or 0.0), q, factor=factor)
