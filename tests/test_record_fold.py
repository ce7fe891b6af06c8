import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import record_fold
from tidepool.plans import clustream as cl


def start(spark, c, t=0.0):
    return cl._model(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "mc_id long, centre array<double>"), t)


def rows(spark, x, t, parts):
    made = spark.createDataFrame([(v.tolist(), float(w)) for v, w in zip(x, t)], "x array<double>, t double")
    return made.coalesce(1) if parts == 1 else made.repartition(parts)


def plain(centres, x, t, m, horizon, factor):
    """The sequential rule, restated: a list of [n, ls, ss, lst, sst] per slot."""
    model = [[1.0, c.copy(), c * c, 0.0, 0.0] for c in centres]

    def stamp(c):
        mean = c[3] / c[0]
        if c[0] < 2 * m:
            return mean
        return mean + math.sqrt(max(c[4] / c[0] - mean * mean, 0)) * NormalDist().inv_cdf(1 - m / (2 * c[0]))

    now = -math.inf
    for i in sorted(range(len(x)), key=lambda i: (t[i], tuple(x[i]))):
        now = max(now, t[i])
        place = [c[1] / c[0] for c in model]
        far = [((x[i] - p) ** 2).sum() for p in place]
        a = int(np.argmin(far))
        c = model[a]
        if c[0] > 1:
            radius = factor * math.sqrt(np.maximum(c[2] / c[0] - (c[1] / c[0]) ** 2, 1e-50).sum())
        else:
            radius = math.sqrt(min(((p - place[a]) ** 2).sum() for j, p in enumerate(place) if j != a))
        new = [1.0, x[i], x[i] ** 2, t[i], t[i] ** 2]
        if math.sqrt(far[a]) <= radius:
            model[a] = [u + v for u, v in zip(c, new)]
            continue
        old = [(stamp(c), j) for j, c in enumerate(model) if stamp(c) < now - horizon]
        if old:
            model[min(old)[1]] = new
            continue
        _, a, b = min((math.sqrt(((place[j] - place[k]) ** 2).sum()), j, k) for j in range(len(model)) for k in range(j + 1, len(model)))
        model[a] = [u + v for u, v in zip(model[a], model[b])]
        model[b] = new
    return model


@pytest.mark.parametrize("horizon,seed", [(1e9, 1), (30.0, 2), (8.0, 3)])
def test_one_task_equals_the_sequential_rule(spark, horizon, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 2)) * 4
    x = rng.normal(size=(8, 2))[rng.integers(0, 8, 300)] * 6 + rng.normal(size=(300, 2)) * 0.4
    t = rng.integers(1, 100, 300).astype(float)
    params = cl.CluStreamParams(q=6, m=5, horizon=horizon, t_factor=2.0)
    state = cl.record_step(cl.Clustering(start(spark, centres)), rows(spark, x, t, 1), params)
    got = sorted((r["n"], *r["ls"], *r["ss"], r["lst"], r["sst"]) for r in state.model.collect())
    want = sorted((c[0], *c[1], *c[2], c[3], c[4]) for c in plain(centres, x, t, 5, horizon, 2.0))
    assert np.allclose(got, want) and len(got) == 6
    assert state.rows == 300 and state.clock == t.max()


def test_many_tasks_conserve_counts_and_sums_and_keep_q(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(7, 3))
    x = rng.integers(-40, 40, (500, 3)) / 4.0
    t = rng.integers(0, 50, 500).astype(float)
    state = cl.Clustering(start(spark, np.round(centres * 4) / 4))
    for part in np.array_split(np.arange(500), 2):
        state = cl.record_step(state, rows(spark, x[part], t[part], 6), cl.CluStreamParams(q=7, m=5, horizon=1e9, t_factor=1.0))
    total = state.model.agg(F.sum("n"), F.sum("lst"), *[F.sum(F.col("ls")[j]) for j in range(3)], F.count("*")).first()
    assert total[0] == 507 and total[1] == t.sum() and total[5] == 7
    assert list(total[2:5]) == list(x.sum(axis=0) + (np.round(centres * 4) / 4).sum(axis=0))


def test_rows_without_place_or_time_and_empty_batches(spark):
    model = start(spark, np.array([[0.0], [10.0]]))
    params = cl.CluStreamParams.per_record(2)
    bad = spark.createDataFrame([(None, 1.0), ([1.0], None), ([None], 2.0), ([math.nan], 2.0), ([math.inf], 2.0)], "x array<double>, t double")
    state = cl.record_step(cl.Clustering(model), bad, params)
    assert state.rows == 0 and state.batches == 1 and state.model.count() == 2
    state = cl.record_step(state, bad.unionByName(spark.createDataFrame([([0.5], 3.0)], "x array<double>, t double")), params)
    assert state.rows == 1 and sorted(r["n"] for r in state.model.collect()) == [1.0, 2.0]


def test_the_closest_pairs_are_joined_first():
    place = np.array([[0.0], [0.0], [0.0], [5.0], [5.0], [20.0]])
    n, ls, ss, lst, sst = np.ones(6), place.copy(), place ** 2, np.zeros(6), np.zeros(6)
    keep = record_fold.closest_joined(n, ls, ss, lst, sst, 3)
    assert n[keep].tolist() == [3, 2, 1] and ls[keep, 0].tolist() == [0, 10, 20]


def test_a_record_touches_what_it_changes(spark, monkeypatch):
    """Records that clusters take ask for no stamps and no gaps; the result is that of taking everything anew."""
    import pandas as pd

    from tidepool.operators.settle import Slots

    rng = np.random.default_rng(2)
    x, t = rng.normal(size=(400, 3)) * 2, np.arange(400.0)
    c = rng.normal(size=(9, 3))
    frame = pd.DataFrame({"mc_id": range(9), "n": 1.0, "ls": list(c), "ss": list(c * c), "lst": 0.0, "sst": 0.0, "ids": [[i] for i in range(9)]})

    class Anew(record_fold.RecordSlots):
        def _refresh(self, i):
            super()._refresh(i)
            for j in range(len(self.n)):
                self.stamp[j] = self._stamp(j)
            self.gaps, self.radii = None, {}

        def _radius(self, i):
            return Slots._radius(self, i)

    for horizon in (60.0, 1e9):
        pair = [kind(frame, 20, horizon, 1.5) for kind in (record_fold.RecordSlots, Anew)]
        for slots in pair:
            for place, when in zip(x, t):
                slots.take(place, float(when))
        for name in ("n", "ls", "ss", "lst", "sst"):
            assert np.array_equal(*(getattr(s, name) for s in pair))
        assert pair[0].ids == pair[1].ids
    slots, asked = record_fold.RecordSlots(frame, 20, 1e9, 1.5), []
    monkeypatch.setattr(slots, "_stamp", lambda i: asked.append(i))
    for _ in range(20):
        slots.take(c[0], 1.0)
    assert not asked and slots.n[0] == 21
