import math
from dataclasses import replace
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidepool.operators import coreset as cs
from tidepool.operators import feature_tree, kmeans, settle, snapshots
from tidepool.plans import clustream as cl
from tidepool.plans import clustree, streamkm
from tidepool.plans import denstream as de
from tidepool.plans import streaming_kmeans as sk
from tidepool.session import Limits
from tidepool.streaming import keyed


def timed(spark, x, t):
    return spark.createDataFrame([(v.tolist(), int(k)) for v, k in zip(x, t)], "x array<double>, t long")


# ---- the sequential rules, restated plainly ----------------------------------------------------------


def plain_slots(model, left, now, m, horizon, factor, recheck):
    """model: list of dicts n, ls, ss, lst, sst; left: list of (t, x) in order."""
    model = [dict(r) for r in model]

    def centre(r):
        return r["ls"] / max(r["n"], 1e-300)

    def radius(i):
        r = model[i]
        if r["n"] > 1:
            var = np.maximum(r["ss"] / r["n"] - (r["ls"] / r["n"]) ** 2, 1e-50)
            return factor * math.sqrt(var.sum())
        return min(np.linalg.norm(centre(model[j]) - centre(r)) for j in range(len(model)) if j != i and model[j]["n"] > 0)

    def stamp(r):
        if r["n"] == 0:
            return -math.inf
        mu = r["lst"] / r["n"]
        if r["n"] < 2 * m:
            return mu
        return mu + math.sqrt(max(r["sst"] / r["n"] - mu * mu, 0)) * NormalDist().inv_cdf(1 - m / (2 * r["n"]))

    fresh = []
    for t, x in left:
        one = {"n": 1.0, "ls": x.copy(), "ss": x * x, "lst": t, "sst": t * t}
        if recheck and fresh:
            i = min(fresh, key=lambda j: np.linalg.norm(centre(model[j]) - x))
            if np.linalg.norm(centre(model[i]) - x) <= radius(i):
                model[i] = {k: model[i][k] + one[k] for k in one}
                continue
        old = [i for i, r in enumerate(model) if i not in fresh and stamp(r) < now - horizon]
        if old:
            slot = min(old, key=lambda i: (stamp(model[i]), i))
        else:
            a, slot = min(((i, j) for i in range(len(model)) for j in range(i + 1, len(model))),
                          key=lambda p: np.linalg.norm(centre(model[p[0]]) - centre(model[p[1]])))
            model[a] = {k: model[a][k] + model[slot][k] for k in one}
            if a not in fresh:
                fresh.append(a)
        model[slot] = one
        if slot not in fresh:
            fresh.append(slot)
    return model


@pytest.mark.parametrize("recheck", [True, False])
def test_slots_follow_the_sequential_rule(recheck):
    rng = np.random.default_rng(7)
    q, d, m, horizon, factor, now = 12, 2, 3, 6.0, 2.0, 40.0
    model = []
    for i in range(q):
        n = int(rng.integers(1, 12))
        x, t = rng.normal(size=(n, d)) * 0.2 + rng.normal(size=d), rng.uniform(20, 38, n)
        model.append({"n": float(n), "ls": x.sum(0), "ss": (x * x).sum(0), "lst": t.sum(), "sst": (t * t).sum()})
    left = [(float(t), rng.normal(size=d) * 2) for t in np.sort(rng.uniform(30, 40, 120))]
    frame = pd.DataFrame([{"mc_id": i, **r, "ids": [i]} for i, r in enumerate(model)])
    slots = settle.Slots(frame, m, horizon, factor, now)
    for t, x in left:
        slots.settle((1.0, x, x * x, t, t * t), recheck, True)
    want = plain_slots(model, left, now, m, horizon, factor, recheck)
    assert slots.n.tolist() == [r["n"] for r in want]
    assert np.allclose(slots.ls, [r["ls"] for r in want]) and np.allclose(slots.sst, [r["sst"] for r in want])


def plain_born(rows, eps, lam):
    out = []
    for t, x in rows:
        if out:
            c = min(out, key=lambda r: np.linalg.norm(r["ls"] / r["w"] - x))
            f = 2 ** (-lam * (t - c["tl"]))
            w, ls, ss = c["w"] * f + 1, c["ls"] * f + x, c["ss"] * f + x * x
            if math.sqrt(max((ss / w - (ls / w) ** 2).max(), 0)) <= eps:
                c.update(w=w, ls=ls, ss=ss, tl=t)
                continue
        out.append({"w": 1.0, "ls": x, "ss": x * x, "t0": t, "tl": t})
    return out


def test_born_clusters_follow_the_sequential_rule(spark):
    rng = np.random.default_rng(8)
    x, t = rng.normal(size=(150, 2)), np.sort(rng.integers(0, 40, 150))
    order = np.lexsort((x[:, 1], x[:, 0], t))
    want = plain_born([(int(t[i]), x[i]) for i in order], 0.3, 0.05)
    df = spark.createDataFrame([(1.0, v.tolist(), (v * v).tolist(), int(k), int(k)) for v, k in zip(x, t)],
                               "w double, ls array<double>, ss array<double>, t0 long, t_last long").repartition(6)
    got = settle.settle_born(df, eps=0.3, lam=0.05, exact=True).collect()
    assert sorted(r["w"] for r in got) == pytest.approx(sorted(r["w"] for r in want))
    assert sorted(r["t0"] for r in got) == sorted(r["t0"] for r in want)


def test_condensing_conserves_weight_and_is_bounded(spark):
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.integers(-64, 64, (600, 2)) / 4096, rng.integers(-256, 256, (300, 2)) / 64])
    left = spark.createDataFrame([(1.0, v.tolist(), (v * v).tolist(), float(k % 7), float(k % 7) ** 2, float(k % 7))
                                  for k, v in enumerate(x)], settle.LEFT_OVER)
    out = settle.condense(left.repartition(9))
    n, s = out.agg(F.sum("n"), F.sum(F.col("ls")[0])).first()
    assert out.count() < 600 and n == 900 and s == x[:, 0].sum()
    # the same sums, whatever the layout
    assert sorted(map(str, out.collect())) == sorted(map(str, settle.condense(left.coalesce(1)).collect()))
    rows = spark.createDataFrame([(1.0, v.tolist(), (v * v).tolist(), 1, 1) for v in x], settle.BORN)
    born = [settle.settle_born(rows.repartition(k), eps=0.25, lam=0.125) for k in (1, 9)]
    assert born[0].agg(F.sum("w")).first()[0] == pytest.approx(900)
    assert sorted(map(str, born[0].collect())) == sorted(map(str, born[1].collect()))
    assert settle.shrink(out, 10, factor=2.0).agg(F.count("*"), F.sum("n")).first()[:] == (10, pytest.approx(900))
    wide = spark.createDataFrame([(1.0, v.tolist(), (v * v).tolist(), 1.0, 1.0, 1.0) for v in rng.normal(size=(200, 12))], settle.LEFT_OVER)
    assert settle.condense(wide).agg(F.sum("n")).first()[0] == 200
    assert settle.condense(left.limit(0)).count() == 0


@pytest.mark.parametrize("d", [2, 5])
def test_skewed_left_over_rows_are_settled_as_by_the_sequential_rule(spark, d):
    """Extreme rows and a very old tick do not widen the cells: groups far apart stay apart, whatever the range."""
    rng = np.random.default_rng(5)
    groups = rng.integers(-400, 400, (6, d)) / 4
    x = np.array([groups[k % 6] + rng.integers(-4, 4, d) / 1024 for k in range(60)] + [np.full(d, 1e6), np.full(d, -1e7)])
    t = [5 + k % 3 for k in range(60)] + [6, -10 ** 6]
    centres = 1000 + rng.integers(-40, 40, (14, d)) / 4
    params = cl.CluStreamParams(q=14, m=5, horizon=3.0)
    model = start(spark, centres).model.withColumns({"n": F.lit(8.0), "ls": F.expr("transform(ls, v -> 8 * v)"), "ss": F.expr("transform(ss, v -> 8 * v + 0.125)")})
    got, want = ({k: np.array([r["n"], *r["ls"]]) for k, r in enumerate(sorted(
        cl.step(cl.Clustering(model), timed(spark, x, t), replace(params, exact=exact)).model.filter("n > 0").select("n", "ls").collect()))} for exact in (False, True))
    assert len(got) == len(want) and all(np.allclose(got[k], want[k], rtol=1e-9) for k in want)


def test_cells_of_odd_numbers(spark):
    """Infinity and not a number are places of their own, and small batches of far-apart rows are not added up."""
    rows = [(1.0, [v, 0.0], [v * v, 0.0], 1.0, 1.0, 1.0) for v in (0.0, 0.5, 0.001, 1e300, float("inf"), float("nan"))]
    out = settle.condense(spark.createDataFrame(rows, settle.LEFT_OVER), width=0.25, span=1.0)
    assert sorted(r["n"] for r in out.collect()) == [1.0] * 4 + [2.0]


def test_step_is_the_same_for_every_limit_and_layout(spark):
    """No row count or layout switches to another rule."""
    rng = np.random.default_rng(31)
    x, t = rng.integers(-512, 512, (400, 2)) / 64, rng.integers(0, 10, 400)
    centres = rng.integers(-256, 256, (12, 2)) / 64
    params = cl.CluStreamParams(q=12, m=5, horizon=3.0)
    found = set()
    for limit, parts, batch in ((10, 1, 7), (10 ** 6, 16, 10_000), (35_000, 4, 100)):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        state = cl.step(start(spark, centres), timed(spark, x, t).repartition(parts), params, limits=Limits(fold_rows=limit))
        found.add(str(sorted(tuple(map(str, r)) for r in state.model.select("mc_id", "n", "ls", "lst").collect())))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(found) == 1


def test_unchecked_outliers_stay_alone(spark):
    rows = timed(spark, np.array([[0.0, 0.0], [0.0, 0.0], [0.01, 0.0]]), [1, 1, 1])
    init = de.init_kmeans(timed(spark, np.array([[9.0, 9.0], [9.0, 9.5]]), [0, 0]), 2)
    params = de.DenStreamParams(eps=0.5, mu=50, beta=0.5, lam=0.05, prune="never")
    alone = de.step(de.DecayingState(init), rows, replace(params, recheck=False)).model.filter("kind = 'o'").count()
    together = de.step(de.DecayingState(init), rows, params).model.filter("kind = 'o'").count()
    assert (alone, together) == (3, 1)
    with pytest.raises(ValueError):
        de.DenStreamParams(order="merged")


# ---- CluStream ---------------------------------------------------------------------------------------


def two_blobs(spark):
    rng = np.random.default_rng(10)
    x = np.concatenate([rng.normal(size=(20, 2)) * 0.1, rng.normal(size=(20, 2)) * 0.1 + 5, [[50.0, 50.0]]])
    t = np.concatenate([np.arange(20) % 4, np.arange(20) % 4, [3]])
    return x, t, timed(spark, x, t)


def start(spark, centres):
    df = spark.createDataFrame([(i, list(map(float, c))) for i, c in enumerate(centres)], "mc_id long, centre array<double>")
    return cl.Clustering(cl._model(df))


def test_clustream_two_blobs_and_an_outlier(spark):
    x, t, df = two_blobs(spark)
    params = cl.CluStreamParams(q=3, m=3, horizon=100)
    state = cl.step(start(spark, [[0, 0], [5, 5], [0, 6]]), df, params)
    model = {r["mc_id"]: r for r in state.model.collect()}
    assert len(model) == 3 and state.rows == 41 and state.clock == 3
    assert sum(r["n"] for r in model.values()) == pytest.approx(44)
    far = [r for r in model.values() if r["n"] == 1 and r["ls"] == [50.0, 50.0]]
    assert len(far) == 1
    again = cl.step(state, df.limit(0), params)
    assert again.model is state.model and again.batches == 2


def test_clustream_deletes_the_stale(spark):
    x, t, _ = two_blobs(spark)
    params = cl.CluStreamParams(q=3, m=3, horizon=5)
    state = start(spark, [[0, 0], [5, 5], [-40, -40]])
    state = cl.step(state, timed(spark, x[:40], t[:40] + 100), params)
    state = cl.step(state, timed(spark, np.array([[80.0, 80.0]]), [104]), params)
    model = {r["mc_id"]: r for r in state.model.collect()}
    assert model[2]["ls"] == [80.0, 80.0] and model[2]["ids"] == [3]


def test_clustream_weight_is_conserved_without_deletion(spark):
    rng = np.random.default_rng(11)
    x, t = rng.normal(size=(400, 3)), rng.integers(0, 10, 400)
    for order in cl.ORDERS:
        params = cl.CluStreamParams(q=20, m=5, horizon=1e9, order=order)
        state = start(spark, rng.normal(size=(20, 3)))
        state = cl.step(state, timed(spark, x, t).repartition(4), params)
        n, k = state.model.agg(F.sum("n"), F.count("*")).first()
        assert (n, k) == (pytest.approx(420), 20)
    small = cl.step(start(spark, rng.normal(size=(20, 3))), timed(spark, x, t).repartition(4),
                    cl.CluStreamParams(q=20, m=5, horizon=1e9), limits=Limits(fold_rows=60))
    assert small.model.agg(F.sum("n")).first()[0] == pytest.approx(420)


def test_clustream_is_invariant_to_row_order_and_layout(spark):
    rng = np.random.default_rng(12)
    x, t, c = rng.normal(size=(200, 2)), rng.integers(0, 10, 200), rng.normal(size=(10, 2))
    params = cl.CluStreamParams(q=10, m=5, horizon=4)
    p = rng.permutation(200)
    a = cl.step(start(spark, c), timed(spark, x, t).repartition(5), params).model.orderBy("mc_id").collect()
    b = cl.step(start(spark, c), timed(spark, x[p], t[p]).coalesce(1), params).model.orderBy("mc_id").collect()
    assert [r["n"] for r in a] == [r["n"] for r in b] and [r["ids"] for r in a] == [r["ids"] for r in b]


def test_clustream_initial_models(spark):
    rng = np.random.default_rng(13)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(100, 2)))], "id long, x array<double>")
    for model in (cl.init_kmeans(df, 5), cl.init_points(df, 5, ["id"]), cl.init_random(df, 5, d=2), cl.init_streaming_kmeans(df, 5, d=2)):
        rows = model.collect()
        assert len(rows) == 5 and all(r["n"] == 1.0 and len(r["ls"]) == 2 and r["ids"] == [r["mc_id"]] for r in rows)


def test_final_clusters_add_up(spark):
    x, t, df = two_blobs(spark)
    state = cl.step(start(spark, [[0, 0], [5, 5], [0, 6], [5, 0]]), df, cl.CluStreamParams(q=4, m=3, horizon=1e9))
    out = cl.final_clusters(state.model, 2)
    assert out.agg(F.sum("n")).first()[0] == pytest.approx(45)


# ---- DenStream ---------------------------------------------------------------------------------------


def test_denstream_grows_promotes_and_prunes(spark):
    rng = np.random.default_rng(14)
    blob = rng.normal(size=(60, 2)) * 0.1
    params = de.DenStreamParams(eps=0.5, mu=10, beta=0.3, lam=0.1)
    one = [(0, "p", 1.0, [0.0, 0.0], [0.0, 0.0], 0, 0)]
    state = de.DecayingState(spark.createDataFrame(one, de.DECAYING_CLUSTER))
    x = np.concatenate([blob, rng.normal(size=(40, 2)) * 0.1 + 9, [[-30.0, 0.0]]])
    state = de.step(state, timed(spark, x, np.full(len(x), 1)), params)
    rows = {tuple(np.round(np.array(r["ls"]) / r["w"]).astype(int)): r for r in state.model.collect()}
    assert rows[0, 0]["kind"] == "p" and rows[9, 9]["kind"] == "p" and rows[-30, 0]["kind"] == "o"
    assert rows[9, 9]["w"] == pytest.approx(40) and rows[-30, 0]["w"] == pytest.approx(1)
    later = de.step(state, timed(spark, blob, np.full(60, 80)), params)
    assert later.last_prune == 80 and later.model.count() == 1
    w = later.model.first()["w"]
    assert w == pytest.approx(61 * 2 ** (-0.1 * 79) + 60 - (1 - 2 ** -0.1) * 2 ** (-0.1 * 79), abs=0.2)
    bounds = de.prune(state.model, 1, params).collect()
    assert all(r["w"] >= params.p_floor for r in bounds if r["kind"] == "p")


def test_denstream_variants(spark):
    rng = np.random.default_rng(15)
    x, t = rng.normal(size=(200, 2)), rng.integers(1, 5, 200)
    init = de.init_kmeans(timed(spark, x, t), 3)
    base = de.DenStreamParams(eps=0.4, mu=5, beta=0.5, lam=0.05, prune="never")
    lone = de.step(de.DecayingState(init), timed(spark, x, t), base)
    total = lone.model.agg(F.sum("w")).first()[0]
    want = sum(2 ** (-0.05 * (4 - k)) for k in t) + 3 * 2 ** (-0.05 * 4)
    assert total == pytest.approx(want)
    flat = de.step(de.DecayingState(init), timed(spark, x, t), de.DenStreamParams(eps=0.4, mu=5, beta=0.5, lam=0.0001, prune="never", order="batch_time"))
    assert flat.clock == 10_000
    again = de.step(lone, timed(spark, x, t + 5), de.DenStreamParams(eps=0.4, mu=5, beta=0.5, lam=0.05, prune="never", reuse_old_outliers=False))
    assert again.model.count() >= lone.model.count()
    small = de.step(de.DecayingState(init), timed(spark, x, t).repartition(4), base, limits=Limits(fold_rows=20))
    assert small.model.agg(F.sum("w")).first()[0] == pytest.approx(want)
    assert small.model.select("mc_id").distinct().count() == small.model.count()


def test_denstream_initial_density(spark):
    rng = np.random.default_rng(16)
    x = np.concatenate([rng.normal(size=(50, 2)) * 0.1, rng.normal(size=(50, 2)) * 0.1 + 4, [[20.0, 20.0]]])
    model = de.init_dbscan(spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>"), 0.3, 5, d=2)
    rows = sorted(model.collect(), key=lambda r: r["ls"][0])
    assert [round(r["w"]) for r in rows] == [50, 50] and {r["kind"] for r in rows} == {"p"}
    final = de.final_clusters(model, 0.3, 5, d=2)
    assert final.count() == 2 and de.final_kmeans(model, 2).count() == 2


def test_prune_cadence():
    s = de.DecayingState(None, last_prune=10, batches=3)
    p = lambda mode: de.prune_due(s, 16, de.DenStreamParams(tp=8, prune=mode))
    assert [p(m) for m in de.PRUNE_MODES] == [False, True, True, True, False]


def test_clustree_entries_keep_all_weight(spark):
    rng = np.random.default_rng(17)
    x, t = rng.normal(size=(150, 2)), np.ones(150)
    from tidepool.schema import DECAYING_CLUSTER

    state = de.DecayingState(spark.createDataFrame([], DECAYING_CLUSTER))
    state = clustree.step(state, timed(spark, x, t), 0.4, 0.1)
    assert clustree.leaves(state.model).agg(F.sum("w")).first()[0] == pytest.approx(150)
    state = clustree.step(state, timed(spark, x, t + 10), 0.4, 0.1)
    assert state.model.agg(F.sum("w")).first()[0] == pytest.approx(150 + 75)
    assert clustree.alive(state.model, 1e9).count() == 0
    assert clustree.final_clusters(state.model, 0.4, 10.0, d=2).count() >= 1


# ---- k-means, coresets ---------------------------------------------------------------------------------

TOY = [[1, 2, 3, 4, 5, 6], [1, 2, 3, 4, 5, 7], [9, 8, 7, 6, 5, 4], [9, 8, 7, 6, 5, 5]]


def centres(spark, c):
    return spark.createDataFrame([(i, list(map(float, v))) for i, v in enumerate(c)], "mc_id long, centre array<double>")


def test_lloyd_on_the_toy_rows(spark):
    df = spark.createDataFrame([(i, list(map(float, v)), 1.0 + i) for i, v in enumerate(TOY)], "id long, x array<double>, weight double")
    out = {r["mc_id"]: r["centre"] for r in kmeans.lloyd(df, centres(spark, TOY[:2]), 4).collect()}
    assert out[0] == pytest.approx(np.mean(TOY[:2], axis=0)) or len(out) == 2
    w = kmeans.weighted_clusters(df, centres(spark, [TOY[0], TOY[2]]), 4).orderBy("cluster_id").collect()
    assert [r["weight"] for r in w] == [3.0, 7.0]
    assert w[1]["centre"][5] == pytest.approx((4 * 3 + 5 * 4) / 7)


def test_an_emptied_cluster_stays_out(spark):
    df = spark.createDataFrame([([0.0],), ([1.0],)], "x array<double>")
    out = kmeans.lloyd(df, centres(spark, [[0.0], [1.0], [99.0]]), 3)
    assert sorted(r["mc_id"] for r in out.collect()) == [0, 1]


def test_streaming_kmeans_equals_the_library(spark):
    from pyspark.mllib.clustering import StreamingKMeansModel

    rng = np.random.default_rng(18)
    c, w = rng.normal(size=(4, 3)), np.array([5.0, 0.0, 20.0, 1.0])
    c[1] = 100.0
    model = spark.createDataFrame([(i, c[i].tolist(), float(w[i])) for i in range(4)], "mc_id long, centre array<double>, weight double")
    lib = StreamingKMeansModel([v.tolist() for v in c], w.tolist())
    for _ in range(2):
        x = rng.normal(size=(80, 3))
        model = sk.update(model, spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>"), 0.7)
        lib = lib.update(spark.sparkContext.parallelize([v.tolist() for v in x], 3), 0.7, "batches")
    got = model.orderBy("mc_id").collect()
    assert [r["weight"] for r in got] == pytest.approx(list(lib.clusterWeights))
    assert np.allclose([r["centre"] for r in got], np.array([list(v) for v in lib.clusterCenters]))


def test_coreset_carries_all_weight_and_is_repeatable(spark):
    rng = np.random.default_rng(19)
    x = np.concatenate([rng.normal(size=(3000, 2)) * 0.1 + c for c in ([0, 0], [5, 5], [0, 9])])
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>").repartition(6).cache()
    out = cs.coreset(df, 60, seed=4, limits=Limits(fold_rows=150))
    n, w = out.agg(F.count("*"), F.sum("weight")).first()
    assert n <= 60 and w == pytest.approx(9000)
    assert sorted(map(tuple, cs.coreset(df, 60, seed=4, limits=Limits(fold_rows=150)).select(F.col("x")[0], "weight").collect())) == \
        sorted(map(tuple, out.select(F.col("x")[0], "weight").collect()))
    params = streamkm.StreamKMParams(k=3, size=60, window=9000, iterations=20)
    state = streamkm.BucketState(streamkm.empty_buckets(spark))
    for i in range(3):
        state = streamkm.step(state, df.filter(F.pmod(F.xxhash64("x"), F.lit(3)) == i), params)
    assert state.model.agg(F.sum("weight")).first()[0] == pytest.approx(9000)
    assert state.model.groupBy("level").count().agg(F.max("count")).first()[0] <= 60
    final = streamkm.final_clusters(state.model, params).collect()
    assert sum(r["weight"] for r in final) == pytest.approx(9000)


# ---- snapshots -------------------------------------------------------------------------------------------


def test_pyramid_against_a_replay_of_writes_and_deletes(spark):
    kept, ticks = set(), spark.range(1, 65).withColumnRenamed("id", "tick")
    for t in range(1, 65):
        kept.add(t)
        i = 0
        while t % 2 ** (i + 1) == 0:
            i += 1
        kept.discard(t - 5 * 2 ** (i + 1))
        if t in (1, 13, 40, 64):
            got = {r["tick"] for r in snapshots.kept_ticks(ticks, F.lit(t)).collect()}
            assert got == {k for k in kept if k <= t}


def test_pick(spark):
    ticks = spark.createDataFrame([(t,) for t in (4, 8, 10, 11)], "tick long")
    assert tuple(snapshots.pick(ticks, 10, 3).first()) == (10, 4)
    assert tuple(snapshots.pick(ticks, 5, 3).first()) == (4, 4)
    assert tuple(snapshots.pick(ticks, 3, 3).first()) == (-1, -1)


def test_snapshots_on_disk_and_horizon(spark, tmp_path):
    folder = f"file://{tmp_path}/snaps"
    for t in range(1, 17):
        ids = [[1, 2]] if t > 8 else [[1], [2]]
        rows = [(i, float(t) * len(v), [float(t)], [1.0], 1.0, 1.0, v) for i, v in enumerate(ids)]
        snapshots.save(spark.createDataFrame(rows, cl.MICRO_CLUSTER), folder, t)
    got = {r["tick"] for r in snapshots.saved_ticks(spark, folder).collect()}
    want = {r["tick"] for r in snapshots.kept_ticks(spark.range(1, 17).withColumnRenamed("id", "tick"), F.lit(16)).collect()}
    assert got == want
    recent = snapshots.horizon_query(spark, folder, 16, 8).collect()
    assert [r["n"] for r in recent] == [32.0 - 16.0]


# ---- bounded left-over sums --------------------------------------------------------------------


def _left(spark, x, t):
    """Single rows as left-over features."""
    rows = [(1.0, v.tolist(), (v * v).tolist(), float(s), float(s) ** 2, float(s)) for v, s in zip(x, t)]
    return spark.createDataFrame(rows, settle.LEFT_OVER)


@pytest.mark.parametrize("d", [3, 64])
def test_left_over_sums_are_bounded_in_every_dimension(spark, d):
    draw = np.random.default_rng(d)
    for x in (draw.integers(-64, 64, (6000, d)) / 64, draw.integers(0, 4, (12, d))[draw.integers(0, 12, 6000)] + draw.integers(-8, 8, (6000, d)) / 64):
        left = _left(spark, x, draw.integers(0, 40, 6000))
        out = feature_tree.bounded(left, 100, rows=6000, width=0.25, pace=0.01).collect()
        assert 1 < len(out) <= 100
        assert sum(r.n for r in out) == 6000 and max(r.t for r in out) == 39
        assert np.allclose(sum(np.array(r.ls) for r in out), x.sum(axis=0)) and np.allclose(sum(np.array(r.ss) for r in out), (x * x).sum(axis=0))
        again = feature_tree.bounded(left.repartition(7), 100, rows=6000, width=0.25, pace=0.01).collect()
        assert sorted(map(str, again)) == sorted(map(str, out))


def test_few_left_over_sums_stay_as_they_are(spark):
    left = _left(spark, np.eye(3), [1, 2, 3])
    assert sorted(map(str, feature_tree.bounded(left, 3).collect())) == sorted(map(str, left.collect()))
    assert feature_tree.bounded(left.limit(0), 3).count() == 0


def test_tree_keeps_separate_places_and_times_apart():
    draw = np.random.default_rng(4)
    place, tick = draw.integers(0, 10, 5000), draw.integers(0, 2, 5000) * 1000.0
    x = place[:, None] * 50.0 + draw.normal(size=(5000, 2))
    f = np.column_stack([np.ones(5000), tick, tick ** 2, tick, x, x * x])
    tree = feature_tree.FeatureTree(20, 2, pace=1.0)
    tree.feed(f)
    out = tree.finish()
    assert len(out) == 20 and sorted(out[:, 0]) == sorted(np.bincount(place * 2 + (tick > 0).astype(int)))
    same = feature_tree.FeatureTree(5, 2)
    same.feed(np.tile([1.0, 0, 0, 0, 2.0, 3.0, 4.0, 9.0], (3000, 1)))
    assert len(same.finish()) == 1
    odd = feature_tree._grow(5, 0.0)([pa.RecordBatch.from_pylist([{"n": 1.0, "ls": [v, 1.0], "ss": [1.0, 1.0], "lst": 0.0, "sst": 0.0, "t": 0.0}
                                                                  for v in [float("nan"), float("inf")] + [float(k) for k in range(30)]])])
    got = pa.Table.from_batches(odd)
    assert got.num_rows <= 6 and sum(got["n"].to_pylist()) == 32


@pytest.mark.parametrize("d", [3, 64])
def test_bounded_settling_is_close_to_row_by_row(spark, d):
    """Fresh seeds have no radius; the rows stand around few places: both ways find the same clusters there."""
    draw = np.random.default_rng(d)
    seeds = spark.createDataFrame([(i, (np.full(d, 100.0 + 5 * i)).tolist()) for i in range(12)], "mc_id long, centre array<double>")
    model = cl._model(seeds)
    place = draw.integers(0, 6, 1500)
    x = place[:, None] * -40.0 + draw.integers(-32, 32, (1500, d)) / 256
    left = _left(spark, x, draw.integers(10_000, 10_010, 1500))
    how = dict(now=10_010.0, m=50, horizon=80.0, factor=2.0)
    found = {}
    for name, out in (("exact", settle.settle_in_slots(model, left, exact=True, **how)),
                      ("bounded", settle.settle_in_slots(model, left, most=40, **how))):
        rows = [r for r in out.collect() if r.ls[0] / r.n < 50]
        found[name] = {p: (sum(r.n for r in rows if round(r.ls[0] / r.n / -40) == p),
                           sum(np.array(r.ls) for r in rows if round(r.ls[0] / r.n / -40) == p).tolist()) for p in range(6)}
    assert found["bounded"] == found["exact"] and sum(n for n, _ in found["exact"].values()) == 1500


def test_merging_models_of_many_keys_is_bounded(spark):
    draw = np.random.default_rng(9)
    x = draw.integers(-500, 500, (3000, 5)) / 4
    models = spark.createDataFrame([(i, 2.0, (2 * v).tolist(), (2 * v * v).tolist(), 4.0, 8.0) for i, v in enumerate(x)],
                                   "mc_id long, n double, ls array<double>, ss array<double>, lst double, sst double")
    out = keyed.merge_models(models, 20, most=100).collect()
    assert len(out) == 20 and sum(r.n for r in out) == 6000 and sum(r.lst for r in out) == 12_000
    assert np.allclose(sum(np.array(r.ls) for r in out), 2 * x.sum(axis=0))


def test_trees_are_laid_out_for_the_sums(spark, monkeypatch):
    """A million left-over rows behind a few sums ask for one task of trees, not for a share of a million."""
    from tidepool.operators import settle

    seen, plain = [], settle.bounded
    monkeypatch.setattr(settle, "bounded", lambda left, most, rows=None, **kw: seen.append(rows) or plain(left, most, rows=rows, **kw))
    model = spark.createDataFrame([(i, 2.0, [float(2 * i)], [2.0 * i * i + 0.5], 0.0, 0.0, [i]) for i in range(4)],
                                  "mc_id long, n double, ls array<double>, ss array<double>, lst double, sst double, ids array<long>")
    left = spark.createDataFrame([(1.0, [50.0 + i % 3 * 50], [(50.0 + i % 3 * 50) ** 2], 9.0, 81.0, 9.0) for i in range(60)],
                                 "n double, ls array<double>, ss array<double>, lst double, sst double, t double")
    out = settle.settle_in_slots(model, left, now=9.0, m=10, horizon=1.0, factor=2.0, most=5, rows=1_000_000).collect()
    assert seen == [6] and sorted(r["n"] for r in out) == [2.0, 20.0, 20.0, 20.0]
