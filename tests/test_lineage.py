import numpy as np

from tidepool.operators import snapshots

SCHEMA = "mc_id long, n double, ls array<double>, ss array<double>, lst double, sst double, ids array<bigint>"


def frame(spark, model):
    return spark.createDataFrame([(i, n, [v], [v * v], t, t * t, ids) for i, (n, v, t, ids) in enumerate(model)], SCHEMA)


def links(newer, older):
    return {(i, j) for i, a in enumerate(newer) for j, b in enumerate(older) if set(a[3]) & set(b[3])}


def test_a_thousand_merging_batches_keep_the_model_small(spark):
    rng = np.random.default_rng(5)
    full = [(1.0, 1.0, 0.0, [i]) for i in range(12)]
    slim, next_id, kept = list(full), 12, {}
    for tick in range(1, 1001):
        a, b = sorted(rng.choice(12, 2, replace=False))
        for model in (full, slim):
            (n, v, t, ids), (m, w, u, more) = model[a], model[b]
            model[a] = (n + m, v + w, t + u, ids + more)
            model[b] = (1.0, float(tick), float(tick), [next_id])
        next_id += 1
        if tick % 125 == 0:  # the snapshots a pyramid keeps are fewer
            older = [(t, i, ids) for t, (_, s) in kept.items() for i, (*_, ids) in enumerate(s)]
            pruned = snapshots.prune_lineage(frame(spark, slim), spark.createDataFrame(older, "tick long, mc_id long, ids array<bigint>"))
            ids = {r["mc_id"]: r["ids"] for r in pruned.collect()}
            slim = [(*c[:3], ids[i]) for i, c in enumerate(slim)]
            assert max(map(max, ids.values())) == next_id - 1
            assert sum(map(len, ids.values())) <= 12 * (len(kept) + 1)
            kept[tick] = (list(full), list(slim))
            for t in sorted(kept)[:-3]:
                del kept[t]
    assert sum(len(c[3]) for c in full) > 500 and sum(len(c[3]) for c in slim) <= 12 * 4
    for old_full, old_slim in kept.values():
        assert links(full, old_full) == links(slim, old_slim)
    tick = min(kept)
    got, want = (sorted(map(tuple, snapshots.horizon_features(frame(spark, new), frame(spark, old)).select("mc_id", "n", "lst").collect()))
                 for new, old in ((slim, kept[tick][1]), (full, kept[tick][0])))
    assert got == want and want


def test_pruning_without_snapshots_and_without_ids(spark):
    model = frame(spark, [(2.0, 1.0, 0.0, [3, 1]), (1.0, 1.0, 0.0, []), (1.0, 1.0, 0.0, None)])
    none = spark.createDataFrame([], "tick long, mc_id long, ids array<bigint>")
    got = {r["mc_id"]: r["ids"] for r in snapshots.prune_lineage(model, none).collect()}
    assert got == {0: [3], 1: [], 2: None}
    assert snapshots.prune_lineage(model, none).columns == model.columns
