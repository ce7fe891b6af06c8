import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import assign, cf, fold, neighbours
from tidepool.session import Limits, MAX_FLOAT

SMALL = Limits(block_rows=7)


def points_df(spark, x, t=None):
    t = np.zeros(len(x)) if t is None else t
    return spark.createDataFrame([(i, v.tolist(), int(tt)) for i, (v, tt) in enumerate(zip(x, t))], "id long, x array<double>, t long")


def centres_df(spark, c):
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "mc_id long, centre array<double>")


@pytest.mark.parametrize("d,q", [(2, 5), (3, 40), (20, 30)])
@pytest.mark.parametrize("limits", [Limits(), SMALL])
def test_nearest_all_paths(spark, d, q, limits):
    rng = np.random.default_rng(d * q)
    x, c = rng.normal(size=(200, d)), rng.normal(size=(q, d))
    got = {r["id"]: (r["mc_id"], r["dist"]) for r in assign.assign_nearest(points_df(spark, x), centres_df(spark, c), limits=limits).collect()}
    d2 = ((x[:, None] - c[None]) ** 2).sum(2)
    for i in range(200):
        assert got[i][0] == d2[i].argmin()
        assert got[i][1] == pytest.approx(np.sqrt(d2[i].min()))


def test_ties_go_to_the_smallest_id_and_null_is_lost(spark):
    c = np.array([[1.0], [-1.0], [1.0]] + [[50.0 + i] for i in range(40)])
    df = spark.createDataFrame([(1, [0.0]), (2, None), (3, [1.0])], "id long, x array<double>")
    for limits in (Limits(), SMALL):
        got = {r["id"]: (r["mc_id"], r["dist"]) for r in assign.assign_nearest(df, centres_df(spark, c), limits=limits).collect()}
        assert got == {1: (0, 1.0), 2: (-1, MAX_FLOAT), 3: (0, 0.0)}
    empty = assign.assign_nearest(df, centres_df(spark, c).limit(0)).collect()
    assert {r["mc_id"] for r in empty} == {-1}


def test_radius_of_a_singleton_is_the_nearest_other_centre(spark):
    model = spark.createDataFrame(
        [(0, 1.0, [0.0], [0.0]), (1, 4.0, [40.0], [404.0])], "mc_id long, n double, ls array<double>, ss array<double>")
    radii = {r["mc_id"]: r["radius"] for r in assign.absorb_radii(model, factor=2.0).collect()}
    assert radii[0] == pytest.approx(10.0) and radii[1] == pytest.approx(2.0)
    pts = points_df(spark, np.array([[4.0], [7.9], [8.1], [13.0]]))
    got = {r["id"]: r["mc_id"] for r in assign.assign_within_radius(pts, model).collect()}
    assert got == {0: 0, 1: -1, 2: 1, 3: -1}


def test_nearest_other_and_closest_pair_in_blocks(spark):
    rng = np.random.default_rng(1)
    c = rng.normal(size=(30, 3))
    df = centres_df(spark, c)
    d = np.sqrt(((c[:, None] - c[None]) ** 2).sum(2)) + np.diag([np.inf] * 30)
    for limits in (Limits(), SMALL):
        got = {r["mc_id"]: r["gap"] for r in assign.nearest_other_centre(df, df, limits=limits).collect()}
        assert all(got[i] == pytest.approx(d[i].min()) for i in range(30))
        pair = neighbours.closest_pair(df, limits=limits).first()
        a, b = sorted(divmod(int(d.argmin()), 30))
        assert (pair["id_a"], pair["id_b"]) == (a, b) and pair["gap"] == pytest.approx(d.min())


def test_knn_in_blocks(spark):
    rng = np.random.default_rng(2)
    x, cls = rng.normal(size=(60, 2)), rng.integers(0, 3, 60)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, cls))], "id long, x array<double>, class long")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) + np.diag([np.inf] * 60)
    for limits in (Limits(), SMALL):
        got = {(r["id"], r["class"]): r["kd"] for r in neighbours.knn_distances(df, df, 2, limits=limits).collect()}
        for i in range(60):
            for c in range(3):
                assert got[i, c] == pytest.approx(np.sort(d[i, cls == c])[:2].mean())


def test_fold_equals_assign_then_aggregate(spark):
    rng = np.random.default_rng(3)
    x, t, c = rng.normal(size=(500, 4)), rng.integers(0, 50, 500), rng.normal(size=(60, 4))
    pts, centres = points_df(spark, x, t).repartition(5), centres_df(spark, c).withColumn("radius", F.lit(1.0))
    hit = assign.assign_to_spheres(pts, centres)
    want = {r["mc_id"]: r for r in cf.cf_aggregate(hit, d=4).collect()}
    for limits in (Limits(), Limits(block_rows=20)):
        parts = fold.fold_rows(pts, centres, limits=limits)
        got = {r["mc_id"]: r for r in cf.cf_merge(parts, d=4, extra=(F.max("t_max").alias("t_max"),)).collect()}
        assert got.keys() == want.keys()
        for k in want:
            for f in ("n", "lst", "sst", "t_max"):
                assert got[k][f] == pytest.approx(want[k][f])
            assert got[k]["ls"] == pytest.approx(want[k]["ls"]) and got[k]["ss"] == pytest.approx(want[k]["ss"])
    assert sum(r["n"] for r in want.values()) == 500


def test_cf_is_additive_over_splits(spark):
    rng = np.random.default_rng(4)
    pts = points_df(spark, rng.normal(size=(300, 2)), rng.integers(0, 9, 300)).withColumn("mc_id", F.col("id") % 3)
    whole = cf.cf_aggregate(pts, d=2)
    parts = cf.cf_aggregate(pts.filter("id < 100"), d=2).unionByName(cf.cf_aggregate(pts.filter("id >= 100"), d=2))
    a = {r["mc_id"]: (r["n"], r["lst"], *r["ls"], *r["ss"]) for r in whole.collect()}
    b = {r["mc_id"]: (r["n"], r["lst"], *r["ls"], *r["ss"]) for r in cf.cf_merge(parts, d=2).collect()}
    assert all(a[k] == pytest.approx(b[k]) for k in a)


def sequential_decay(rows, lam):
    """Record by record: decay to the row's time (late rows included), then add."""
    w = ls = 0.0
    last = rows[0][0]
    for t, v in rows:
        f = 2.0 ** (-lam * (t - last))
        w, ls, last = w * f + 1, ls * f + v, t
    return w, ls, last


def test_decayed_sums_equal_the_sequential_fold_even_with_late_rows(spark):
    rows = [(5, 1.0), (5, 2.0), (3, 4.0), (6, 8.0)]
    df = spark.createDataFrame([(0, t, [v]) for t, v in rows], "mc_id long, t long, x array<double>")
    r = cf.decayed_cf(df, lam=0.5, d=1).first()
    w, ls, last = sequential_decay(rows, 0.5)
    assert (r["w"], r["ls"][0], r["t_last"]) == (pytest.approx(w), pytest.approx(ls), last)


def test_decay_over_long_spans_does_not_underflow(spark):
    df = spark.createDataFrame([(0, 0, [1.0]), (0, 10, [1.0]), (1, 10_000_000, [1.0])], "mc_id long, t long, x array<double>")
    got = {r["mc_id"]: r["w"] for r in cf.decayed_cf(df, lam=0.1, d=1).collect()}
    assert got == {0: pytest.approx(1.5), 1: pytest.approx(1.0)}


def test_batch_time_counts_without_decay(spark):
    df = points_df(spark, np.ones((4, 1)), [1, 2, 3, 4]).withColumn("mc_id", F.lit(7))
    r = cf.cf_batch_time(df, 10, d=1).first()
    assert (r["n"], r["lst"], r["sst"]) == (4.0, 40.0, 400.0)


@pytest.mark.parametrize("limits", [Limits(), Limits(block_rows=5)])
def test_trial_insertion(spark, limits):
    rng = np.random.default_rng(5)
    k, d, lam, eps = 12, 2, 0.1, 0.3
    members = [rng.normal(size=(6, d)) * 0.15 + rng.normal(size=d) for _ in range(k)]
    model = [(i, "p" if i % 2 else "o", 6.0, m.sum(0).tolist(), (m * m).sum(0).tolist(), 0, 10) for i, m in enumerate(members)]
    df = spark.createDataFrame(model, "mc_id long, kind string, w double, ls array<double>, ss array<double>, t0 long, t_last long")
    x, t = rng.normal(size=(200, d)), rng.integers(8, 15, 200)
    got = {r["id"]: (r["kind"], r["mc_id"]) for r in assign.assign_decaying(points_df(spark, x, t), df, eps=eps, lam=lam, limits=limits).collect()}

    def attempt(i, kind):
        pool = [m for m in model if m[1] == kind]
        near = min(pool, key=lambda m: (((np.array(m[3]) / m[2] - x[i]) ** 2).sum(), m[0]))
        f = 2 ** (-lam * (t[i] - near[6]))
        w, ls, ss = near[2] * f + 1, np.array(near[3]) * f + x[i], np.array(near[4]) * f + x[i] ** 2
        r = np.sqrt(max((ss / w - (ls / w) ** 2).max(), 0))
        return near[0] if w > 1 and r <= eps else None

    for i in range(200):
        p = attempt(i, "p")
        want = ("p", p) if p is not None else ("o", o) if (o := attempt(i, "o")) is not None else (None, -1)
        assert got[i] == want
    parts = fold.fold_decaying(points_df(spark, x, t).repartition(3), df, eps=eps, lam=lam, limits=limits)
    merged = {r["mc_id"]: r["w"] for r in cf.decayed_merge(parts, F.lit(14), lam, d=d).collect()}
    for mc in set(v[1] for v in got.values()):
        want = sum(2 ** (-lam * (14 - t[i])) for i in range(200) if got[i][1] == mc)
        assert merged[mc] == pytest.approx(want)


def test_centroid_index_equals_the_flat_lookup_with_fewer_distances():
    from tidepool.operators import centroid_index
    from tidepool.operators.blocks import Block, nearest_index

    rng = np.random.default_rng(11)
    blobs = rng.normal(size=(50, 20)) * 5
    narrow = blobs[rng.integers(0, 50, 10_000)] + rng.normal(size=(10_000, 20)) * 0.3
    whole = rng.integers(0, 70, (10_000, 2)).astype(float)  # repeated centres and ties
    for c, x in [(rng.random((10_000, 3)), rng.random((9_000, 3))), (narrow, narrow[:3000] + 0.01), (whole, whole[:3000] + 0.5)]:
        index = centroid_index.build(c)
        flat, far = nearest_index(x, c)
        idx, d2, counted = centroid_index.search(x, c, index)
        assert (idx == flat).all() and np.allclose(d2, far, rtol=1e-12, atol=0)
        assert counted * 5 < len(x) * len(c)
        assert (centroid_index.nearest(x, Block({"centre": c}, index))[0] == flat).all()


def test_centroid_index_with_equal_missing_and_scattered_centres():
    from tidepool.operators import centroid_index
    from tidepool.operators.blocks import Block, nearest_index

    rng = np.random.default_rng(12)
    holes = rng.random((900, 2))
    holes[::3] = np.nan
    for c in (np.ones((800, 2)), holes, rng.normal(size=(800, 64)), rng.random((900, 2)) * 1e-7 + 1e6):
        x = np.vstack([rng.random((300, c.shape[1])) * 2, c[1:4], np.full((1, c.shape[1]), np.nan)])
        flat, far = nearest_index(x, c)
        idx, d2 = centroid_index.nearest(x, Block({"centre": c}, centroid_index.build(c)))
        lost = ~np.isfinite(far)
        assert (lost == ~np.isfinite(d2)).all() and (idx == flat)[~lost].all() and np.allclose(d2[~lost], far[~lost])
    assert centroid_index.build(np.full((5, 2), np.nan)) is None


def test_indexed_lookup_on_rows_and_in_the_fold(spark):
    rng = np.random.default_rng(13)
    x, c = rng.random((400, 3)), rng.random((700, 3))
    pts, centres = points_df(spark, x), centres_df(spark, c)
    rows = []
    for limits in (Limits(index_rows=10), Limits(index_rows=10 ** 9), Limits(index_rows=10, block_rows=300)):
        near = {r["id"]: r["mc_id"] for r in assign.assign_nearest(pts, centres, limits=limits).collect()}
        sums = fold.fold_rows(pts, centres, limits=limits).groupBy("mc_id").agg(F.sum("n").alias("n"))
        rows.append((near, {r["mc_id"]: r["n"] for r in sums.collect()}))
    assert rows[0] == rows[1] == rows[2]


def test_many_blocks_are_visited_in_one_pass(spark):
    """A model of several blocks costs one Python worker a task, whatever their number; ids, ties and odd places as with one block."""
    rng = np.random.default_rng(3)
    c = np.round(rng.normal(size=(300, 2)), 1)
    centres = spark.createDataFrame([(int(i), v.tolist(), float(i) / 2) for i, v in zip(rng.permutation(300), c)] + [(900, None, 1.0), (901, [float("nan"), 0.0], 1.0)],
                                    "mc_id long, centre array<double>, size double")
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.round(rng.normal(size=(200, 2)) * 2, 1))] + [(900, None), (901, [float("inf"), 0.0])],
                                   "id long, x array<double>")
    one = assign.assign_nearest(points, centres, carry=("size",))
    many = assign.assign_nearest(points, centres, carry=("size",), limits=Limits(block_rows=40))
    plan = many._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1
    read = lambda df: {r["id"]: (r["mc_id"], r["dist"], r["size"] if r["mc_id"] >= 0 else None) for r in df.collect()}
    assert read(one) == read(many)
