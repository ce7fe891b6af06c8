import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.functions import grid as g
from tidepool.operators import dbscan, grid, pairs, pivots
from tidepool.operators.components import connected_components, forest
from tidepool.plans import dstream
from tidepool.session import Limits, cut_lineage


def find_all(n, edges):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in edges:
        ra, rb = find(a), find(b)
        if ra != rb:
            root[max(ra, rb)] = min(ra, rb)
    return [find(i) for i in range(n)]


@pytest.mark.parametrize("limits", [Limits(), Limits(block_rows=1)])
def test_components(spark, limits):
    rng = np.random.default_rng(1)
    edges = [tuple(map(int, e)) for e in rng.integers(0, 60, (45, 2))] + [(70 + i, 71 + i) for i in range(15)]
    want = find_all(100, edges)
    nodes = spark.range(100).withColumnRenamed("id", "node")
    e = spark.createDataFrame(edges, "src long, dst long")
    got = {r["node"]: r["component"] for r in connected_components(nodes, e, limits=limits).collect()}
    assert got == dict(enumerate(want))


def test_components_of_array_nodes(spark):
    cells = [[0, 0], [0, 1], [2, 2]]
    nodes = spark.createDataFrame([(c,) for c in cells], "node array<int>")
    e = spark.createDataFrame([(cells[0], cells[1])], "src array<int>, dst array<int>")
    got = {tuple(r["node"]): tuple(r["component"]) for r in connected_components(nodes, e).collect()}
    assert got == {(0, 0): (0, 0), (0, 1): (0, 0), (2, 2): (2, 2)}


def brute_dbscan(x, w, eps, mu):
    d2 = ((x[:, None] - x[None]) ** 2).sum(2)
    near = d2 < eps * eps
    core = near @ w - 1 > mu
    order = sorted(range(len(x)), key=lambda i: tuple(x[i]))
    rank = {i: r for r, i in enumerate(order)}
    comp = find_all(len(x), [(rank[i], rank[j]) for i in range(len(x)) for j in range(len(x)) if core[i] and core[j] and near[i, j]])
    out = {}
    for i in range(len(x)):
        if core[i]:
            out[tuple(x[i])] = tuple(x[order[comp[rank[i]]]])
        else:
            labels = [comp[rank[j]] for j in np.flatnonzero(near[i] & core)]
            if labels:
                out[tuple(x[i])] = tuple(x[order[min(labels)]])
    return out


@pytest.mark.parametrize("d", [1, 2, 3, 6])
def test_point_clusters_equal_brute_force(spark, d):
    rng = np.random.default_rng(d)
    blob = rng.normal(size=(60, d)) * 0.05
    crowd = rng.normal(size=(60, d)) * 0.05 + 0.35
    x = np.concatenate([blob, crowd, rng.uniform(-1, 1, (40, d))])
    x = np.concatenate([x, np.repeat(x[:3], 5, axis=0)])
    spots, w = np.unique(x, axis=0, return_counts=True)
    eps, mu = (0.12 if d < 6 else 0.25), 4
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    want = brute_dbscan(spots, w.astype(float), eps, mu)
    got = dbscan.cluster_points(df, eps, mu, d=d).collect()
    assert {tuple(r["x"]): tuple(r["cluster"]) for r in got} == want
    assert sum(r["w"] for r in got) == sum(k for s, k in zip(spots, w) if tuple(s) in want)
    places = df.groupBy("x").agg(F.count("*").cast("double").alias("w"))
    wide = dbscan._cluster_pivots(places, eps, mu, Limits())
    assert {tuple(r["x"]): tuple(r["cluster"]) for r in wide.collect()} == want


def test_rows_meet_at_pivots_in_parts(spark):
    """A crowd in one ring is dealt to parts; far rows, repeated and odd places; counts and labels as by comparing all."""
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(150, 9)) * 0.1, rng.normal(size=(150, 9)), [[1e6] * 9, [0.0] * 9]])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist(), float(i)) for i, v in zip(ids, x)], "id long, x array<double>, value double")
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) < 0.6
    where = pivots.choose(df, 0.6)
    for block in (7, 2048):
        mass = dict(pivots.meet(df, df, 0.6, where, "id long, mass double", pivots.mass_kernel, block=block).collect())
        assert mass == pytest.approx({int(i): float(near[i] @ ids) for i in ids})
        least = dict(pivots.meet(df.filter("id % 2 = 0"), df.filter("id % 3 = 0"), 0.6, where, "id long, least double", pivots.least_kernel,
                                 block=block).collect())
        assert least == {int(i): float(min(j for j in ids[near[i]] if j % 3 == 0)) for i in ids if i % 2 == 0 and (near[i] & (ids % 3 == 0)).any()}
    assert pivots.choose(df.limit(0), 0.6) is None
    odd = spark.createDataFrame([([float("nan")] * 5, 9.0), ([float("inf")] * 5, 9.0), ([0.0] * 5, 9.0)], "x array<double>, w double")
    assert [r.w for r in dbscan._cluster_pivots(odd, 1.0, 2, Limits()).collect()] == [9.0]
    assert dbscan._cluster_pivots(odd.limit(2), 1.0, 2, Limits()).count() == 0


def test_box_refinement_is_exact(spark, monkeypatch):
    monkeypatch.setattr(dbscan, "DIRECT_PAIRS", 0)
    rng = np.random.default_rng(9)
    x = rng.uniform(0, 1, (250, 2))
    df = spark.createDataFrame([(v.tolist(),) for v in x], "x array<double>")
    got = {tuple(r["x"]): tuple(r["cluster"]) for r in dbscan.cluster_points(df, 0.07, 3, d=2).collect()}
    assert got == brute_dbscan(x, np.ones(len(x)), 0.07, 3)


def chain(spark):
    rows = [(i, 5.0 if i == 2 else 1.0, 0.19 * i) for i in range(5)] + [(9, 1.0, 5.0), (10, 1.0, 8.0), (11, 1.0, 8.1)]
    return spark.createDataFrame([(i, w, [w * c], [w * c * c]) for i, w, c in rows], "mc_id long, w double, ls array<double>, ss array<double>")


def test_offline_needs_a_core_and_company(spark):
    comp = {r["mc_id"]: r["cluster_id"] for r in dbscan.macro_components(chain(spark), 0.1, 4.0).collect()}
    assert comp == {i: 0 for i in range(5)}
    macro = dbscan.offline_clusters(chain(spark), 0.1, 4.0, d=1).collect()
    assert [(r["cluster_id"], r["w"]) for r in macro] == [(0, 9.0)]
    alone = dbscan.offline_clusters(chain(spark), 0.1, 100.0, d=1)
    assert alone.count() == 8


def test_range_forest_in_blocks_connects_the_same(spark):
    rng = np.random.default_rng(3)
    c = rng.uniform(0, 1, (80, 2))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "mc_id long, centre array<double>")
    d2 = ((c[:, None] - c[None]) ** 2).sum(2)
    want = find_all(80, [(int(i), int(j)) for i, j in zip(*np.nonzero(d2 <= 0.01))])
    for limits in (Limits(), Limits(block_rows=9)):
        links = dbscan.range_forest(df, 0.1, limits=limits)
        got = connected_components(df.select(F.col("mc_id").alias("node")), links)
        assert {r["node"]: r["component"] for r in got.collect()} == dict(enumerate(want))


# ---- grid -----------------------------------------------------------------------------------------

L_CELLS = [((0, 0), 2), ((1, 0), 2), ((2, 0), 2), ((0, 1), 2), ((0, 2), 2), ((3, 0), 1), ((0, 3), 1), ((5, 5), 0), ((9, 9), 1)]


def grid_df(spark, cells):
    return spark.createDataFrame([(list(c), a) for c, a in cells], "cell array<int>, attr int")


def test_grid_clusters_of_an_l_shape(spark):
    out = {tuple(r["cell"]): tuple(r["cluster_id"]) for r in grid.grid_clusters(grid_df(spark, L_CELLS), 2).collect()}
    assert out == {c: (0, 0) for c, a in L_CELLS if a and c != (9, 9)}
    inside = grid.inside_flags(grid.grid_clusters(grid_df(spark, [((x, y), 2) for x in range(3) for y in range(3)]), 2), 2)
    assert [tuple(r["cell"]) for r in inside.filter("is_inside").collect()] == [(1, 1)]


def test_repair_splits_and_equals_a_full_rebuild(spark):
    before = cut_lineage(grid.grid_clusters(grid_df(spark, L_CELLS), 2))
    for new_attr in ({(0, 0): 0}, {(1, 0): 0, (5, 5): 2}, {(3, 0): 2, (9, 9): 2}, {}):
        now = [(c, new_attr.get(c, a)) for c, a in L_CELLS]
        table = grid_df(spark, now).join(before, "cell", "left").withColumn(
            "changed", F.concat_ws(",", F.col("cell").cast("array<string>")).isin([f"{a},{b}" for a, b in new_attr] or ["-"]))
        fixed = {tuple(r["cell"]): tuple(r["cluster_id"]) for r in grid.repair_clusters(table, 2).collect()}
        full = {tuple(r["cell"]): tuple(r["cluster_id"]) for r in grid.grid_clusters(grid_df(spark, now), 2).collect()}
        assert fixed == full


def test_transitional_cell_joins_the_larger_cluster(spark):
    cells = [((0, 0), 2), ((2, 0), 2), ((3, 0), 2), ((1, 0), 1)]
    out = {tuple(r["cell"]): tuple(r["cluster_id"]) for r in grid.grid_clusters(grid_df(spark, cells), 2).collect()}
    assert out[(1, 0)] == (2, 0)


def cells_of(state):
    return {tuple(r["cell"]): r for r in state.model.collect()}


def test_dstream_ticks_decay_remove_and_restore(spark):
    params = dstream.DStreamParams(gaps=(1.0, 1.0), lam=0.5, cm=3.0, cl=1.5, beta=9.0)
    pts = lambda *xy: spark.createDataFrame([(list(map(float, p)),) for p in xy], "x array<double>")
    state = dstream.GridState(dstream.empty_grid(spark))
    state = dstream.step(state, pts(*[(0.5, 0.5)] * 8, *[(1.5, 0.5)] * 8, (7.5, 7.5)), params)
    first = cells_of(state)
    assert first[0, 0]["density"] == 8.0 and first[0, 0]["attr"] == g.DENSE
    assert tuple(first[1, 0]["cluster_id"]) == (0, 0)
    state = dstream.step(state, pts(*[(0.5, 0.5)] * 4), params)
    second = cells_of(state)
    assert second[0, 0]["density"] == 8.0 and second[1, 0]["density"] == 4.0
    for _ in range(6):
        state = dstream.step(state, pts(*[(0.5, 0.5)] * 4), params)
    last = cells_of(state)
    gone = last[7, 7]
    assert gone["density"] is None and gone["t_removed"] is not None and gone["cluster_id"] is None
    assert (state.low, state.high) == ([0, 0], [7, 7])
    left = [dstream.forget(state.model, tick, params).filter("density IS NULL").count() for tick in (10 * gone["t_removed"] - 1, 10 * gone["t_removed"])]
    assert left[0] >= 1 and left[1] < left[0]
    state = dstream.step(state, pts((7.5, 7.5), (0.5, 0.5)), params)
    back = cells_of(state)[7, 7]
    assert back["density"] == 1.0 and back["t_removed"] == gone["t_removed"]


def test_truncation_is_toward_zero(spark):
    df = spark.createDataFrame([([-0.5, 1.9],)], "x array<double>")
    assert df.select(g.cell_of("x", [1.0, 1.0]).alias("c")).first()["c"] == [0, 1]


def test_a_wide_reach_meets_in_blocks(spark, monkeypatch):
    """Where rows would visit most pivots nothing is sent to rings, and what is found equals comparing all."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.normal(size=(120, 16)), rng.normal(size=(60, 16)) * 0.3 + 4])
    ids = np.arange(len(x))
    df = spark.createDataFrame([(int(i), v.tolist(), float(i)) for i, v in zip(ids, x)], "id long, x array<double>, value double")
    reach = 4.5
    near = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2)) < reach
    where = pivots.choose(df, reach)
    assert not where.exclude(pivots.BLOCKS)
    monkeypatch.setattr(pivots, "_place", None)
    monkeypatch.setattr(pairs, "LEAST_ROWS", 40)
    mass = dict(pivots.meet(df, df, reach, where, "id long, mass double", pivots.mass_kernel).collect())
    assert mass == {int(i): float(near[i] @ ids) for i in ids}
    least = dict(pivots.meet(df, df.filter("id % 7 = 3"), reach, where, "id long, least double", pivots.least_kernel).collect())
    assert least == {int(i): float(min(j for j in ids[near[i]] if j % 7 == 3)) for i in ids if (near[i] & (ids % 7 == 3)).any()}
    links = pivots.meet(df, df, reach, where, "src long, dst long", pivots.link_kernel).collect()
    a, b = (np.array(c) for c in zip(*links))
    i, j = np.nonzero(near)
    assert np.array_equal(forest(len(x), a, b), forest(len(x), i, j))
