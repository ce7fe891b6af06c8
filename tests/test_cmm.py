import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepool.operators import cmm
from tidepool.session import Limits
from tidepool.streaming import jobs


def frame(spark):
    pts = [(0, [0.0, 0.0], 0), (1, [1.0, 0.0], 0), (2, [0.0, 1.0], 0), (3, [10.0, 10.0], 1), (4, [11.0, 10.0], 1),
           (5, [10.0, 11.0], 1), (6, [0.3, 0.3], -1), (7, [30.0, 0.0], -1), (8, [1.2, 1.2], 1)]
    return pts, spark.createDataFrame(pts, "id long, x array<double>, class long")


def test_parts_by_hand(spark):
    pts, df = frame(spark)
    spheres = spark.createDataFrame(
        [(0, [0.4, 0.4], 1.3, 4.0), (1, [10.0, 10.0], 1.0, 3.0), (2, [30.0, 0.0], 1.0, 1.0), (3, [50.0, 50.0], 1.0, 0.0)],
        "cluster_id long, centre array<double>, radius double, weight double")
    out = cmm.evaluate(df, spheres, d=2)
    match = {r["cluster_id"]: r["match"] for r in out.matches.collect()}
    assert match == {0: 0, 1: 1, 2: -1, 3: -1}
    x = {i: np.array(v) for i, v, _ in pts}

    def kd(i, members):
        d = sorted(np.linalg.norm(x[i] - x[j]) for j in members if j != i)
        return float(np.mean(d[:2]))

    zero, one = [0, 1, 2], [3, 4, 5, 8]
    k0, k1 = [kd(i, zero) for i in zero], [kd(i, one) for i in one]
    up = {0: np.mean(k0) + np.std(k0), 1: np.mean(k1) + np.std(k1)}
    conn = {i: min(1.0, up[c] / kd(i, m)) for c, m in ((0, zero), (1, one)) for i in m}
    rows = {r["id"]: r for r in out.points.collect()}
    for i in conn:
        assert rows[i]["conn"] == pytest.approx(conn[i])
    assert all(rows[i]["err"] == 0 for i in (0, 1, 2, 3, 4, 5))
    # Point 8 (class 1) lies in the sphere matched to class 0, outside the class's own sphere.
    c0 = np.mean([x[i] for i in zero], axis=0)
    inside = np.linalg.norm(x[8] - c0) <= max(np.linalg.norm(x[i] - c0) for i in zero)
    apart = 1 - min(1.0, up[0] / kd(8, zero))
    want8 = 1e-5 if inside or apart == 0 else conn[8] * apart
    assert rows[8]["err"] == pytest.approx(want8)
    assert rows[6]["err"] == pytest.approx(1e-5) and rows[7]["err"] == 1.0
    total = sum(r["err"] for r in rows.values())
    score = out.result.first()
    assert score["cmm"] == pytest.approx(1 - total / (sum(conn.values()) + 2))
    assert score["noise"] == pytest.approx(1 - (1e-5 + 1.0) / 2)
    assert score["cmm_basic"] == pytest.approx(1 - 3 / 9) and score["ca_separability"] == 1.0


def test_missed_points_pay_by_hull_distance(spark):
    pts, df = frame(spark)
    spheres = spark.createDataFrame([(0, [0.0, 0.0], 0.5, 1.0)], "cluster_id long, centre array<double>, radius double, weight double")
    out = cmm.evaluate(df, spheres, d=2)
    rows = {r["id"]: r for r in out.points.collect()}
    assert rows[1]["err"] == pytest.approx(rows[1]["conn"] * (1 - math.exp(-(1 - 0.5) / (1 + 0.5))))
    assert rows[3]["err"] == pytest.approx(rows[3]["conn"] * (1 - math.exp(-1.0)))
    assert out.result.first()["missed"] < 1


def test_close_classes_merge_below_tau(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(30, 2)), rng.normal(size=(30, 2)), rng.normal(size=(30, 2)) + 40])
    df = spark.createDataFrame([(i, v.tolist(), i // 30) for i, v in enumerate(x)], "id long, x array<double>, class long")
    merged = {r["class"]: r["merged"] for r in cmm.merge_classes(df, cmm.CMMParams(tau=0.5)).collect()}
    assert merged == {0: 0, 1: 0, 2: 2}
    spheres = spark.createDataFrame([(0, [0.0, 0.0], 9.0, 1.0)], "cluster_id long, centre array<double>, radius double, weight double")
    out = cmm.evaluate(df, spheres, d=2, params=cmm.CMMParams(tau=0.5))
    assert out.result.first()["ca_separability"] == pytest.approx(2 / 3)
    assert {r["err"] for r in out.points.filter("class = 0").collect()} == {0.0}


def test_merged_lists_equal_lists_of_merged_points(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(rng.normal(size=(60, 3)), rng.integers(-1, 4, 60)))],
                               "id long, x array<double>, class long")
    names = spark.createDataFrame([(0, 0), (1, 0), (2, 2), (3, 2)], "class long, merged long")
    params = cmm.CMMParams()
    merged = {(r["id"], r["target"]): r["near"] for r in cmm.merged_near(cmm.class_near(df, params), names, params.k).collect()}
    plain = df.withColumn("class", F.when(F.col("class") >= 0, F.floor(F.col("class") / 2) * 2).otherwise(-1).cast("long"))
    assert merged == {(r["id"], r["target"]): r["near"] for r in cmm.class_near(plain, params).collect()}


def test_a_model_in_blocks_scores_the_same(spark):
    _, df = frame(spark)
    spheres = spark.createDataFrame([(i, [float(i % 4) * 3, float(i // 4) * 3], 2.0 + i % 3) for i in range(16)],
                                    "cluster_id long, centre array<double>, radius double")
    one = cmm.evaluate(df, spheres, d=2)
    many = cmm.evaluate(df, spheres, d=2, limits=Limits(block_rows=5))
    assert {tuple(r) for r in one.points.collect()} == {tuple(r) for r in many.points.collect()}
    assert one.result.first() == many.result.first()


def test_scores_at_the_end_of_a_job(spark):
    """Micro and macro clusters of a run on the last rows: perfect ones, one cluster for all, and one without weight."""
    rows = [(i, [float(i % 2) * 8 + (i % 5) * 0.1, (i % 3) * 0.1], i % 2, i) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, x array<double>, class long, t long")
    feature = (F.count("*").cast("double").alias("n"), F.array(F.sum(F.col("x")[0]), F.sum(F.col("x")[1])).alias("ls"),
               F.array(F.sum(F.col("x")[0] ** 2), F.sum(F.col("x")[1] ** 2)).alias("ss"))
    micro = df.groupBy(F.col("class").alias("mc_id")).agg(*feature).unionByName(
        spark.createDataFrame([(7, 0.0, [0.0, 0.0], [0.0, 0.0])], "mc_id long, n double, ls array<double>, ss array<double>"))
    macro = df.groupBy(F.lit(0).cast("long").alias("cluster_id")).agg(*feature)
    got = {r["level"]: r for r in jobs.score_run(df, ["t"], {"micro": micro, "macro": macro}, n=20).collect()}
    last = np.array([x for _, x, _, _ in rows])
    centres = np.array([last[np.arange(40) % 2 == c].mean(axis=0) for c in (0, 1)])
    gaps = ((last[20:, None] - centres[None]) ** 2).sum(axis=2)
    assert got["micro"]["clusters"] == 2 and got["micro"]["n_rows"] == got["macro"]["n_rows"] == 20
    assert got["micro"]["sse"] == pytest.approx(gaps.min(axis=1).sum())
    assert got["macro"]["sse"] == pytest.approx(((last[20:] - last.mean(axis=0)) ** 2).sum())
    assert got["micro"]["cmm"] > got["macro"]["cmm"] and got["micro"]["misplaced"] == 1.0


def test_a_large_window_meets_in_blocks(spark, monkeypatch):
    """Blocks of points meet blocks of the window: nothing is collected, and lists equal those of the plain sums, ties, repeated and missing keys included."""
    from tidepool.operators import neighbours, pairs

    rng = np.random.default_rng(8)
    x = np.round(rng.normal(size=(600, 16)), 1)
    x[300:340] = x[0]  # a crowd of copies
    x[7, 3], keys = np.inf, [i if i % 50 else None for i in range(600)]
    keys[21] = keys[22]
    rows = [(k, None if i == 11 else v.tolist(), i % 3) for i, (k, v) in enumerate(zip(keys, x))]
    df = spark.createDataFrame(rows, "id long, x array<double>, class long")
    want = []
    for i, (key, v, _) in enumerate(rows):
        for c in range(3):
            others = [j for j in range(600) if j % 3 == c and (key is None or keys[j] != key) and rows[j][1] is not None and j != 7]
            if v is not None and i != 7:
                want.append((key, c, tuple(sorted(np.sqrt(((x[others] - x[i]) ** 2).sum(axis=1)))[:2])))
    monkeypatch.setattr(neighbours, "WINDOW_ROWS", 100)
    monkeypatch.setattr(pairs, "LEAST_ROWS", 150)
    monkeypatch.setattr(neighbours, "read_blocks", None)  # no window in the driver
    got = [(r["id"], r["class"], tuple(r["near"])) for r in neighbours.near_lists(df, df, 2).collect()]
    order = lambda r: (r[0] is None, r[0] or 0, r[1], np.round(r[2], 9).tolist())
    got, want = sorted(got, key=order), sorted(want, key=order)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want], atol=1e-12)


def test_points_are_compared_once(spark):
    """Whatever reads the distances afterwards does not compare the points again."""
    _, df = frame(spark)
    kd = cmm.class_knn(df, cmm.CMMParams())
    plan = cmm.class_connections(cmm.connectivity(kd, cmm.class_limits(kd), cmm.CMMParams()))._jdf.queryExecution().toString()
    assert "MapInArrow" not in plan
