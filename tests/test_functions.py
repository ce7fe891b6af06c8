from statistics import NormalDist

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidepool.functions import summary, vec
from tidepool.functions.normal import normal_quantile
from tidepool.operators import rows
from tidepool.sources import text


def test_normal_quantile(spark):
    ps = [1e-12, 1e-6, 0.001, 0.07, 0.0751, 0.25, 0.5, 0.7, 0.925, 0.99, 0.999999]
    df = spark.createDataFrame([(p,) for p in ps], "p double").select("p", normal_quantile(F.col("p")).alias("z"))
    for p, z in df.collect():
        assert z == pytest.approx(NormalDist().inv_cdf(p), abs=1e-10)


def test_radii(spark):
    x = np.array([[0.0, 0.0], [2.0, 0.0], [4.0, 6.0]])
    df = spark.createDataFrame([(3.0, x.sum(0).tolist(), (x * x).sum(0).tolist())], "n double, ls array<double>, ss array<double>")
    r = df.select(summary.spread_radius(factor=2.0), summary.widest_radius("n"), summary.rmse(), summary.sphere_radius()).first()
    var = x.var(axis=0)
    assert r[0] == pytest.approx(2 * np.sqrt(var.sum()))
    assert r[1] == pytest.approx(np.sqrt(var.max()))
    assert r[2] == pytest.approx(np.sqrt(var.sum()))
    assert r[3] == pytest.approx(np.sqrt(var.sum()))


def test_single_point_has_infinite_radius(spark):
    df = spark.createDataFrame([(1.0, [3.0], [9.0])], "n double, ls array<double>, ss array<double>")
    assert df.select(summary.spread_radius()).first()[0] > 1e300


def test_check_period():
    assert summary.check_period(0.25, 0.85, 25) == 1
    assert summary.check_period(0.01, 0.3, 10) == 42
    with pytest.raises(ValueError):
        summary.check_period(0.25, 0.05, 10)


def test_sparse_algebra_matches_dense(spark):
    df = spark.createDataFrame([("1:0.5,3:2", [1.0, 2.0, 3.0])], "s string, a array<double>").withColumn("m", text.parse_sparse("s"))
    r = df.select(vec.to_dense("m", 3).alias("d"), vec.sparse_dense_dot("m", "a").alias("dot"),
                  vec.sparse_dense_distance("m", "a").alias("dist"),
                  vec.sparse_distance("m", vec.to_sparse("a")).alias("dist2"),
                  vec.to_dense(vec.sparse_add("m", vec.to_sparse("a")), 3).alias("sum"), vec.sparse_element("m", 1).alias("gap")).first()
    d, a = np.array([0.5, 0, 2]), np.array([1.0, 2, 3])
    assert r["d"] == d.tolist() and r["gap"] == 0.0
    assert r["dot"] == pytest.approx(d @ a)
    assert r["dist"] == r["dist2"] == pytest.approx(np.linalg.norm(d - a))
    assert r["sum"] == (d + a).tolist()


def test_null_vector_is_infinitely_far(spark):
    df = spark.createDataFrame([(None, [1.0])], "a array<double>, b array<double>")
    assert df.select(vec.distance("a", "b")).first()[0] > 1e300


def test_examples_of_one_two_three_tokens(spark):
    df = spark.createDataFrame([("1,2",), ("0 1,2",), ("0 1,2 2.5",)], "value string")
    out = [tuple(r) for r in text.parse_examples(df).select("x", "y", "weight").collect()]
    assert out == [([1.0, 2.0], None, 1.0), ([1.0, 2.0], [0.0], 1.0), ([1.0, 2.0], [0.0], 2.5)]


BAD = ["% comment", "@attribute a", "", "1,2,3", "4,5", "6,7,99"]


def test_labelled_rows_skip_and_fail(spark):
    df = spark.createDataFrame([(v,) for v in BAD], "value string")
    assert text.infer_width(df) == 3
    good = text.labelled_rows(df, 3, on_bad="drop").collect()
    assert [(r["x"], r["class"]) for r in good] == [([1.0, 2.0], 3)]
    assert {r["bad"] for r in text.bad_labelled_rows(df, 3).collect()} == {"cardinality 2", "class out of range"}
    with pytest.raises(PySparkException, match="bad labelled row"):
        text.labelled_rows(df, 3).collect()
    flat = text.labelled_rows(spark.createDataFrame([("1;2",)], "value string"), 2, sep=";", has_class=False).first()
    assert (flat["x"], flat["class"]) == ([1.0, 2.0], 0)
    with pytest.raises(PySparkException):
        text.labelled_rows(spark.createDataFrame([("1,9",)], "value string"), 2, n_classes=8).collect()


def test_row_numbers_follow_the_order(spark):
    df = spark.range(1000).select((999 - F.col("id")).alias("v"))
    out = rows.number_rows(df, ["v"]).collect()
    assert all(r["v"] == r["idx"] for r in out) and len(out) == 1000


def test_replay_wraps_and_stops(spark):
    df = spark.range(10)
    out = sorted((r["row"], r["id"], r["tick"], r["slot"]) for r in rows.replay_stamp(df, ["id"], interval=4, partitions=3, count=25).collect())
    assert out == [(i, i % 10, i // 4, i % 3) for i in range(25)]
    assert rows.replay_stamp(df, ["id"], count=7).count() == 7


def test_weighted_draw_follows_the_weights(spark):
    df = spark.createDataFrame([(1, 70.0), (2, 20.0), (3, 10.0), (4, 0.0)], "id int, w double")
    got = {r["id"]: r["copies"] for r in rows.draw_weighted(df, "w", 1000, ["id"], seed=3).collect()}
    assert sum(got.values()) == 1000 and 4 not in got
    assert abs(got[1] - 700) <= 2 and abs(got[2] - 200) <= 2


def test_slices_and_samples(spark):
    df = spark.range(100)
    assert sorted(r["id"] for r in rows.row_slice(df, ["id"], 10, 15).collect()) == [10, 11, 12, 13, 14]
    assert sorted(r["id"] for r in rows.last_rows(df, ["id"], 3).collect()) == [97, 98, 99]
    one = {r["id"] for r in rows.sample_fixed(df, 10, ["id"], 1).collect()}
    assert one == {r["id"] for r in rows.sample_fixed(df.repartition(7), 10, ["id"], 1).collect()} and len(one) == 10
    assert rows.sample_to_fill(df, 1000).count() == 100
