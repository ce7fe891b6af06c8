"""Clustering Mapping Measure: how well found spheres explain a labelled evaluation window.

The window is the feature's own bound (the last rows of a stream); it reaches the tasks in
blocks and no pairs are ever emitted: a point keeps its k nearest distances to each class and
the classes whose spheres hold it, a sphere the number of points of each class.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import summary
from tidepool.operators.blocks import map_batches, read_blocks, squared_distances, vector_matrix
from tidepool.operators.evaluate import cluster_centroids, sse_given
from tidepool.operators.neighbours import mean_of, merge_lists, near_lists
from tidepool.operators.rows import small_side
from tidepool.session import LIMITS, Limits, cut_lineage

# Fixed values of the measure.
NEIGHBOURS = 2
TOP_CONNECTIONS = 2
MIN_ERROR = 1e-5
FLAT = 1e-50
EXP_REFERENCE_VALUE, EXP_REFERENCE_X = 0.01, 4.0


@dataclass(frozen=True)
class CMMParams:
    k: int = NEIGHBOURS
    tau: float = 1.0
    lam_missed: float = 1.0
    noise: int = -1
    exponential: bool = False


def spheres_of(clusters: DataFrame, *, cluster_id: str = "cluster_id", n: str = "n") -> DataFrame:
    """(cluster_id, centre, radius, weight) of cluster features."""
    return clusters.select(
        F.col(cluster_id).cast("long").alias("cluster_id"), summary.centroid(n, "ls").alias("centre"),
        summary.sphere_radius(n, "ls", "ss").alias("radius"), F.col(n).alias("weight"))


def class_spheres(points: DataFrame, *, d: int, limits: Limits = LIMITS) -> DataFrame:
    """(class, centre, radius): mean of the class, distance to its farthest member."""
    means = cluster_centroids(points, cluster="class", d=d).select("class", "centre")
    own = points.join(small_side(means), "class")
    d2 = sum(((F.col("x")[j] - F.col("centre")[j]) * (F.col("x")[j] - F.col("centre")[j]) for j in range(1, d)),
             (F.col("x")[0] - F.col("centre")[0]) * (F.col("x")[0] - F.col("centre")[0]))
    radii = own.groupBy("class").agg(F.sqrt(F.max(d2)).alias("radius"))
    return means.join(radii, "class")


def _hits(batch, block: dict):
    """Slices of a batch with the spheres its rows lie in, (first row, rows x spheres)."""
    rows = vector_matrix(batch.column("x"), block["centre"].shape[1])
    step = max(1, (1 << 20) // len(block))
    for lo in range(0, len(rows), step):
        yield lo, np.sqrt(squared_distances(rows[lo:lo + step], block["centre"])) <= block["radius"][None, :]


def sphere_counts(points: DataFrame, spheres: DataFrame, *, limits: Limits = LIMITS) -> DataFrame:
    """(cluster_id, class, k): rows of each class in each sphere, counted inside the tasks."""
    schema = T.StructType([T.StructField("cluster_id", T.LongType()), T.StructField("class", T.LongType()),
                           T.StructField("k", T.LongType())])
    pts = points.select("class", "x")
    parts = None
    for block in read_blocks(spheres.select("cluster_id", "centre", "radius"), "cluster_id", limits):
        if len(block) == 0:
            continue
        shared = points.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            b, counts = shared.value, {}
            for batch in batches:
                classes = batch.column("class").to_numpy(zero_copy_only=False)
                for lo, hit in _hits(batch, b):
                    mine = classes[lo:lo + len(hit)]
                    for c in np.unique(mine):
                        counts[c] = counts.get(c, 0) + hit[mine == c].sum(axis=0)
            for c, k in counts.items():
                j = np.flatnonzero(k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(b["cluster_id"][j]), pa.array(np.full(len(j), c, np.int64)), pa.array(k[j].astype(np.int64))],
                    names=["cluster_id", "class", "k"])

        part = pts.mapInArrow(run, schema)
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return points.sparkSession.createDataFrame([], schema)
    return parts.groupBy("cluster_id", "class").agg(F.sum("k").alias("k"))


def covering(points: DataFrame, spheres: DataFrame, label: str, out: str, *, limits: Limits = LIMITS) -> DataFrame:
    """Append ``out``: the distinct labels of the spheres (label, centre, radius) a point lies in."""
    result, first = points, True
    for block in read_blocks(spheres.select(F.col(label).cast("long").alias(label), "centre", "radius"), label, limits):
        if len(block) == 0:
            continue
        shared = points.sparkSession.sparkContext.broadcast(block)

        def kernel(batch, shared=shared):
            b = shared.value
            names, starts = np.unique(b[label], return_index=True)
            values, sizes = [], []
            for _, hit in _hits(batch, b):
                in_label = np.logical_or.reduceat(hit, starts, axis=1)
                values.append(names[np.nonzero(in_label)[1]])
                sizes.append(in_label.sum(axis=1))
            offsets = np.concatenate([[0], *sizes]).cumsum().astype(np.int32)
            return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values).astype(np.int64)))]

        result = map_batches(result, [T.StructField("_in", T.ArrayType(T.LongType()))], kernel)
        result = result.withColumn(out, F.col("_in") if first else F.array_union(out, "_in")).drop("_in")
        first = False
    return result.withColumn(out, F.array().cast("array<bigint>")) if first else result


def hull_distance(points: DataFrame, spheres: DataFrame, *, limits: Limits = LIMITS) -> DataFrame:
    """Append ``hull``: least (dist - r) / (dist + r) over spheres matched to the row's class, at most 1."""
    result, first = points, True
    for block in read_blocks(spheres.select("cluster_id", "centre", "radius", "match"), "cluster_id", limits):
        if len(block) == 0:
            continue
        shared = points.sparkSession.sparkContext.broadcast(block)

        def kernel(batch, shared=shared, first=first):
            b = shared.value
            rows = vector_matrix(batch.column("x"), b["centre"].shape[1])
            classes = batch.column("class").to_numpy(zero_copy_only=False)
            out = np.ones(len(rows))
            step = max(1, (1 << 20) // len(b))
            for lo in range(0, len(rows), step):
                gap = np.sqrt(squared_distances(rows[lo:lo + step], b["centre"]))
                with np.errstate(invalid="ignore"):
                    hull = (gap - b["radius"]) / (gap + b["radius"])
                hull[(classes[lo:lo + step, None] != b["match"][None, :]) | ~np.isfinite(hull)] = 1.0
                out[lo:lo + step] = np.minimum(hull.min(axis=1), 1.0)
            if not first:
                out = np.minimum(out, batch.column("hull").to_numpy(zero_copy_only=False))
            return [out]

        result = map_batches(result, [T.StructField("hull", T.DoubleType())], kernel, () if first else ("hull",))
        first = False
    return result.withColumn("hull", F.lit(1.0)) if first else result


# ---- connectivity ---------------------------------------------------------------------------


def class_near(points: DataFrame, params: CMMParams, *, limits: Limits = LIMITS) -> DataFrame:
    """(id, target, near): sorted distances of every point to its nearest k others of every class."""
    real = points.filter(F.col("class") != params.noise)
    return near_lists(points, real.withColumnRenamed("class", "target"), params.k, group="target", limits=limits)


def merged_near(near: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """The lists of merged classes (``names``: class, merged) from those of their parts."""
    named = near.join(small_side(names.withColumnRenamed("class", "target")), "target")
    return merge_lists(named.select("id", F.col("merged").alias("target"), "near"), k, group="target")


def mean_near(near: DataFrame, points: DataFrame, noise: int) -> DataFrame:
    """(id, class, target, kd): mean k-NN distance of every point to every class.

    A point alone in its class has distance 0 to it; other empty targets are left out.
    """
    own = points.filter(F.col("class") != noise).select("id", "class", F.col("class").alias("target"))
    joined = near.select("id", "target", mean_of("near").alias("kd")).join(points.select("id", "class"), "id")
    lonely = own.join(joined.select("id", "target"), ["id", "target"], "left_anti").withColumn("kd", F.lit(0.0))
    return joined.select("id", "class", "target", "kd").unionByName(lonely.select("id", "class", "target", "kd"))


def class_knn(points: DataFrame, params: CMMParams, *, limits: Limits = LIMITS) -> DataFrame:
    """(id, class, target, kd) of labelled points; points are compared with points once, however often the result is read."""
    near = cut_lineage(class_near(points, params, limits=limits))
    return cut_lineage(mean_near(near, points, params.noise))


def class_limits(kd: DataFrame) -> DataFrame:
    """(class, mean, dev, upper, size) of the own-class k-NN distances."""
    own = kd.filter(F.col("class") == F.col("target"))
    var = F.avg(F.col("kd") * F.col("kd")) - F.avg("kd") * F.avg("kd")
    out = own.groupBy("class").agg(F.avg("kd").alias("mean"), var.alias("v"), F.count("*").alias("size"))
    dev = F.sqrt(F.when(F.col("v") <= 0, F.lit(FLAT)).otherwise(F.col("v")))
    return out.select("class", "mean", dev.alias("dev"), (F.col("mean") + dev).alias("upper"), "size")


def connectivity(kd: DataFrame, limits_: DataFrame, params: CMMParams) -> DataFrame:
    """(id, class, target, conn): how well each point connects to each class, 0..1."""
    upper = limits_.select(F.col("class").alias("target"), "upper")
    if params.exponential:
        lam = -math.log(EXP_REFERENCE_VALUE) / math.log(2) / EXP_REFERENCE_X
        far = F.pow(F.lit(2.0), F.lit(-lam) * (F.col("kd") - F.col("upper")) / F.col("upper"))
    else:
        far = F.col("upper") / F.col("kd")
    conn = F.when(F.col("kd") < F.col("upper"), F.lit(1.0)).otherwise(far)
    return kd.join(small_side(upper), "target").select("id", "class", "target", conn.alias("conn"))


def class_connections(conn: DataFrame) -> DataFrame:
    """(class, target, connection): mean of a class's strongest own x other connections."""
    own = conn.filter(F.col("class") == F.col("target")).select("id", F.col("conn").alias("own"))
    pair = conn.filter(F.col("class") != F.col("target")).join(own, "id").withColumn("c", F.col("own") * F.col("conn"))
    return _top_two(pair)


def _top_two(pair: DataFrame) -> DataFrame:
    first = pair.groupBy("class", "target").agg(F.max(F.struct("c", "id")).alias("a"), F.count("*").alias("k"))
    rest = pair.join(small_side(first), ["class", "target"]).filter(F.col("id") != F.col("a.id"))
    second = rest.groupBy("class", "target").agg(F.max("c").alias("b"))
    return first.join(second, ["class", "target"], "left").select(
        "class", "target", F.when(F.col("b").isNull(), F.col("a.c")).otherwise((F.col("a.c") + F.col("b")) / 2).alias("connection"))


def merge_classes(points: DataFrame, params: CMMParams, *, near: DataFrame | None = None,
                  limits: Limits = LIMITS) -> DataFrame:
    """(class, merged): class labels after merging while the strongest mutual connection exceeds tau.

    A merge merges the k-NN lists of its two classes; points are compared with points only once.
    The labels, and nothing else, are kept on the driver.
    """
    spark = points.sparkSession
    labels = [r["class"] for r in points.filter(F.col("class") != params.noise).select("class").distinct().collect()]
    mapping = {c: c for c in labels}
    schema = "class long, merged long"
    if params.tau < 1.0:
        near = cut_lineage(class_near(points, params, limits=limits)) if near is None else near
    while params.tau < 1.0 and len(set(mapping.values())) > 1:
        names = spark.createDataFrame(sorted(mapping.items()), schema)
        work = points.join(small_side(names), "class", "left").select("id", F.coalesce("merged", "class").alias("class"))
        kd = mean_near(merged_near(near, names, params.k), work, params.noise)
        links = class_connections(connectivity(kd, class_limits(kd), params))
        other = links.select(F.col("target").alias("class"), F.col("class").alias("target"), F.col("connection").alias("back"))
        mutual = links.join(other, ["class", "target"]).filter("class < target").select(
            F.least("connection", "back").alias("m"), (-F.col("class")).alias("a"), (-F.col("target")).alias("b"))
        best = mutual.agg(F.max(F.struct("m", "a", "b")).alias("t")).first()["t"]
        if best is None or best["m"] <= params.tau:
            break
        keep, gone = -best["a"], -best["b"]
        mapping = {c: (keep if v == gone else v) for c, v in mapping.items()}
    return spark.createDataFrame(sorted(mapping.items()), schema)


# ---- matching and errors ----------------------------------------------------------------------


def match_clusters(counts: DataFrame, profiles: DataFrame, spheres: DataFrame, noise: int) -> DataFrame:
    """(cluster_id, match): the class each found sphere stands for, -1 if it holds no classed point.

    ``counts`` is (cluster_id, class, k): points of a class in a found sphere; ``profiles`` is (class, target, k):
    points of ``target`` inside the sphere of ``class``.
    """
    found = counts.filter(F.col("class") != noise)
    kinds = found.groupBy("cluster_id").agg(F.count("*").alias("kinds"), F.min("class").alias("only"))
    classes = profiles.agg(F.array_sort(F.collect_set("class")).alias("c")).scalar()
    wide = found.withColumn("h", F.explode(classes))
    gt = profiles.select(F.col("class").alias("h"), F.col("target").alias("class"), F.col("k").alias("g"))
    over = wide.join(gt, ["h", "class"], "left").groupBy("cluster_id", "h").agg(
        F.sum(F.greatest(F.col("k") - F.coalesce("g", F.lit(0)), F.lit(0))).alias("surplus"),
        F.sum(F.when(F.col("h") == F.col("class"), F.col("k")).otherwise(0)).alias("votes"))
    votes = F.when(F.col("surplus") == 0, -F.col("votes")).otherwise(F.lit(0))
    best = over.groupBy("cluster_id").agg(F.min(F.struct("surplus", votes.alias("v"), "h")).alias("b"))
    joined = spheres.select("cluster_id").join(kinds, "cluster_id", "left").join(best, "cluster_id", "left")
    return joined.select("cluster_id", F.when(F.col("kinds") == 1, F.col("only")).otherwise(
        F.coalesce("b.h", F.lit(-1))).cast("long").alias("match"))


def profiles_of(points: DataFrame, noise: int) -> DataFrame:
    """(class, target, k): own points always count, others when inside the class's sphere (``homes``)."""
    own = F.array("class")
    return (points.filter(F.col("class") != noise).select(F.col("class").alias("target"),
                                                          F.explode(F.array_union(own, "homes")).alias("class"))
            .groupBy("class", "target").agg(F.count("*").alias("k")))


@dataclass
class Truth:
    """What the labels of a window say, whatever clusters are scored on it."""

    points: DataFrame  # id, x, class (merged), homes: merged classes whose spheres hold the point
    conn: DataFrame
    profiles: DataFrame
    merged: DataFrame
    astray: DataFrame  # one number: points inside the sphere of another class
    params: CMMParams


@dataclass
class Scored:
    """Intermediate tables of one evaluation and its one-row result."""

    points: DataFrame
    matches: DataFrame
    conn: DataFrame
    result: DataFrame


def learn_truth(points: DataFrame, *, d: int, params: CMMParams = CMMParams(), limits: Limits = LIMITS) -> Truth:
    """Classes, their spheres and connectivity of labelled ``points`` (id, x, class)."""
    pts = cut_lineage(points.select(F.col("id").cast("long").alias("id"), "x", F.col("class").cast("long").alias("class")))
    truth = class_spheres(pts.filter(F.col("class") != params.noise), d=d)
    near = cut_lineage(class_near(pts, params, limits=limits))
    merged = merge_classes(pts, params, near=near, limits=limits)
    astray = covering(pts, truth, "class", "homes", limits=limits).filter(
        F.size(F.array_except("homes", F.array("class"))) > 0).agg(F.count("*").alias("n"))
    work = pts.join(small_side(merged), "class", "left").select("id", "x", F.coalesce("merged", "class").alias("class"))
    work = cut_lineage(covering(work, truth.join(merged, "class"), "merged", "homes", limits=limits))
    kd = cut_lineage(mean_near(merged_near(near, merged, params.k) if params.tau < 1.0 else near, work, params.noise))
    conn = cut_lineage(connectivity(kd, class_limits(kd), params))
    return Truth(work, conn, profiles_of(work, params.noise), merged, astray, params)


def score(truth: Truth, spheres: DataFrame, *, limits: Limits = LIMITS) -> Scored:
    """Score found ``spheres`` (cluster_id, centre, radius).

    ``points`` of the result carry their error; the one-row table holds cmm, cmm_basic, missed,
    misplaced, noise, ca_separability, ca_noise and ca_model.  Every point is one row throughout, with the
    classes it meets in arrays.
    """
    work, conn, params = truth.points, truth.conn, truth.params
    noise = params.noise
    found = spheres.select(F.col("cluster_id").cast("long").alias("cluster_id"), "centre", "radius")
    counts = sphere_counts(work, found, limits=limits)
    matches = cut_lineage(match_clusters(counts, truth.profiles, found, noise))
    matched = found.join(matches, "cluster_id")

    def conn_to(label):
        return F.get(F.filter("links", lambda s: s["target"] == label), 0)["conn"]

    links = conn.groupBy("id").agg(F.collect_list(F.struct("target", "conn")).alias("links"))
    rows = covering(work, matched, "match", "covers", limits=limits).join(links, "id", "left")
    rows = rows.withColumn("conn", F.coalesce(conn_to(F.col("class")), F.lit(1.0)))
    is_noise = F.col("class") == noise

    def error(match):
        model = F.array_contains("homes", match)
        apart = F.lit(1.0) - F.coalesce(conn_to(match), F.lit(0.0))
        strayed = F.when(match == -1, 1.0).when(model, MIN_ERROR).otherwise(apart)
        misplaced = (F.when(match == F.col("class"), 0.0).when(match == -1, 1.0)
                     .when(model | (apart == 0), MIN_ERROR).otherwise(apart * F.col("conn")))
        return F.when(is_noise, strayed).otherwise(misplaced)

    rows = rows.select("id", "x", "class", "conn", F.array_max(F.transform("covers", error)).alias("worst"))
    hulls = hull_distance(rows, matched, limits=limits)
    missed = F.when(is_noise, 0.0).otherwise(F.col("conn") * (1 - F.exp(F.lit(-params.lam_missed) * F.col("hull"))))
    scored = cut_lineage(hulls.select(
        "id", "class", "conn", F.coalesce("worst", missed).alias("err"), F.col("worst").isNotNull().alias("covered")))

    def rate(err_rows, base_rows):
        err = F.coalesce(F.sum(F.when(err_rows, F.col("err"))), F.lit(0.0))
        base = F.coalesce(F.sum(F.when(base_rows, F.col("conn"))), F.lit(0.0))
        return F.when(base == 0, 1.0).otherwise(1 - err / base)

    ca_noise = conn.filter(is_noise).groupBy("id").agg(F.max("conn").alias("m"))
    noise_rows = work.filter(is_noise).agg(F.count("*").alias("n")).scalar()
    ca_noise = ca_noise.agg(F.coalesce(F.sum("m"), F.lit(0.0)).alias("m"))
    separability = truth.merged.agg((F.count_distinct("merged") / F.count("*")).alias("s"))
    result = scored.agg(
        rate(F.lit(True), F.lit(True)).alias("cmm"),
        (1 - F.avg((F.col("err") != 0).cast("double"))).alias("cmm_basic"),
        rate(~is_noise & ~F.col("covered"), ~is_noise).alias("missed"),
        rate(~is_noise & F.col("covered"), ~is_noise).alias("misplaced"),
        rate(is_noise & F.col("covered"), is_noise).alias("noise"),
        F.count("*").alias("_n"))
    result = result.select(
        "cmm", "cmm_basic", "missed", "misplaced", "noise", separability.scalar().alias("ca_separability"),
        F.when(noise_rows == 0, 1.0).otherwise(1 - ca_noise.scalar() / noise_rows).alias("ca_noise"),
        (1 - truth.astray.scalar() / F.col("_n")).alias("ca_model"))
    return Scored(scored, matches, conn, result)


def evaluate(points: DataFrame, spheres: DataFrame, *, d: int, params: CMMParams = CMMParams(),
             limits: Limits = LIMITS) -> Scored:
    """Score found ``spheres`` (cluster_id, centre, radius) on labelled ``points`` (id, x, class), see ``score``."""
    return score(learn_truth(points, d=d, params=params, limits=limits), spheres, limits=limits)


def score_levels(points: DataFrame, levels: dict[str, DataFrame], *, d: int, params: CMMParams = CMMParams(),
                 limits: Limits = LIMITS) -> DataFrame:
    """(level, clusters, n_rows, sse, cmm, ...): one row for each named table of spheres, such as micro and macro clusters.

    The labels are looked at once for all of them; ``sse`` is taken against the nearest centre.
    """
    truth = learn_truth(points, d=d, params=params, limits=limits)
    rows = []
    for level, spheres in levels.items():
        spheres = cut_lineage(spheres.select(F.col("cluster_id").cast("long").alias("cluster_id"), "centre", "radius"))
        apart = sse_given(truth.points.select("x"), spheres.select(F.col("cluster_id").alias("mc_id"), "centre"), limits=limits)
        rows.append(score(truth, spheres, limits=limits).result.select(
            F.lit(level).alias("level"), spheres.agg(F.count("*")).scalar().alias("clusters"),
            apart.select("n").scalar().alias("n_rows"), apart.select("sse").scalar().alias("sse"), "*"))
    return reduce(DataFrame.unionByName, rows)


def evaluation_window(rows: DataFrame, order: list, n: int = 10_000) -> DataFrame:
    """The last n labelled rows of a stream: what the measure is taken on."""
    from tidepool.operators.rows import last_rows

    return last_rows(rows, order, n)
