"""Density clustering: of summaries (offline step) and of raw points (initial model).

Connectivity never needs the pairs of a neighbourhood.  Summaries are compared with bounded
blocks inside the tasks, and each task emits only a spanning forest of the links it saw.  Raw
points of few dimensions are collapsed into cells small enough for their members to be mutual
neighbours; links between cells are decided by bounding boxes that are refined only while
undecided; raw points of many dimensions meet at pivots.  All results are exact and do not depend on any order of visiting.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.functions import summary
from tidepool.operators import pivots
from tidepool.operators.blocks import read_blocks, squared_distances, vector_matrix
from tidepool.operators.cf import vector_sum
from tidepool.operators.components import connected_components, forest
from tidepool.operators.rows import number_rows
from tidepool.session import LIMITS, Limits, cut_lineage, width_of

GRID_DIMS = 4
DIRECT_PAIRS = 10_000_000


# ---- blocked kernels, any dimension ---------------------------------------------------------


def range_forest(centres: DataFrame, reach: float, *, strict: bool = False, key: str = "mc_id",
                 centre: str = "centre", limits: Limits = LIMITS) -> DataFrame:
    """(src, dst) links that connect exactly what ``distance <= reach`` connects.

    At most one link per node and task is emitted.
    """
    schema = T.StructType([T.StructField("src", T.LongType()), T.StructField("dst", T.LongType())])
    rows_df = centres.select(F.col(key).cast("long").alias("id"), F.col(centre).alias("c"))
    limit2 = reach * reach
    parts = None
    for block in read_blocks(rows_df, "id", limits):
        if len(block) == 0:
            continue
        shared = centres.sparkSession.sparkContext.broadcast(block)

        def run(batches, shared=shared):
            ids, ref = shared.value["id"], shared.value["c"]
            for batch in batches:
                own = batch.column("id").to_numpy(zero_copy_only=False)
                rows = vector_matrix(batch.column("c"), ref.shape[1])
                step = max(1, (1 << 20) // len(ref))
                for lo in range(0, len(rows), step):
                    d2 = squared_distances(rows[lo:lo + step], ref)
                    i, j = np.nonzero(d2 < limit2 if strict else d2 <= limit2)
                    left, right = own[lo:lo + step][i], ids[j]
                    nodes, inv = np.unique(np.concatenate([left, right]), return_inverse=True)
                    root = forest(len(nodes), inv[:len(left)], inv[len(left):])
                    link = root != np.arange(len(nodes))
                    yield pa.RecordBatch.from_arrays([pa.array(nodes[link]), pa.array(nodes[root[link]])],
                                                     names=["src", "dst"])

        part = rows_df.mapInArrow(run, schema)
        parts = part if parts is None else parts.unionByName(part)
    return parts if parts is not None else centres.sparkSession.createDataFrame([], schema)


# ---- offline: summaries -----------------------------------------------------------------------


def macro_components(model: DataFrame, eps: float, mu: float, *, limits: Limits = LIMITS) -> DataFrame:
    """(mc_id, cluster_id) of p-clusters in a component of the 2-eps graph with a core member and company."""
    centres = model.select("mc_id", "w", summary.centroid("w", "ls").alias("centre"))
    links = range_forest(centres, 2 * eps, limits=limits)
    comp = connected_components(centres.select(F.col("mc_id").alias("node")), links)
    labelled = centres.select("mc_id", "w").join(comp.withColumnRenamed("node", "mc_id"), "mc_id")
    good = labelled.groupBy("component").agg(F.count("*").alias("k"), F.max("w").alias("top")).filter(
        (F.col("k") >= 2) & (F.col("top") >= mu))
    return labelled.join(good, "component").select("mc_id", F.col("component").alias("cluster_id"))


def offline_clusters(model: DataFrame, eps: float, mu: float, *, d: int | None = None,
                     limits: Limits = LIMITS) -> DataFrame:
    """(cluster_id, w, ls, ss): macro clusters, or the p-clusters themselves if there is none."""
    d = d or width_of(model, "ls")
    comp = macro_components(model, eps, mu, limits=limits)
    macro = (model.join(comp, "mc_id").groupBy("cluster_id")
             .agg(F.sum("w").alias("w"), vector_sum(F.col("ls"), d).alias("ls"), vector_sum(F.col("ss"), d).alias("ss")))
    found = macro.agg(F.count("*").alias("n")).scalar()
    alone = model.filter(found == 0).select(F.col("mc_id").alias("cluster_id"), "w", "ls", "ss")
    return macro.unionByName(alone)


# ---- initial model: raw points ------------------------------------------------------------------


def cluster_points(points: DataFrame, eps: float, mu: float, *, x: str = "x", d: int | None = None,
                   limits: Limits = LIMITS) -> DataFrame:
    """(x, w, cluster) of clustered positions, w rows each; the cluster is its smallest core position.

    A position is core if more than mu other rows lie strictly within eps.  A border position
    joins the smallest cluster it touches; the rest is left out.
    """
    d = d or width_of(points, x)
    spots = cut_lineage(points.filter(F.col(x).isNotNull()).groupBy(F.col(x).alias("x")).agg(
        F.count("*").cast("double").alias("w")))
    if d <= GRID_DIMS:
        return _cluster_cells(spots, eps, mu, d)
    return _cluster_pivots(spots, eps, mu, limits)


def _cluster_pivots(spots, eps, mu, limits):
    """Any dimension: rows meet at pivots, see ``operators.pivots``.  Places that are not finite touch nothing."""
    whole = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    ids = cut_lineage(number_rows(spots.filter(whole), ["x"], "id"))
    where = pivots.choose(ids, eps, limits=limits)
    if where is None:
        return spots.limit(0).select("x", "w", F.col("x").alias("cluster"))
    rows = ids.select("id", "x", F.col("w").alias("value"))
    mass = pivots.meet(rows, rows, eps, where, "id long, mass double", pivots.mass_kernel)
    counted = cut_lineage(ids.join(mass, "id"))
    core = counted.filter(F.col("mass") - 1 > mu)
    nodes = core.select("id", "x", F.col("w").alias("value"))
    links = pivots.meet(nodes, nodes, eps, where, "src long, dst long", pivots.link_kernel)
    comp = connected_components(core.select(F.col("id").alias("node")), links, limits=limits)
    labelled = cut_lineage(core.join(comp.select(F.col("node").alias("id"), F.col("component").alias("label")), "id"))
    rest = counted.filter(F.col("mass") - 1 <= mu).select("id", "x", F.col("w").alias("value"))
    touched = pivots.meet(rest, labelled.select("id", "x", F.col("label").alias("value")), eps, where, "id long, least double", pivots.least_kernel)
    border = counted.join(touched, "id").select("x", "w", F.col("least").cast("long").alias("label"))
    names = labelled.filter("id = label").select("label", F.col("x").alias("cluster"))
    return labelled.select("x", "w", "label").unionByName(border).join(names, "label").select("x", "w", "cluster")


def _offsets(d: int, side: float, eps: float):
    r = math.ceil(math.sqrt(d)) + 1
    out = []
    for o in itertools.product(range(-r, r + 1), repeat=d):
        if any(o) and sum((max(0, abs(v) - 1) * side) ** 2 for v in o) < eps * eps:
            out.append(list(o))
    return out


def _d2(a, b, d):
    return sum(((F.col(a)[j] - F.col(b)[j]) * (F.col(a)[j] - F.col(b)[j]) for j in range(1, d)),
               (F.col(a)[0] - F.col(b)[0]) * (F.col(a)[0] - F.col(b)[0]))


def _cell(x, side, d):
    return F.array(*[F.floor(F.col(x)[j] / F.lit(side)).cast("long") for j in range(d)])


def _cluster_cells(spots, eps, mu, d):
    side = eps / math.sqrt(d) * (1 - 1e-9)
    eps2 = eps * eps
    u = spots.withColumn("cell", _cell("x", side, d))
    cells = u.groupBy("cell").agg(F.sum("w").alias("cw"))
    cells = cut_lineage(cells.withColumn("dense", F.col("cw") - 1 > mu))
    shifts = F.array(*[F.array(*[F.lit(v).cast("long") for v in o]) for o in _offsets(d, side, eps)])
    reach = cells.select("cell", F.explode(shifts).alias("o")).select(
        "cell", F.zip_with("cell", "o", lambda p, q: p + q).alias("ncell"))
    pairs = cut_lineage(reach.join(cells.select(F.col("cell").alias("ncell")), "ncell", "left_semi"))

    # Rows of thin cells (at most mu + 1 rows each) look at the cells around them.
    tagged = u.join(cells, "cell")
    thin = tagged.filter("NOT dense").select("cell", "x", "w", "cw")
    other = u.select(F.col("cell").alias("ncell"), F.col("x").alias("y"), F.col("w").alias("wy"))
    seen = (thin.join(pairs, "cell").join(other, "ncell").filter(_d2("x", "y", d) < eps2)
            .groupBy("x").agg(F.sum("wy").alias("around")))
    thin = cut_lineage(thin.join(seen, "x", "left").withColumn(
        "core", F.col("cw") + F.coalesce("around", F.lit(0.0)) - 1 > mu).select("cell", "x", "w", "core"))
    core = cut_lineage(tagged.filter("dense").select("cell", "x", "w").unionByName(
        thin.filter("core").select("cell", "x", "w")))

    core_cells = core.select("cell").distinct()
    near = (pairs.filter("cell < ncell").join(core_cells, "cell", "left_semi")
            .join(core_cells.withColumnRenamed("cell", "ncell"), "ncell", "left_semi"))
    links = _linked_cells(core, near, side, eps2, d)
    comp = connected_components(core_cells.withColumnRenamed("cell", "node"), links).select(
        F.col("node").alias("cell"), "component")
    named = core.groupBy("cell").agg(F.min("x").alias("low")).join(comp, "cell")
    names = named.groupBy("component").agg(F.min("low").alias("cluster"))
    cell_names = cut_lineage(comp.join(names, "component").select("cell", "cluster"))
    members = core.join(cell_names, "cell").select("x", "w", "cluster")

    rest = thin.filter("NOT core").select("cell", "x", "w")
    own = rest.join(cell_names, "cell").select("x", "w", "cluster")
    cores = core.join(cell_names, "cell").select(F.col("cell").alias("ncell"), F.col("x").alias("y"), "cluster")
    across = (rest.join(pairs, "cell").join(cores, "ncell").filter(_d2("x", "y", d) < eps2)
              .select("x", "w", "cluster"))
    border = own.unionByName(across).groupBy("x", "w").agg(F.min("cluster").alias("cluster"))
    return members.unionByName(border)


def _boxes(core, side, level, d):
    fine = side / (1 << level)
    return (core.withColumn("sub", _cell("x", fine, d)).groupBy("cell", "sub").agg(
        F.count("*").alias("k"), F.min("x").alias("rep"), F.array(*[F.min(F.col("x")[j]) for j in range(d)]).alias("lo"),
        F.array(*[F.max(F.col("x")[j]) for j in range(d)]).alias("hi")))


def _linked_cells(core, near, side, eps2, d):
    """(src, dst) cell pairs that hold two core positions closer than eps.

    Boxes around the positions decide most pairs at once: too far apart, all close, or their
    representatives close.  Only undecided boxes are halved and compared again, so two crowded
    cells cost their facing surface, not the product of their sizes.  Once the undecided boxes
    hold few enough position pairs (checked), these are compared directly.
    """
    open_pairs = near.select(F.col("cell").alias("a"), F.col("ncell").alias("b"),
                             F.col("cell").alias("sa"), F.col("ncell").alias("sb"))
    links, level = None, 0
    while True:
        live = open_pairs.select(F.col("a").alias("cell")).unionByName(
            open_pairs.select(F.col("b").alias("cell"))).distinct()
        boxes = _boxes(core.join(live, "cell", "left_semi"), side, level, d)
        left = boxes.select(F.col("cell").alias("a"), F.col("sub").alias("sa"), F.col("k").alias("ka"), F.col("rep").alias("ra"),
                            F.col("lo").alias("la"), F.col("hi").alias("ha"))
        right = boxes.select(F.col("cell").alias("b"), F.col("sub").alias("sb"), F.col("k").alias("kb"), F.col("rep").alias("rb"),
                             F.col("lo").alias("lb"), F.col("hi").alias("hb"))
        gap2 = far2 = F.lit(0.0)
        for j in range(d):
            la, ha, lb, hb = (F.col(c)[j] for c in ("la", "ha", "lb", "hb"))
            gap = F.greatest(F.lit(0.0), lb - ha, la - hb)
            far = F.greatest(ha - lb, hb - la)
            gap2, far2 = gap2 + gap * gap, far2 + far * far
        same = (F.col("la") == F.col("ha")) & (F.col("lb") == F.col("hb"))
        judged = cut_lineage(
            open_pairs.join(left, ["a", "sa"]).join(right, ["b", "sb"])
            .withColumn("linked", (far2 < eps2) | (_d2("ra", "rb", d) < eps2))
            .filter(F.col("linked") | ((gap2 < eps2) & ~same))
            .select("a", "b", "sa", "sb", "linked", (F.col("ka") * F.col("kb")).cast("double").alias("work")))
        found = judged.filter("linked").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
        links = found if links is None else links.unionByName(found)
        rest = (judged.filter("NOT linked").join(found.select(F.col("src").alias("a"), F.col("dst").alias("b")),
                                                 ["a", "b"], "left_anti").select("a", "b", "sa", "sb", "work"))
        left_over = rest.agg(F.sum("work")).first()[0]
        if left_over is None:
            return links
        if left_over <= DIRECT_PAIRS:
            inner = core.withColumn("sub", _cell("x", side / (1 << level), d))
            one = inner.select(F.col("cell").alias("a"), F.col("sub").alias("sa"), F.col("x").alias("xa"))
            two = inner.select(F.col("cell").alias("b"), F.col("sub").alias("sb"), F.col("x").alias("xb"))
            direct = (rest.join(one, ["a", "sa"]).join(two, ["b", "sb"]).filter(_d2("xa", "xb", d) < eps2)
                      .select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
            return links.unionByName(direct)
        level += 1
        subs = _boxes(core, side, level, d).select(
            "cell", "sub", F.transform("sub", lambda v: F.floor(v / 2)).alias("parent"))
        open_pairs = cut_lineage(
            rest.join(subs.select(F.col("cell").alias("a"), F.col("parent").alias("sa"), F.col("sub").alias("na")), ["a", "sa"])
            .join(subs.select(F.col("cell").alias("b"), F.col("parent").alias("sb"), F.col("sub").alias("nb")), ["b", "sb"])
            .select("a", "b", F.col("na").alias("sa"), F.col("nb").alias("sb")))


def initial_clusters(points: DataFrame, eps: float, mu: float, *, x: str = "x", d: int | None = None,
                     limits: Limits = LIMITS) -> DataFrame:
    """(cluster, w, ls, ss): one p-cluster per density cluster of the initial points."""
    d = d or width_of(points, x)
    rows = cluster_points(points, eps, mu, x=x, d=d, limits=limits)
    w, xc = F.col("w"), F.col("x")
    return rows.groupBy("cluster").agg(
        F.sum("w").alias("w"), F.array(*[F.sum(w * xc[j]) for j in range(d)]).alias("ls"),
        F.array(*[F.sum(w * xc[j] * xc[j]) for j in range(d)]).alias("ss"))
