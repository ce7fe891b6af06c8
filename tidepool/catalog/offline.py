"""Queries over k-means, density clustering, grids, snapshots and sum-of-squares quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.catalog.data import (ITEMS, ORDERS2D, TILES, VECTORS, VISITS, Registry, items, label_model, orders2d, r6,
                                   sql_r6, tiles, vectors, visits)
from tidepool.functions import grid as g
from tidepool.functions import summary
from tidepool.operators import cf, dbscan, evaluate, grid, kmeans, snapshots
from tidepool.plans import dstream

registry = Registry()
add = registry.add


# ---- k-means ----------------------------------------------------------------------------------


def _bands(spark, sf):
    """Start centres: the centroids of the quantity bands."""
    coarse = tiles(spark, sf).withColumn("mc_id", F.floor(F.col("mc_id") / 100).cast("long"))
    return cf.cf_merge(coarse, d=3).select("mc_id", summary.centroid().alias("centre"))


BANDS = """s0 AS (SELECT mc_id // 100 AS mc_id, sum(ls0)/sum(n) AS c0, sum(ls1)/sum(n) AS c1, sum(ls2)/sum(n) AS c2
            FROM tiles GROUP BY 1)"""


def _lloyd_sql(rounds: int) -> str:
    """Iterations over p(id, x0, x1, x2, w) from s0; ends with the labels of the last centres."""
    out = []
    for i in range(rounds + 1):
        out.append(f"""l{i} AS (SELECT id, arg_min(mc_id, d2) AS c, min(d2) AS d2 FROM (
  SELECT p.id, s.mc_id, (p.x0-s.c0)*(p.x0-s.c0) + (p.x1-s.c1)*(p.x1-s.c1) + (p.x2-s.c2)*(p.x2-s.c2) AS d2
  FROM p CROSS JOIN s{i} s) GROUP BY id)""")
        if i < rounds:
            out.append(f"""s{i + 1} AS (SELECT c AS mc_id, sum(w*x0)/sum(w) AS c0, sum(w*x1)/sum(w) AS c1,
  sum(w*x2)/sum(w) AS c2 FROM p JOIN l{i} USING (id) GROUP BY c)""")
    return ",\n".join(out)


TILE_POINTS = "p AS (SELECT mc_id AS id, ls0/n AS x0, ls1/n AS x1, ls2/n AS x2, n AS w FROM tiles)"


@add("kmeans_weighted", f"""
WITH {ITEMS}, {TILES}, {BANDS}, {TILE_POINTS}, {_lloyd_sql(3)}
SELECT l3.c AS cluster_id, sum(p.w)::BIGINT AS weight, {sql_r6('any_value(s3.c0)', 'c0')}, {sql_r6('any_value(s3.c1)', 'c1')},
       {sql_r6('any_value(s3.c2)', 'c2')}
FROM l3 JOIN p USING (id) JOIN s3 ON s3.mc_id = l3.c GROUP BY l3.c""")
def kmeans_weighted(spark, sf):
    out = kmeans.weighted_clusters(kmeans.as_examples(tiles(spark, sf)), _bands(spark, sf), 3)
    return out.select("cluster_id", F.col("weight").cast("long").alias("weight"),
                      *[r6(F.col("centre")[j], f"c{j}") for j in range(3)])


@add("kmeans_macro_cf", f"""
WITH {ITEMS}, {TILES}, {BANDS}, {TILE_POINTS}, {_lloyd_sql(3)}
SELECT l3.c AS cluster_id, sum(n)::BIGINT AS n, round(sum(ls0), 4) + 0.0 AS ls0, round(sum(ss1), 4) + 0.0 AS ss1,
       sum(lst)::BIGINT AS lst FROM l3 JOIN tiles t ON t.mc_id = l3.id GROUP BY l3.c""")
def kmeans_macro_cf(spark, sf):
    out = kmeans.macro_clusters(tiles(spark, sf), _bands(spark, sf), 3, d=3)
    return out.select("cluster_id", F.col("n").cast("long").alias("n"), (F.round(F.col("ls")[0], 4) + F.lit(0.0)).alias("ls0"),
                      (F.round(F.col("ss")[1], 4) + F.lit(0.0)).alias("ss1"), F.col("lst").cast("long").alias("lst"))


@add("kmeans_given_init", f"""
WITH {ITEMS}, {TILES}, {BANDS}, p AS (
  SELECT row_number() OVER () AS id, x0, x1, x2, count(*)::DOUBLE AS w FROM items GROUP BY x0, x1, x2), {_lloyd_sql(3)}
SELECT mc_id, {sql_r6('c0', 'c0')}, {sql_r6('c1', 'c1')}, {sql_r6('c2', 'c2')} FROM s3""")
def kmeans_given_init(spark, sf):
    out = kmeans.lloyd(items(spark, sf), _bands(spark, sf), 3)
    return out.select("mc_id", *[r6(F.col("centre")[j], f"c{j}") for j in range(3)])


@add("kmeans_library")
def kmeans_library(spark, sf):
    return kmeans.library_kmeans(kmeans.as_examples(tiles(spark, sf)), 5, weight="weight", seed=3).select(
        "mc_id", *[r6(F.col("centre")[j], f"c{j}") for j in range(3)])


@add("kmeans_drawn")
def kmeans_drawn(spark, sf):
    return kmeans.drawn_kmeans(tiles(spark, sf), 5, 10_000, seed=3).select(
        "mc_id", *[r6(F.col("centre")[j], f"c{j}") for j in range(3)])


# ---- quality ------------------------------------------------------------------------------------


@add("cluster_centroids", f"""
WITH {VECTORS} SELECT mc_id AS cluster_id, dim, n AS size, {sql_r6('c', 'c')} FROM means""")
def cluster_centroids(spark, sf):
    out = evaluate.cluster_centroids(vectors(spark, sf), cluster="label", d=64)
    return out.select(F.col("label").alias("cluster_id"), "size", F.posexplode("centre").alias("dim", "v")).select(
        "cluster_id", "dim", "size", r6("v", "c"))


@add("sse", f"""
WITH {VECTORS} SELECT {sql_r6('sum(d2)', 'sse')}, count(*) AS n FROM vd WHERE label = mc_id""")
def sse(spark, sf):
    out = evaluate.sse(vectors(spark, sf), cluster="label", d=64)
    return out.select(r6("sse", "sse"), "n")


@add("sse_given", f"""
WITH {VECTORS} SELECT {sql_r6('sum(dist * dist)', 'sse')}, count(*) AS n FROM near""")
def sse_given(spark, sf):
    from tidepool.operators.assign import centres_of

    out = evaluate.sse_given(vectors(spark, sf), centres_of(label_model(spark, sf)))
    return out.select(r6("sse", "sse"), "n")


@add("sse_single_centre", f"""
WITH {ITEMS}, c AS (SELECT avg(x0) AS c0, avg(x1) AS c1, avg(x2) AS c2 FROM items)
SELECT round(sum((x0-c0)*(x0-c0) + (x1-c1)*(x1-c1) + (x2-c2)*(x2-c2)), 4) + 0.0 AS sse, count(*) AS n FROM items CROSS JOIN c""")
def sse_single_centre(spark, sf):
    pts = items(spark, sf)
    one = pts.agg(*[F.avg(F.col("x")[j]).alias(f"c{j}") for j in range(3)]).select(
        F.lit(0).cast("long").alias("mc_id"), F.array("c0", "c1", "c2").alias("centre"))
    return evaluate.sse_given(pts, one).select((F.round("sse", 4) + F.lit(0.0)).alias("sse"), "n")


@add("sse_carried", f"""
WITH {VECTORS} SELECT {sql_r6('sum(dist * dist)', 'sse')}, count(*) AS n FROM near""")
def sse_carried(spark, sf):
    from tidepool.operators.assign import assign_nearest, centres_of

    centres = centres_of(label_model(spark, sf))
    rows = assign_nearest(vectors(spark, sf), centres.withColumn("own", F.col("centre")), carry=("own",))
    return evaluate.sse_carried(rows, centre="own", d=64).select(r6("sse", "sse"), "n")


@add("ssb", f"""
WITH {VECTORS}, g AS (SELECT dim, avg(v) AS m FROM vl GROUP BY dim)
SELECT {sql_r6('sum(n * (c - m) * (c - m))', 'ssb')}, count(DISTINCT mc_id) AS k FROM means JOIN g USING (dim)""")
def ssb(spark, sf):
    return evaluate.ssb(vectors(spark, sf), cluster="label", d=64).select(r6("ssb", "ssb"), "k")


# ---- density clustering --------------------------------------------------------------------------

EPS, MU = 0.15, 1500.0


@add("dbscan_micro", f"""
WITH RECURSIVE {ITEMS}, {TILES}, c AS (SELECT mc_id, n, ls0, ls0/n AS c0, ls1/n AS c1, ls2/n AS c2 FROM tiles),
e AS (SELECT a.mc_id AS a, b.mc_id AS b FROM c a JOIN c b ON
  (a.c0-b.c0)*(a.c0-b.c0) + (a.c1-b.c1)*(a.c1-b.c1) + (a.c2-b.c2)*(a.c2-b.c2) <= {4 * EPS * EPS}),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
comp AS (SELECT a AS mc_id, min(b) AS cluster_id FROM r GROUP BY a)
SELECT cluster_id, count(*) AS members, sum(n)::BIGINT AS w, round(sum(ls0), 4) + 0.0 AS ls0
FROM comp JOIN c USING (mc_id) GROUP BY cluster_id HAVING count(*) >= 2 AND max(n) >= {MU}""")
def dbscan_micro(spark, sf):
    model = tiles(spark, sf).withColumnRenamed("n", "w")
    comp = dbscan.macro_components(model, EPS, MU)
    return (comp.join(model, "mc_id").groupBy("cluster_id")
            .agg(F.count("*").alias("members"), F.sum("w").cast("long").alias("w"),
                 (F.round(F.sum(F.col("ls")[0]), 4) + F.lit(0.0)).alias("ls0")))


@add("dbscan_fallback", f"""
WITH {ITEMS}, {TILES} SELECT mc_id AS cluster_id, n::BIGINT AS w, round(ls0, 4) + 0.0 AS ls0 FROM tiles""")
def dbscan_fallback(spark, sf):
    """Nothing within reach of anything: the micro-clusters are the result."""
    model = tiles(spark, sf).withColumnRenamed("n", "w")
    out = dbscan.offline_clusters(model, 0.01, MU, d=3)
    return out.select("cluster_id", F.col("w").cast("long").alias("w"), (F.round(F.col("ls")[0], 4) + F.lit(0.0)).alias("ls0"))


INIT_EPS, INIT_MU = 0.07, 6


@add("dbscan_init", f"""
WITH RECURSIVE {ORDERS2D}, u AS (SELECT x0, x1, count(*) AS w FROM orders2d GROUP BY x0, x1),
i AS (SELECT row_number() OVER (ORDER BY x0, x1) AS id, x0, x1, w FROM u),
near AS (SELECT a.id AS a, b.id AS b, b.w FROM i a JOIN i b ON abs(a.x0-b.x0) < {INIT_EPS} AND abs(a.x1-b.x1) < {INIT_EPS}
         AND (a.x0-b.x0)*(a.x0-b.x0) + (a.x1-b.x1)*(a.x1-b.x1) < {INIT_EPS}*{INIT_EPS}::DOUBLE),
core AS (SELECT a AS id FROM near GROUP BY a HAVING sum(w) - 1 > {INIT_MU}),
ce AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
r AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, ce.b FROM r JOIN ce ON r.b = ce.a),
comp AS (SELECT b AS id, min(a) AS label FROM r GROUP BY b),
border AS (SELECT n.a AS id, min(c.label) AS label FROM near n JOIN comp c ON n.b = c.id
           WHERE n.a NOT IN (FROM core) GROUP BY n.a),
m AS (SELECT * FROM comp UNION ALL SELECT * FROM border)
SELECT {sql_r6('any_value(s.x0)', 'seed0')}, sum(i.w)::BIGINT AS w, {sql_r6('sum(i.w * i.x0)', 'ls0')},
       {sql_r6('sum(i.w * i.x1)', 'ls1')}, {sql_r6('sum(i.w * i.x1 * i.x1)', 'ss1')}
FROM m JOIN i USING (id) JOIN i s ON s.id = m.label GROUP BY m.label""")
def dbscan_init(spark, sf):
    out = dbscan.initial_clusters(orders2d(spark, sf), INIT_EPS, INIT_MU, d=2)
    return out.select(r6(F.col("cluster")[0], "seed0"), F.col("w").cast("long").alias("w"), r6(F.col("ls")[0], "ls0"),
                      r6(F.col("ls")[1], "ls1"), r6(F.col("ss")[1], "ss1"))


WIDE_EPS, WIDE_MU = 1.15, 2


@add("dbscan_init_wide", f"""
WITH RECURSIVE i AS (SELECT vec_id AS id, list_transform(embedding, lambda v: floor(64 * v::DOUBLE) / 64) AS x FROM embeddings WHERE embedding IS NOT NULL),
near AS (SELECT a.id AS a, b.id AS b FROM i a JOIN i b ON list_sum(list_transform(list_zip(a.x, b.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))
         < {WIDE_EPS}::DOUBLE * {WIDE_EPS}::DOUBLE),
core AS (SELECT a AS id FROM near GROUP BY a HAVING count(*) - 1 > {WIDE_MU}),
ce AS (SELECT a, b FROM near WHERE a IN (FROM core) AND b IN (FROM core)),
r AS (SELECT id AS a, id AS b FROM core UNION SELECT r.a, ce.b FROM r JOIN ce ON r.b = ce.a),
comp AS (SELECT r.b AS id, min(s.x) AS label FROM r JOIN i s ON s.id = r.a GROUP BY r.b),
border AS (SELECT n.a AS id, min(c.label) AS label FROM near n JOIN comp c ON n.b = c.id WHERE n.a NOT IN (FROM core) GROUP BY n.a),
m AS (SELECT * FROM comp UNION ALL SELECT * FROM border)
SELECT {sql_r6('label[1]', 'seed0')}, {sql_r6('label[2]', 'seed1')}, count(*)::BIGINT AS w, {sql_r6('sum(x[1])', 'ls0')},
       {sql_r6('sum(x[64])', 'ls63')}, {sql_r6('sum(x[64] * x[64])', 'ss63')} FROM m JOIN i USING (id) GROUP BY label""")
def dbscan_init_wide(spark, sf):
    """Density clusters of all embeddings, 64 dimensions: rows meet at pivots."""
    points = vectors(spark, sf).select(F.transform("x", lambda v: F.floor(64 * v) / 64).alias("x"))
    out = dbscan.initial_clusters(points, WIDE_EPS, WIDE_MU, d=64)
    return out.select(r6(F.col("cluster")[0], "seed0"), r6(F.col("cluster")[1], "seed1"), F.col("w").cast("long").alias("w"),
                      r6(F.col("ls")[0], "ls0"), r6(F.col("ls")[63], "ls63"), r6(F.col("ss")[63], "ss63"))


# ---- density grid ----------------------------------------------------------------------------------

GAPS = [0.1, 0.25, 0.25]
GRID = dstream.DStreamParams(gaps=tuple(GAPS), lam=0.998, cm=190.0, cl=38.0)

CELLS = f"""pc AS (SELECT CAST(trunc(x0 / {GAPS[0]}) AS INTEGER) AS i, CAST(trunc(x1 / {GAPS[1]}) AS INTEGER) AS j,
  CAST(trunc(x2 / {GAPS[2]}) AS INTEGER) AS k, t // 365 AS tick FROM items),
now AS (SELECT max(tick) AS now FROM pc),
cells AS (SELECT i, j, k, count(*)::DOUBLE AS cnt, sum(pow(0.998, now - tick)) AS density, max(tick) AS t_update
          FROM pc CROSS JOIN now GROUP BY i, j, k),
box AS (SELECT min(i) AS i0, max(i) AS i1, min(j) AS j0, max(j) AS j1, min(k) AS k0, max(k) AS k1,
        ((max(i)-min(i)+1) * (max(j)-min(j)+1) * (max(k)-min(k)+1))::DOUBLE AS n_cells FROM cells),
classed AS (SELECT cells.*, n_cells, CASE WHEN density >= {GRID.cm} / (n_cells * (1.0 - 0.998::DOUBLE)) THEN 2
  WHEN density <= {GRID.cl} / (n_cells * (1.0 - 0.998::DOUBLE)) THEN 0 ELSE 1 END AS attr FROM cells CROSS JOIN box)"""


def _cells(spark, sf):
    """Decayed cell densities at the last tick (a tick is a year of shipping)."""
    pts = items(spark, sf).withColumn("tick", F.floor(F.col("t") / 365).cast("int"))
    now = pts.agg(F.max("tick").alias("t")).scalar()
    return pts.groupBy(g.cell_of("x", GAPS).alias("cell")).agg(
        F.count("*").cast("double").alias("count"), F.max("tick").alias("t_update"),
        F.sum(g.faded(F.lit(1.0), now - F.col("tick"), GRID.lam)).alias("density"))


def _classed(spark, sf):
    cells = _cells(spark, sf)
    n_cells = grid.bounds(cells, 3).select("n_cells").scalar()
    return grid.classify(cells, n_cells, lam=GRID.lam, cm=GRID.cm, cl=GRID.cl)


def _ijk(col="cell"):
    return [F.col(col)[a].alias(b) for a, b in enumerate("ijk")]


@add("grid_count", f"WITH {ITEMS}, {CELLS} SELECT i, j, k, cnt::BIGINT AS n FROM cells")
def grid_count(spark, sf):
    return grid.cell_counts(items(spark, sf), GAPS).select(*_ijk(), F.col("count").cast("long").alias("n"))


@add("grid_bounds", f"WITH {ITEMS}, {CELLS} SELECT i0, i1, j0, j1, k0, k1, n_cells FROM box")
def grid_bounds(spark, sf):
    b = grid.bounds(grid.cell_counts(items(spark, sf), GAPS), 3)
    return b.select(*[F.col(c)[a].alias(f"{n}{s}") for a, n in enumerate("ijk") for c, s in (("lo", 0), ("hi", 1))], "n_cells")


@add("grid_classify", f"WITH {ITEMS}, {CELLS} SELECT i, j, k, {sql_r6('density', 'density')}, attr FROM classed")
def grid_classify(spark, sf):
    return _classed(spark, sf).select(*_ijk(), r6("density", "density"), "attr")


@add("grid_sporadic", f"""
WITH {ITEMS}, {CELLS} SELECT i, j, k,
  density < 100.0 * (1.0 - pow(0.998, now - t_update + 1)) / (n_cells * (1.0 - 0.998::DOUBLE)) AS gone
FROM classed CROSS JOIN now""")
def grid_sporadic(spark, sf):
    cells = _cells(spark, sf).withColumn("t_removed", F.lit(None).cast("int"))
    n_cells = grid.bounds(cells, 3).select("n_cells").scalar()
    now = cells.agg(F.max("t_update").alias("t")).scalar()
    return cells.select(*_ijk(), g.sporadic("density", "t_update", "t_removed", now, n_cells, GRID.lam, 100.0, 0.3).alias("gone"))


ADJ = "abs(a.i-b.i) + abs(a.j-b.j) + abs(a.k-b.k) = 1"


@add("grid_neighbours", f"""
WITH {ITEMS}, {CELLS} SELECT a.i, a.j, a.k, count(*) AS n FROM cells a JOIN cells b ON {ADJ} GROUP BY a.i, a.j, a.k""")
def grid_neighbours(spark, sf):
    cells = _cells(spark, sf).select("cell")
    return grid.adjacency(cells, 3, cells).groupBy("cell").agg(F.count("*").alias("n")).select(*_ijk(), "n")


CLUSTERS = f"""dense AS (SELECT * FROM classed WHERE attr = 2),
e AS (SELECT (a.i, a.j, a.k) AS a, (b.i, b.j, b.k) AS b FROM dense a JOIN dense b ON {ADJ}),
r AS (SELECT (i, j, k) AS a, (i, j, k) AS b FROM dense UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
core AS (SELECT b AS cell, min(a) AS cluster_id FROM r GROUP BY b),
size AS (SELECT cluster_id, count(*) AS s FROM core GROUP BY cluster_id),
rimn AS (SELECT (a.i, a.j, a.k) AS cell, core.cluster_id, s FROM classed a JOIN dense b ON a.attr = 1 AND {ADJ}
         JOIN core ON core.cell = (b.i, b.j, b.k) JOIN size USING (cluster_id)),
rim AS (SELECT cell, cluster_id FROM (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY s DESC, cluster_id) AS o FROM rimn) WHERE o = 1),
members AS (SELECT cell, cluster_id FROM core UNION ALL SELECT cell, cluster_id FROM rim)"""


@add("grid_clusters", f"""
WITH RECURSIVE {ITEMS}, {CELLS}, {CLUSTERS}
SELECT cell[1] AS i, cell[2] AS j, cell[3] AS k, cluster_id[1] AS ci, cluster_id[2] AS cj, cluster_id[3] AS ck FROM members""")
def grid_clusters(spark, sf):
    out = grid.grid_clusters(_classed(spark, sf), 3)
    return out.select(*_ijk(), *[F.col("cluster_id")[a].alias(f"c{b}") for a, b in enumerate("ijk")])


@add("grid_to_mc", f"""
WITH RECURSIVE {ITEMS}, {CELLS}, {CLUSTERS}
SELECT cluster_id[1] AS ci, cluster_id[2] AS cj, cluster_id[3] AS ck, count(*) AS n,
       {sql_r6(f'sum(cell[1] * {GAPS[0]}::DOUBLE + {GAPS[0] / 2})', 'ls0')}, {sql_r6(f'sum(cell[3] * {GAPS[2]}::DOUBLE + {GAPS[2] / 2})', 'ls2')}
FROM members GROUP BY cluster_id""")
def grid_to_mc(spark, sf):
    out = grid.clusters_to_features(grid.grid_clusters(_classed(spark, sf), 3), GAPS)
    return out.select(*[F.col("cluster_id")[a].alias(f"c{b}") for a, b in enumerate("ijk")],
                      F.col("n").cast("long").alias("n"), r6(F.col("ls")[0], "ls0"), r6(F.col("ls")[2], "ls2"))


@add("grid_inside", f"""
WITH RECURSIVE {ITEMS}, {CELLS}, {CLUSTERS}
SELECT a.cell[1] AS i, a.cell[2] AS j, a.cell[3] AS k, count(b.cell) = 6 AS is_inside
FROM members a LEFT JOIN members b ON a.cluster_id = b.cluster_id
  AND abs(a.cell[1]-b.cell[1]) + abs(a.cell[2]-b.cell[2]) + abs(a.cell[3]-b.cell[3]) = 1 GROUP BY a.cell""")
def grid_inside(spark, sf):
    return grid.inside_flags(grid.grid_clusters(_classed(spark, sf), 3), 3).select(*_ijk(), "is_inside")


@add("grid_points", f"""
WITH RECURSIVE {ITEMS}, {CELLS}, {CLUSTERS}
SELECT cluster_id[1] AS ci, cluster_id[2] AS cj, cluster_id[3] AS ck, sum(cnt)::BIGINT AS n
FROM cells LEFT JOIN members ON members.cell = (i, j, k) GROUP BY cluster_id""")
def grid_points(spark, sf):
    """Points inside grid clusters (inclusion by cell)."""
    clusters = grid.grid_clusters(_classed(spark, sf), 3)
    out = grid.points_in_clusters(items(spark, sf), clusters, GAPS).groupBy("cluster_id").agg(F.count("*").alias("n"))
    return out.select(*[F.col("cluster_id")[a].alias(f"c{b}") for a, b in enumerate("ijk")], "n")


# ---- snapshots --------------------------------------------------------------------------------------


def _ticks(spark, sf):
    return visits(spark, sf).select((F.col("t") + 1).alias("tick")).distinct()


@add("pyramid_ticks", f"""
WITH {VISITS}, k AS (SELECT DISTINCT t + 1 AS tick FROM visits), n AS (SELECT max(tick) AS now FROM k)
SELECT tick FROM k CROSS JOIN n WHERE tick + 5 * 2 * (tick & -tick) > now""")
def pyramid_ticks(spark, sf):
    ticks = _ticks(spark, sf)
    return snapshots.kept_ticks(ticks, ticks.agg(F.max("tick")).scalar())


@add("snapshot_pick", f"""
WITH {VISITS}, k AS (SELECT DISTINCT t + 1 AS tick FROM visits), n AS (SELECT max(tick) AS now FROM k),
s AS (SELECT tick FROM k CROSS JOIN n WHERE tick + 5 * 2 * (tick & -tick) > now),
a AS (SELECT max(tick) AS t1 FROM s WHERE tick <= 25)
SELECT any_value(t1) AS t1, coalesce(max(CASE WHEN tick <= t1 - 7 THEN tick END), min(CASE WHEN tick > t1 - 7 THEN tick END), -1) AS t2
FROM s CROSS JOIN a""")
def snapshot_pick(spark, sf):
    return snapshots.pick(pyramid_ticks(spark, sf), 25, 7).select("t1", "t2")


@add("snapshot_diff", f"""
WITH {VISITS}, k AS (SELECT CASE WHEN event_type IN ('click', 'error') THEN 0 ELSE 1 END AS mc_id, value, t FROM visits)
SELECT mc_id, count(*) AS n, {sql_r6('sum(value)', 'ls')}, {sql_r6('sum(value * value)', 'ss')}, sum(t)::BIGINT AS lst
FROM k WHERE t > 9 AND t <= 23 GROUP BY mc_id""")
def snapshot_diff(spark, sf):
    """The newer snapshot has merged the per-type clusters into two; the older has not."""
    v = visits(spark, sf)
    kind = F.when(F.col("event_type").isin("click", "error"), 0).otherwise(1).cast("long")
    lid = F.xxhash64("event_type")
    old = cf.cf_aggregate(v.filter("t <= 9").withColumn("mc_id", lid), d=1).withColumn("ids", F.array("mc_id"))
    recent = v.filter("t <= 23")
    ids = recent.groupBy(kind.alias("mc_id")).agg(F.collect_set(lid).alias("ids"))
    new = cf.cf_aggregate(recent.withColumn("mc_id", kind), d=1).join(ids, "mc_id")
    out = snapshots.horizon_features(new, old)
    return out.select("mc_id", F.col("n").cast("long").alias("n"), r6(F.col("ls")[0], "ls"), r6(F.col("ss")[0], "ss"),
                      F.col("lst").cast("long").alias("lst"))


@add("snapshot_pruned", f"""
WITH {VISITS}, old AS (SELECT DISTINCT user_id FROM visits WHERE t <= 9), recent AS (SELECT * FROM visits WHERE t <= 23),
links AS (SELECT user_id % 4 AS mc_id, count(DISTINCT CASE WHEN o.user_id IS NULL THEN -1 ELSE user_id % 12 END) AS n_ids
  FROM (SELECT DISTINCT r.user_id FROM recent r) r LEFT JOIN old o USING (user_id) GROUP BY 1),
new AS (SELECT user_id % 4 AS mc_id, count(*) AS n, {sql_r6('sum(value)', 'ls')}, sum(t)::BIGINT AS lst FROM recent WHERE t > 9 GROUP BY 1)
SELECT mc_id, n, ls, lst, n_ids FROM new JOIN links USING (mc_id)""")
def snapshot_pruned(spark, sf):
    """A lineage id a user: the newer model keeps one for each older cluster that went into it and one for all users since, and the
    horizon query still takes off exactly the older clusters."""
    v = visits(spark, sf)

    def snapshot(rows, width):
        rows = rows.withColumn("mc_id", F.col("user_id") % width)
        return cf.cf_aggregate(rows, d=1).join(rows.groupBy("mc_id").agg(F.collect_set("user_id").alias("ids")), "mc_id")
    old, new = snapshot(v.filter("t <= 9"), 12), snapshot(v.filter("t <= 23"), 4)
    pruned = snapshots.prune_lineage(new, old.withColumn("tick", F.lit(9)))
    out = snapshots.horizon_features(pruned, old).join(pruned.select("mc_id", F.size("ids").alias("n_ids")), "mc_id")
    return out.select("mc_id", F.col("n").cast("long").alias("n"), r6(F.col("ls")[0], "ls"), F.col("lst").cast("long").alias("lst"),
                      F.col("n_ids").cast("long").alias("n_ids"))


@add("grid_average_thresholds", f"""
WITH {ITEMS}, {CELLS} SELECT {sql_r6('3.0 * avg(density)', 'dm')}, {sql_r6('0.8 * avg(density)', 'dl')} FROM cells""")
def grid_average_thresholds(spark, sf):
    return grid.average_thresholds(_cells(spark, sf), 3.0, 0.8).select(r6("dm", "dm"), r6("dl", "dl"))


@add("grid_upsert", f"""
WITH {ITEMS}, pc AS (SELECT CAST(trunc(x0 / {GAPS[0]}) AS INTEGER) AS i, CAST(trunc(x1 / {GAPS[1]}) AS INTEGER) AS j,
  CAST(trunc(x2 / {GAPS[2]}) AS INTEGER) AS k, l_returnflag FROM items),
a AS (SELECT i, j, k, count(*) AS n FROM pc WHERE l_returnflag = 'A' GROUP BY i, j, k),
b AS (SELECT i, j, k, count(*) AS n FROM pc WHERE l_returnflag <> 'A' GROUP BY i, j, k)
SELECT coalesce(a.i, b.i) AS i, coalesce(a.j, b.j) AS j, coalesce(a.k, b.k) AS k,
  {sql_r6('CASE WHEN b.n IS NULL THEN a.n ELSE coalesce(a.n, 0) * pow(0.998, 3) + b.n END', 'density')},
  CASE WHEN b.n IS NULL THEN 1 ELSE 4 END AS t_update
FROM a FULL OUTER JOIN b ON a.i = b.i AND a.j = b.j AND a.k = b.k""")
def grid_upsert(spark, sf):
    """Known cells decay and add, new ones appear, untouched ones wait."""
    pts = items(spark, sf)
    first = dstream.absorb(dstream.empty_grid(spark), grid.cell_counts(pts.filter("l_returnflag = 'A'"), GAPS), 1, GRID)
    both = dstream.absorb(first, grid.cell_counts(pts.filter("l_returnflag <> 'A'"), GAPS), 4, GRID)
    return both.select(*_ijk(), r6("density", "density"), "t_update")


@add("mc_examples", f"""
WITH {ITEMS}, {TILES} SELECT mc_id, n AS weight, {sql_r6('ls0 / n', 'c0')}, round(ls0, 4) + 0.0 AS s0 FROM tiles WHERE n > 0""")
def mc_examples(spark, sf):
    model = tiles(spark, sf)
    a = kmeans.as_examples(model).select("mc_id", "weight", r6(F.col("x")[0], "c0"))
    b = kmeans.as_examples(model, "sum").select("mc_id", (F.round(F.col("x")[0], 4) + F.lit(0.0)).alias("s0"))
    return a.join(b, "mc_id")


@add("row_slice", "WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) SELECT event_id FROM n WHERE i >= 100 AND i < 200")
def row_slice(spark, sf):
    """Rows 100 to 199: the slice is the feature."""
    from tidepool.catalog.data import table
    from tidepool.operators.rows import row_slice as cut

    return cut(table(spark, sf, "events").select("event_id"), ["event_id"], 100, 200)
