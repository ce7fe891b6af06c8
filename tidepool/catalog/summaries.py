"""Queries over assignment, cluster features and their derived scalars."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.catalog.data import (ITEMS, ORDERS2D, TILES, VECTORS, VISITS, Registry, items, label_model, orders2d, r6,
                                   sql_r6, table, tiles, vectors, visits)
from tidepool.functions import summary
from tidepool.functions.normal import normal_quantile_sql
from tidepool.operators import assign, cf, neighbours
from tidepool.session import MAX_FLOAT

registry = Registry()
add = registry.add

BIG = repr(MAX_FLOAT)

#: centre and spread radius of every tile
TILE_SPHERES = f"""spheres AS (
  SELECT mc_id, n, ls0/n AS c0, ls1/n AS c1, ls2/n AS c2,
         CASE WHEN n > 1 THEN sqrt(
           (CASE WHEN ss0/n-(ls0/n)*(ls0/n) <= 0 AND ss0/n-(ls0/n)*(ls0/n) > -5e-5 THEN 1e-50 ELSE ss0/n-(ls0/n)*(ls0/n) END)
         + (CASE WHEN ss1/n-(ls1/n)*(ls1/n) <= 0 AND ss1/n-(ls1/n)*(ls1/n) > -5e-5 THEN 1e-50 ELSE ss1/n-(ls1/n)*(ls1/n) END)
         + (CASE WHEN ss2/n-(ls2/n)*(ls2/n) <= 0 AND ss2/n-(ls2/n)*(ls2/n) > -5e-5 THEN 1e-50 ELSE ss2/n-(ls2/n)*(ls2/n) END)
         ) ELSE {BIG} END AS rms
  FROM tiles)"""

#: distinct positions against all tile centres
TILE_NEAR = """pos AS (SELECT x0, x1, x2, count(*) AS k, sum(t) AS st FROM items GROUP BY x0, x1, x2),
near AS (SELECT x0, x1, x2, k, st, arg_min(mc_id, d2) AS mc_id, arg_min(rms, d2) AS rms, sqrt(min(d2)) AS dist FROM (
  SELECT p.*, s.mc_id, s.rms, (p.x0-s.c0)*(p.x0-s.c0) + (p.x1-s.c1)*(p.x1-s.c1) + (p.x2-s.c2)*(p.x2-s.c2) AS d2
  FROM pos p CROSS JOIN spheres s) GROUP BY x0, x1, x2, k, st)"""


@add("assign_nearest", f"""
WITH {VECTORS}
SELECT vec_id, label, mc_id, {sql_r6('dist', 'dist')} FROM near""")
def assign_nearest(spark, sf):
    near = assign.assign_nearest(vectors(spark, sf), assign.centres_of(label_model(spark, sf)))
    return near.select("vec_id", "label", "mc_id", r6("dist", "dist"))


@add("assign_nearest_items", f"""
WITH {ITEMS}, {TILES}, {TILE_SPHERES}, {TILE_NEAR}
SELECT mc_id, sum(k)::BIGINT AS n, {sql_r6('sum(k * dist)', 'dist')} FROM near GROUP BY mc_id""")
def assign_nearest_items(spark, sf):
    near = assign.assign_nearest(items(spark, sf), assign.centres_of(tiles(spark, sf)))
    return near.groupBy("mc_id").agg(F.count("*").alias("n"), r6(F.sum("dist"), "dist"))


@add("assign_many_centres", f"""
WITH {ORDERS2D},
centres AS (SELECT o_custkey AS mc_id, max(o_totalprice) / 65536 AS c0, date_diff('day', DATE '1995-01-01', CAST(max(o_orderdate) AS DATE)) / 512.0::DOUBLE AS c1
            FROM orders GROUP BY o_custkey),
pos AS (SELECT x0, x1, count(*) AS k FROM orders2d GROUP BY x0, x1),
d AS (SELECT x0, x1, k, mc_id, (x0-c0)*(x0-c0) + (x1-c1)*(x1-c1) AS d2 FROM pos CROSS JOIN centres),
least AS (SELECT x0, x1, min(d2) AS d2 FROM d GROUP BY x0, x1),
near AS (SELECT x0, x1, any_value(k) AS k, min(mc_id) AS mc_id, sqrt(any_value(d2)) AS dist FROM d JOIN least USING (x0, x1, d2) GROUP BY x0, x1)
SELECT mc_id, sum(k)::BIGINT AS n, {sql_r6('max(dist)', 'dist')} FROM near GROUP BY mc_id""")
def assign_many_centres(spark, sf):
    """A centre a customer, too many to try for every row: the lookup goes through the index over the centres."""
    day = F.datediff(F.max("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    centres = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("mc_id")).agg(
        F.array(F.max("o_totalprice") / 65536, day / 512.0).alias("centre"))
    near = assign.assign_nearest(orders2d(spark, sf), centres)
    return near.groupBy("mc_id").agg(F.count("*").alias("n"), r6(F.max("dist"), "dist"))


@add("assign_radius", f"""
WITH {ITEMS}, {TILES}, {TILE_SPHERES}, {TILE_NEAR}
SELECT CASE WHEN dist <= 1.2 * rms THEN mc_id ELSE -1 END AS mc_id, sum(k)::BIGINT AS n, sum(st)::BIGINT AS lst
FROM near GROUP BY 1""")
def assign_radius(spark, sf):
    hit = assign.assign_within_radius(items(spark, sf), tiles(spark, sf), factor=1.2)
    return hit.groupBy("mc_id").agg(F.count("*").alias("n"), F.sum("t").alias("lst"))


@add("assign_weighted", f"""
WITH {VISITS}, u AS (SELECT user_id, sum(value) AS s, count(*) AS w FROM visits GROUP BY user_id),
m AS (SELECT row_number() OVER (ORDER BY event_type) - 1 AS mc_id, avg(value) AS c FROM visits GROUP BY event_type),
d AS (SELECT user_id, s, w, mc_id, abs(c - s / w) AS dist FROM u CROSS JOIN m)
SELECT user_id, arg_min(mc_id, dist)::BIGINT AS cluster, {sql_r6('min(dist) * any_value(w)', 'dist')} FROM d GROUP BY user_id""")
def assign_weighted(spark, sf):
    from tidepool.operators.rows import number_rows

    v = visits(spark, sf)
    users = v.groupBy("user_id").agg(F.array(F.sum("value")).alias("x"), F.count("*").cast("double").alias("weight"))
    types = v.groupBy("event_type").agg(F.array(F.avg("value")).alias("centre"))
    centres = number_rows(types, ["event_type"], "mc_id").select("mc_id", "centre")
    out = assign.assign_weighted(users, centres)
    return out.select("user_id", "cluster", r6("dist", "dist"))


@add("nearest_other", f"""
WITH {ITEMS}, {TILES}
SELECT a.mc_id, {sql_r6('min(sqrt((a.ls0/a.n-b.ls0/b.n)**2 + (a.ls1/a.n-b.ls1/b.n)**2 + (a.ls2/a.n-b.ls2/b.n)**2))', 'gap')}
FROM tiles a JOIN tiles b ON a.mc_id <> b.mc_id GROUP BY a.mc_id""")
def nearest_other(spark, sf):
    centres = assign.centres_of(tiles(spark, sf))
    return assign.nearest_other_centre(centres, centres).select("mc_id", r6("gap", "gap"))


@add("closest_pair", f"""
WITH {ITEMS}, {TILES}, c AS (SELECT mc_id, ls0/n AS c0, ls1/n AS c1, ls2/n AS c2 FROM tiles)
SELECT a.mc_id AS id_a, b.mc_id AS id_b,
       {sql_r6('sqrt((a.c0-b.c0)*(a.c0-b.c0) + (a.c1-b.c1)*(a.c1-b.c1) + (a.c2-b.c2)*(a.c2-b.c2))', 'gap')}
FROM c a JOIN c b ON a.mc_id < b.mc_id
ORDER BY (a.c0-b.c0)*(a.c0-b.c0) + (a.c1-b.c1)*(a.c1-b.c1) + (a.c2-b.c2)*(a.c2-b.c2), id_a, id_b LIMIT 1""")
def closest_pair(spark, sf):
    pair = neighbours.closest_pair(assign.centres_of(tiles(spark, sf)))
    return pair.select("id_a", "id_b", r6("gap", "gap"))


def _cf_rows(features, keys):
    long = cf.to_long(features, keys)
    return long.select(*keys, "dim", F.col("n").cast("long").alias("n"), r6("ls", "ls"), r6("ss", "ss"),
                       F.col("lst").cast("long").alias("lst"), F.col("sst").cast("long").alias("sst"),
                       F.col("t_max").cast("long").alias("t_max"))


CF_EVENTS = f"""
WITH {VISITS}, m AS (SELECT user_id, event_type, value AS v, t FROM visits)
SELECT user_id, event_type, 0 AS dim, count(*) AS n, {sql_r6('sum(v)', 'ls')}, {sql_r6('sum(v * v)', 'ss')},
       sum(t)::BIGINT AS lst, sum(t * t)::BIGINT AS sst, max(t) AS t_max FROM m GROUP BY user_id, event_type"""


@add("cf_aggregate", CF_EVENTS)
def cf_aggregate(spark, sf):
    return _cf_rows(cf.cf_aggregate(visits(spark, sf), ["user_id", "event_type"], d=1), ["user_id", "event_type"])


@add("cf_sorted_fold", f"""
WITH {ITEMS}, l AS (SELECT l_returnflag, 0 AS dim, x0 AS v, t FROM items UNION ALL SELECT l_returnflag, 1, x1, t FROM items
                    UNION ALL SELECT l_returnflag, 2, x2, t FROM items)
SELECT l_returnflag, dim, count(*) AS n, round(sum(v), 4) + 0.0 AS ls, round(sum(v * v), 4) + 0.0 AS ss, sum(t)::BIGINT AS lst,
       sum(t * t)::BIGINT AS sst, max(t) AS t_max FROM l GROUP BY l_returnflag, dim""")
def cf_sorted_fold(spark, sf):
    """The event-time ordered fold: the same sums, since addition commutes."""
    long = cf.to_long(cf.cf_aggregate(items(spark, sf), "l_returnflag", d=3), ["l_returnflag"])
    r4 = lambda c: (F.round(c, 4) + F.lit(0.0)).alias(c)
    return long.select("l_returnflag", "dim", F.col("n").cast("long").alias("n"), r4("ls"), r4("ss"),
                       *[F.col(c).cast("long").alias(c) for c in ("lst", "sst", "t_max")])


@add("cf_batch_time", f"""
WITH {VISITS}
SELECT user_id, count(*) AS n, {sql_r6('sum(value)', 'ls')}, {sql_r6('sum(value * value)', 'ss')},
       (count(*) * 10000)::BIGINT AS lst FROM visits GROUP BY user_id""")
def cf_batch_time(spark, sf):
    out = cf.cf_batch_time(visits(spark, sf), 10_000, "user_id", d=1)
    return out.select("user_id", F.col("n").cast("long").alias("n"), r6(F.col("ls")[0], "ls"), r6(F.col("ss")[0], "ss"),
                      F.col("lst").cast("long").alias("lst"))


@add("cf_merge", f"""
WITH {ITEMS}, {TILES}
SELECT mc_id // 100 AS mc_id, sum(n)::BIGINT AS n, round(sum(ls0), 4) + 0.0 AS ls0, round(sum(ss2), 4) + 0.0 AS ss2,
       sum(lst)::BIGINT AS lst FROM tiles GROUP BY 1""")
def cf_merge(spark, sf):
    coarse = tiles(spark, sf).withColumn("mc_id", F.floor(F.col("mc_id") / 100).cast("long"))
    out = cf.cf_merge(coarse, d=3)
    return out.select("mc_id", F.col("n").cast("long").alias("n"), (F.round(F.col("ls")[0], 4) + F.lit(0.0)).alias("ls0"),
                      (F.round(F.col("ss")[2], 4) + F.lit(0.0)).alias("ss2"), F.col("lst").cast("long").alias("lst"))


@add("mc_weights", f"""
WITH {ITEMS}, {TILES}
SELECT mc_id, {sql_r6('n / sum(n) OVER ()', 'weight')}, {sql_r6('ls0 / n', 'c0')} FROM tiles WHERE n > 0""")
def mc_weights(spark, sf):
    return cf.mc_weights(tiles(spark, sf)).select("mc_id", r6("weight", "weight"), r6(F.col("centre")[0], "c0"))


LAM = 0.25


@add("cf_decayed", f"""
WITH {VISITS}, a AS (SELECT *, max(t) OVER (PARTITION BY user_id) AS tl FROM visits)
SELECT user_id, any_value(tl) AS t_last, {sql_r6(f'sum(pow(2, -{LAM} * (tl - t)))', 'w')},
       {sql_r6(f'sum(pow(2, -{LAM} * (tl - t)) * value)', 'ls')},
       {sql_r6(f'sum(pow(2, -{LAM} * (tl - t)) * value * value)', 'ss')} FROM a GROUP BY user_id""")
def cf_decayed(spark, sf):
    out = cf.decayed_cf(visits(spark, sf), "user_id", lam=LAM, d=1)
    return out.select("user_id", "t_last", r6("w", "w"), r6(F.col("ls")[0], "ls"), r6(F.col("ss")[0], "ss"))


@add("cf_decayed_sorted", f"""
WITH {VISITS}, a AS (SELECT *, max(t) OVER () AS tl FROM visits)
SELECT event_type, any_value(tl) AS t_last, {sql_r6(f'sum(pow(2, -{LAM} * (tl - t)))', 'w')},
       {sql_r6(f'sum(pow(2, -{LAM} * (tl - t)) * value)', 'ls')},
       {sql_r6(f'pow(2, -{LAM} * 3) * sum(pow(2, -{LAM} * (tl - t)))', 'w_later')} FROM a GROUP BY event_type""")
def cf_decayed_sorted(spark, sf):
    """Anchored at the batch's latest time, then faded by three more ticks."""
    v = visits(spark, sf)
    now = v.agg(F.max("t").alias("t")).scalar()
    out = cf.decayed_cf(v, "event_type", lam=LAM, d=1, anchor=now)
    return out.select("event_type", "t_last", r6("w", "w"), r6(F.col("ls")[0], "ls"),
                      r6(summary.decayed("w", F.lit(3), LAM), "w_later"))


@add("mc_centroid_radius", f"""
WITH {ITEMS}, {TILES}, v AS (SELECT *, ls0/n AS c0, ls1/n AS c1, ls2/n AS c2,
  ss0/n-(ls0/n)*(ls0/n) AS v0, ss1/n-(ls1/n)*(ls1/n) AS v1, ss2/n-(ls2/n)*(ls2/n) AS v2 FROM tiles),
w AS (SELECT *, CASE WHEN v0 <= 0 AND v0 > -5e-5 THEN 1e-50 ELSE v0 END AS u0,
  CASE WHEN v1 <= 0 AND v1 > -5e-5 THEN 1e-50 ELSE v1 END AS u1,
  CASE WHEN v2 <= 0 AND v2 > -5e-5 THEN 1e-50 ELSE v2 END AS u2 FROM v)
SELECT mc_id, {sql_r6('c0', 'c0')}, {sql_r6('c1', 'c1')}, {sql_r6('c2', 'c2')},
  {sql_r6(f'CASE WHEN n > 1 THEN 2.0 * sqrt(u0 + u1 + u2) END', 'spread')},
  {sql_r6(f'CASE WHEN n > 1 THEN sqrt(greatest(v0, v1, v2, 0)) END', 'widest')},
  {sql_r6(f'CASE WHEN n > 1 THEN sqrt(greatest(ss0 - n*c0*c0 + ss1 - n*c1*c1 + ss2 - n*c2*c2, 0) / n) END', 'rmse')},
  {sql_r6('sqrt(greatest(v0, 0) + greatest(v1, 0) + greatest(v2, 0))', 'sphere')}
FROM w""")
def mc_centroid_radius(spark, sf):
    c = F.col("c")
    many = F.col("n") > 1
    return tiles(spark, sf).withColumn("c", summary.centroid()).select(
        "mc_id", r6(c[0], "c0"), r6(c[1], "c1"), r6(c[2], "c2"),
        r6(F.when(many, summary.spread_radius(factor=2.0)), "spread"),
        r6(F.when(many, summary.widest_radius("n")), "widest"),
        r6(F.when(many, summary.rmse()), "rmse"), r6(summary.sphere_radius(), "sphere"))


RECENT = 50


@add("mc_relevance", f"""
WITH {ITEMS}, {TILES}, s AS (SELECT mc_id, n, lst/n AS mu, sqrt(greatest(sst/n - (lst/n)*(lst/n), 0)) AS sd FROM tiles)
SELECT mc_id, {sql_r6(f"CASE WHEN n < {2 * RECENT} THEN mu ELSE mu + sd * ({normal_quantile_sql(f'1.0 - {RECENT}.0 / (2.0 * n)')}) END", 'stamp')} FROM s""")
def mc_relevance(spark, sf):
    return tiles(spark, sf).select("mc_id", r6(summary.relevance_stamp(RECENT), "stamp"))


@add("safe_delete", f"""
WITH {ITEMS}, {TILES}, s AS (SELECT mc_id, n, lst/n AS mu, sqrt(greatest(sst/n - (lst/n)*(lst/n), 0)) AS sd,
  max(t_max) OVER () AS now FROM tiles)
SELECT mc_id, (CASE WHEN n < {2 * RECENT} THEN mu ELSE mu + sd * ({normal_quantile_sql(f'1.0 - {RECENT}.0 / (2.0 * n)')}) END)
  < now - 300 OR n = 0 AS gone FROM s""")
def safe_delete(spark, sf):
    t = tiles(spark, sf)
    now = t.agg(F.max("t_max").alias("t")).scalar()
    return t.select("mc_id", summary.deletable(RECENT, now, 300).alias("gone"))


@add("assign_and_summarise", f"""
WITH {VECTORS}, cl AS (SELECT near.mc_id, vl.dim, count(*) AS n, sum(v) AS ls, sum(v * v) AS ss
                       FROM near JOIN vl USING (vec_id) GROUP BY near.mc_id, vl.dim)
SELECT mc_id, any_value(n) AS n, {sql_r6('max(CASE WHEN dim = 0 THEN ls / n END)', 'c0')},
       {sql_r6('CASE WHEN any_value(n) > 1 THEN 2 * sqrt(sum(ss / n - (ls / n) * (ls / n))) END', 'radius')}
FROM cl GROUP BY mc_id""")
def flagship(spark, sf):
    """Label centroids as the model, every vector to its nearest one, features of the result."""
    near = assign.assign_nearest(vectors(spark, sf), assign.centres_of(label_model(spark, sf)))
    features = cf.cf_aggregate(near, t=None, d=64)
    return features.select("mc_id", F.col("n").cast("long").alias("n"), r6(summary.centroid()[0], "c0"),
                           r6(F.when(F.col("n") > 1, summary.spread_radius(factor=2.0)), "radius"))
