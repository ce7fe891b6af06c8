"""Queries over decaying micro-clusters: trial insertion, promotion, pruning."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.catalog.data import ITEMS, Registry, items, r6, sql_r6
from tidepool.functions import summary
from tidepool.operators import assign, cf, fold
from tidepool.plans import clustream, denstream, dstream, streaming_kmeans
from tidepool.session import fresh_dir

registry = Registry()
add = registry.add

LAM, EPS = 0.02, 0.1

#: tiles as decaying clusters: 'p' where the last tax band is even, else 'o'
MODEL = f"""dm AS (SELECT tile, max(t) AS tl, min(t) AS t0 FROM items GROUP BY tile),
model AS (SELECT i.tile AS mc_id, CASE WHEN i.tile % 2 = 0 THEN 'p' ELSE 'o' END AS kind, any_value(tl) AS t_last, any_value(t0) AS t0,
  sum(f) AS w, sum(f*x0) AS ls0, sum(f*x1) AS ls1, sum(f*x2) AS ls2, sum(f*x0*x0) AS ss0, sum(f*x1*x1) AS ss1, sum(f*x2*x2) AS ss2
  FROM (SELECT items.*, tl, dm.t0, pow(2.0, -{LAM} * (tl - t)) AS f FROM items JOIN dm USING (tile)) i GROUP BY i.tile)"""


def _model(spark, sf):
    rows = items(spark, sf).withColumnRenamed("tile", "mc_id")
    out = cf.decayed_cf(rows, lam=LAM, d=3)
    kind = F.when(F.col("mc_id") % 2 == 0, "p").otherwise("o")
    return out.select("mc_id", kind.alias("kind"), "w", "ls", "ss", "t0", "t_last")


def _trial(kind: str, source: str) -> str:
    """Nearest cluster of a kind, then the radius after decay and insertion."""
    return f"""n{kind} AS (SELECT x0, x1, x2, t, k, arg_min(mc_id, d2) AS mc_id FROM (
  SELECT p.*, m.mc_id, (p.x0-m.ls0/m.w)*(p.x0-m.ls0/m.w) + (p.x1-m.ls1/m.w)*(p.x1-m.ls1/m.w) + (p.x2-m.ls2/m.w)*(p.x2-m.ls2/m.w) AS d2
  FROM {source} p JOIN model m ON m.kind = '{kind}') GROUP BY x0, x1, x2, t, k),
tr{kind} AS (SELECT n.*, w*f + 1 AS w1, ls0*f + x0 AS a0, ls1*f + x1 AS a1, ls2*f + x2 AS a2,
  ss0*f + x0*x0 AS b0, ss1*f + x1*x1 AS b1, ss2*f + x2*x2 AS b2
  FROM (SELECT n{kind}.*, m.w, m.ls0, m.ls1, m.ls2, m.ss0, m.ss1, m.ss2, pow(2.0, -{LAM} * (n{kind}.t - m.t_last)) AS f
        FROM n{kind} JOIN model m USING (mc_id)) n),
h{kind} AS (SELECT x0, x1, x2, t, k, CASE WHEN w1 > 1 AND sqrt(greatest(b0/w1-(a0/w1)*(a0/w1), b1/w1-(a1/w1)*(a1/w1),
  b2/w1-(a2/w1)*(a2/w1), 0)) <= {EPS} THEN mc_id ELSE -1 END AS mc_id FROM tr{kind})"""


POS = "pos AS (SELECT x0, x1, x2, t, count(*) AS k FROM items GROUP BY x0, x1, x2, t)"


@add("den_assign_p", f"""
WITH {ITEMS}, {MODEL}, {POS}, {_trial('p', 'pos')}
SELECT mc_id, sum(k)::BIGINT AS n, sum(k * t)::BIGINT AS st FROM hp GROUP BY mc_id""")
def den_assign_p(spark, sf):
    hit = assign.assign_decaying(items(spark, sf), _model(spark, sf), eps=EPS, lam=LAM, kinds=("p",))
    return hit.groupBy("mc_id").agg(F.count("*").alias("n"), F.sum("t").alias("st"))


@add("den_assign_all", f"""
WITH {ITEMS}, {MODEL}, {POS}, {_trial('p', 'pos')}, miss AS (SELECT x0, x1, x2, t, k FROM hp WHERE mc_id = -1), {_trial('o', 'miss')},
every AS (SELECT 'p' AS kind, mc_id, k, t FROM hp WHERE mc_id <> -1
          UNION ALL SELECT CASE WHEN mc_id = -1 THEN 'none' ELSE 'o' END, mc_id, k, t FROM ho)
SELECT kind, mc_id, sum(k)::BIGINT AS n, sum(k * t)::BIGINT AS st FROM every GROUP BY kind, mc_id""")
def den_assign_all(spark, sf):
    hit = assign.assign_decaying(items(spark, sf), _model(spark, sf), eps=EPS, lam=LAM)
    return hit.groupBy(F.coalesce("kind", F.lit("none")).alias("kind"), "mc_id").agg(
        F.count("*").alias("n"), F.sum("t").alias("st"))


@add("den_fold", f"""
WITH {ITEMS}, {MODEL}, {POS}, {_trial('p', 'pos')}, miss AS (SELECT x0, x1, x2, t, k FROM hp WHERE mc_id = -1), {_trial('o', 'miss')},
every AS (SELECT mc_id, k, t, x0 FROM hp WHERE mc_id <> -1 UNION ALL SELECT mc_id, k, t, x0 FROM ho WHERE mc_id <> -1),
now AS (SELECT max(t) AS now FROM items)
SELECT mc_id, {sql_r6(f'sum(k * pow(2.0, -{LAM} * (now - t)))', 'w')}, {sql_r6(f'sum(k * x0 * pow(2.0, -{LAM} * (now - t)))', 'ls0')}
FROM every CROSS JOIN now GROUP BY mc_id""")
def den_fold(spark, sf):
    """Assignment and decayed sums in one pass; partial sums brought to the latest time."""
    pts = items(spark, sf)
    parts = fold.fold_decaying(pts, _model(spark, sf), eps=EPS, lam=LAM).filter("mc_id >= 0")
    now = pts.agg(F.max("t")).scalar()
    out = cf.decayed_merge(parts, now, LAM, d=3)
    return out.select("mc_id", r6("w", "w"), r6(F.col("ls")[0], "ls0"))


FLOOR = 12.0


@add("den_promote", f"""
WITH {ITEMS}, {MODEL} SELECT mc_id, CASE WHEN kind = 'o' AND w >= {FLOOR} THEN 'p' ELSE kind END AS kind, {sql_r6('w', 'w')} FROM model""")
def den_promote(spark, sf):
    return denstream.promote(_model(spark, sf), FLOOR).select("mc_id", "kind", r6("w", "w"))


PRUNE = denstream.DenStreamParams(eps=EPS, mu=40.0, beta=0.3, lam=LAM, tp=30)


@add("den_prune", f"""
WITH {ITEMS}, {MODEL}, n AS (SELECT max(t_last) + 5 AS now FROM model),
f AS (SELECT model.*, now, w * pow(2.0, -{LAM} * (now - t_last)) AS wn,
      (pow(2.0, -{LAM} * (now - t0 + 30)) - 1) / (pow(2.0, -{LAM} * 30) - 1) AS xi FROM model CROSS JOIN n)
SELECT mc_id, kind, {sql_r6('w', 'w')} FROM f WHERE (kind = 'p' AND wn >= {PRUNE.p_floor}) OR (kind = 'o' AND wn >= xi)""")
def den_prune(spark, sf):
    model = _model(spark, sf)
    now = model.agg(F.max("t_last").alias("t")).first()["t"] + 5
    return denstream.prune(model, now, PRUNE).select("mc_id", "kind", r6("w", "w"))


# ---- forgetful k-means ----------------------------------------------------------------------------


@add("streaming_kmeans_update", f"""
WITH {ITEMS}, s AS (SELECT l_linenumber - 1 AS mc_id, avg(x0) AS c0, avg(x1) AS c1, avg(x2) AS c2 FROM items GROUP BY 1),
pos AS (SELECT x0, x1, x2, count(*) AS k FROM items GROUP BY x0, x1, x2),
near AS (SELECT x0, x1, x2, k, arg_min(mc_id, d2) AS mc_id FROM (SELECT p.*, s.mc_id,
  (p.x0-s.c0)*(p.x0-s.c0) + (p.x1-s.c1)*(p.x1-s.c1) + (p.x2-s.c2)*(p.x2-s.c2) AS d2 FROM pos p CROSS JOIN s) GROUP BY x0, x1, x2, k),
b AS (SELECT mc_id, sum(k)::DOUBLE AS m, sum(k*x0) AS s0, sum(k*x1) AS s1, sum(k*x2) AS s2 FROM near GROUP BY mc_id)
SELECT s.mc_id::BIGINT AS mc_id, {sql_r6('(c0 * 500 + s0) / (500 + m)', 'c0')}, {sql_r6('(c1 * 500 + s1) / (500 + m)', 'c1')},
       {sql_r6('(c2 * 500 + s2) / (500 + m)', 'c2')}, {sql_r6('500 + m', 'weight')} FROM s JOIN b USING (mc_id)""")
def streaming_kmeans_update(spark, sf):
    pts = items(spark, sf)
    start = pts.groupBy((F.col("l_linenumber") - 1).cast("long").alias("mc_id")).agg(
        F.array(*[F.avg(F.col("x")[j]) for j in range(3)]).alias("centre")).withColumn("weight", F.lit(1000.0))
    out = streaming_kmeans.update(start, pts, 0.5)
    return out.select("mc_id", *[r6(F.col("centre")[j], f"c{j}") for j in range(3)], r6("weight", "weight"))


# ---- whole runs over yearly batches ------------------------------------------------------------------


def _years(spark, sf):
    """Batches by year, the earliest first; rows without a date come with the first day.

    Written once by year, so that a batch reads its own rows only.
    """
    path = fresh_dir(spark, "years")
    pts = items(spark, sf).withColumn("t", F.coalesce("t", F.lit(0)))
    pts.withColumn("year", F.floor(F.col("t") / 365).cast("int")).write.partitionBy("year").parquet(path)
    kept = spark.read.parquet(path)
    for year in sorted(r["year"] for r in kept.select("year").distinct().collect()):
        yield kept.filter(F.col("year") == year).drop("year")


def _tile_start(spark, sf):
    from tidepool.catalog.data import tiles

    centres = assign.centres_of(tiles(spark, sf))
    return clustream._model(centres)


@add("clustream_run")
def clustream_run(spark, sf):
    """Seven yearly batches; the row count of the stream is conserved up to deleted clusters."""
    state = clustream.Clustering(_tile_start(spark, sf))
    params = clustream.CluStreamParams(q=45, m=50, horizon=365.0, t_factor=1.5)
    for batch in _years(spark, sf):
        state = clustream.step(state, batch, params)
    return state.model.select("mc_id", r6("n", "n"), *[r6(summary.centroid()[j], f"c{j}") for j in range(3)])


@add("clustream_run_batch_time")
def clustream_run_batch_time(spark, sf):
    state = clustream.Clustering(_tile_start(spark, sf))
    params = clustream.CluStreamParams(q=45, m=50, horizon=10_000.0, t_factor=1.5, order="batch_time")
    for batch in _years(spark, sf):
        state = clustream.step(state, batch, params)
    return state.model.select("mc_id", r6("n", "n"), *[r6(summary.centroid()[j], f"c{j}") for j in range(3)])


@add("denstream_run")
def denstream_run(spark, sf):
    """Initial clusters by k-means from all positions, then yearly batches with pruning."""
    pts = items(spark, sf)
    start = denstream.init_kmeans(pts, 20, seed=5)
    state = denstream.DecayingState(start)
    params = denstream.DenStreamParams(eps=0.12, mu=40.0, beta=0.3, lam=0.01)
    for batch in _years(spark, sf):
        state = denstream.step(state, batch, params)
    final = denstream.finish(state, params)
    return final.model.select("mc_id", "kind", r6("w", "w"), *[r6(summary.centroid("w", "ls")[j], f"c{j}") for j in range(3)])


@add("dstream_run", f"""
WITH {ITEMS}, pc AS (SELECT CAST(trunc(x0 / 0.1) AS INTEGER) AS i, CAST(trunc(x1 / 0.25) AS INTEGER) AS j,
  CAST(trunc(x2 / 0.25) AS INTEGER) AS k, t // 365 + 1 AS tick FROM items),
now AS (SELECT max(tick) AS now FROM pc),
cells AS (SELECT i, j, k, sum(pow(0.998, now - tick)) AS density FROM pc CROSS JOIN now GROUP BY i, j, k),
box AS (SELECT ((max(i)-min(i)+1) * (max(j)-min(j)+1) * (max(k)-min(k)+1))::DOUBLE AS n_cells FROM cells)
SELECT i, j, k, {sql_r6('density', 'density')}, CASE WHEN density >= 190.0 / (n_cells * (1.0 - 0.998::DOUBLE)) THEN 2
  WHEN density <= 38.0 / (n_cells * (1.0 - 0.998::DOUBLE)) THEN 0 ELSE 1 END AS attr FROM cells CROSS JOIN box""")
def dstream_run(spark, sf):
    """A tick per year, nothing thin enough to be dropped: densities equal their closed form."""
    params = dstream.DStreamParams(gaps=(0.1, 0.25, 0.25), lam=0.998, cm=190.0, cl=38.0, beta=1e9)
    state = dstream.GridState(dstream.empty_grid(spark))
    for batch in _years(spark, sf):
        state = dstream.step(state, batch, params)
    return state.model.filter("density IS NOT NULL").select(
        *[F.col("cell")[a].alias(b) for a, b in enumerate("ijk")], r6("density", "density"), "attr")


# ---- removal and repair of grid clusters ------------------------------------------------------------------

REPAIR_LAM, REPAIR_BETA = 0.5, 0.3
#: which rows come at each tick
REPAIR_TICKS = ("l_linenumber <= 3", "l_linenumber = 4 AND l_quantity < 25", "l_linenumber = 5 AND l_quantity >= 20", "l_linenumber >= 6 AND l_quantity < 40")


def _repair_sql() -> str:
    parts = [f"WITH RECURSIVE {ITEMS}, pc AS (SELECT CAST(trunc(x0 / 0.1) AS INTEGER) AS i, CAST(trunc(x1 / 0.25) AS INTEGER) AS j,"
             " CAST(trunc(x2 / 0.25) AS INTEGER) AS k, l_linenumber, x0 * 64 AS l_quantity FROM items),"
             " par AS (SELECT 0.22::DOUBLE * count(*) AS cm, 0.1::DOUBLE * count(*) AS cl FROM items),"
             " s0 AS (SELECT 0 AS i, 0 AS j, 0 AS k, NULL::DOUBLE AS dens, 0 AS upd, NULL::INTEGER AS rem WHERE false)"]
    for t, rows in enumerate(REPAIR_TICKS, 1):
        floor = f"cl * (1.0::DOUBLE - pow(0.5::DOUBLE, {t} - upd + 1)) / (n * 0.5::DOUBLE)"
        gone = (f"dens IS NOT NULL AND dens * pow(0.5::DOUBLE, {t} - upd) < {floor} AND (coalesce(rem, 0) = 0 OR {t} >= 1.3::DOUBLE * rem)"
                if t > 1 else "false")
        parts.append(
            f"c{t} AS (SELECT i, j, k, count(*)::DOUBLE AS cnt FROM pc WHERE {rows} GROUP BY i, j, k),"
            f" a{t} AS (SELECT i, j, k, CASE WHEN cnt IS NULL THEN dens ELSE coalesce(dens, 0.0::DOUBLE) * pow(0.5::DOUBLE, {t} - coalesce(upd, {t})) + cnt END AS dens,"
            f" CASE WHEN cnt IS NULL THEN upd ELSE {t} END AS upd, rem FROM s{t - 1} FULL JOIN c{t} USING (i, j, k)),"
            f" b{t} AS (SELECT ((max(i)-min(i)+1) * (max(j)-min(j)+1) * (max(k)-min(k)+1))::DOUBLE AS n FROM pc WHERE "
            + " OR ".join(f"({r})" for r in REPAIR_TICKS[:t]) + "),"
            f" s{t} AS (SELECT i, j, k, CASE WHEN gone THEN NULL ELSE dens * pow(0.5::DOUBLE, {t} - upd) END AS dens,"
            f" CASE WHEN gone OR dens IS NULL THEN upd ELSE {t} END AS upd, CASE WHEN gone THEN {t} ELSE rem END AS rem"
            f" FROM (SELECT *, {gone} AS gone FROM a{t} CROSS JOIN b{t} CROSS JOIN par)"
            f" WHERE NOT ((gone OR dens IS NULL) AND {t} >= 1.3::DOUBLE * CASE WHEN gone THEN {t} ELSE rem END))")
    last = len(REPAIR_TICKS)
    parts.append(
        f"f AS (SELECT i, j, k, dens, rem, i * 10000 + j * 100 + k AS id, CASE WHEN dens >= cm / (n * 0.5::DOUBLE) THEN 2 WHEN dens <= cl / (n * 0.5::DOUBLE) THEN 0 ELSE 1 END AS attr"
        f" FROM s{last} CROSS JOIN b{last} CROSS JOIN par WHERE dens IS NOT NULL),"
        " e AS (SELECT a.id AS a, b.id AS b FROM f a JOIN f b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) = 1 WHERE b.attr = 2),"
        " r AS (SELECT id AS a, id AS b FROM f WHERE attr = 2 UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a WHERE r.a IN (SELECT id FROM f WHERE attr = 2)),"
        " core AS (SELECT b AS id, min(a) AS c FROM r GROUP BY b), size AS (SELECT c, count(*) AS n FROM core GROUP BY c),"
        " rim AS (SELECT e.a AS id, arg_min(c, (-n, c)) AS c FROM e JOIN core ON core.id = e.b JOIN size USING (c) JOIN f ON f.id = e.a AND f.attr = 1 GROUP BY e.a),"
        " m AS (SELECT * FROM core UNION ALL SELECT * FROM rim)")
    return ", ".join(parts) + f" SELECT i, j, k, {sql_r6('dens', 'density')}, attr, rem AS t_removed, m.c AS cluster_id FROM f LEFT JOIN m USING (id)"


@add("dstream_repair", _repair_sql())
def dstream_repair(spark, sf):
    """Ticks over different parts of the rows: cells change class, thin ones are removed, some come back; clusters are repaired at each."""
    rows = items(spark, sf).withColumn("l_quantity", F.col("x")[0] * 64)
    total = rows.count()
    params = dstream.DStreamParams(gaps=(0.1, 0.25, 0.25), lam=REPAIR_LAM, cm=0.22 * total, cl=0.1 * total, beta=REPAIR_BETA)
    state = dstream.GridState(dstream.empty_grid(spark))
    for part in REPAIR_TICKS:
        state = dstream.step(state, rows.filter(part), params)
    cell = F.col("cell")
    owner = F.col("cluster_id")
    return state.model.filter("density IS NOT NULL").select(
        *[cell[a].alias(b) for a, b in enumerate("ijk")], r6("density", "density"), "attr", "t_removed",
        (owner[0] * 10000 + owner[1] * 100 + owner[2]).cast("int").alias("cluster_id"))
