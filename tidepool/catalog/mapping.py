"""Queries over the mapping measure, coresets, leaf entries and stream metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.catalog.data import VECTORS, Registry, items, label_model, r6, sql_r6, table, vectors, visits
from tidepool.operators import assign, cf, cmm, coreset
from tidepool.plans import clustree, denstream, streamkm
from tidepool.schema import DECAYING_CLUSTER
from tidepool.streaming.jobs import score_run

registry = Registry()
add = registry.add

NOISE = cmm.CMMParams(noise=9)


def _points(spark, sf):
    return vectors(spark, sf).select(F.col("vec_id").alias("id"), "x", F.col("label").alias("class"))


def _spheres(spark, sf):
    near = assign.assign_nearest(vectors(spark, sf), assign.centres_of(label_model(spark, sf)))
    features = cf.cf_aggregate(near, t=None, d=64)
    return cmm.spheres_of(features.withColumnRenamed("mc_id", "cluster_id"))


EMBEDDINGS = f"""{VECTORS},
v AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS class, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
fl AS (SELECT near.mc_id AS f, vl.dim, sum(v)/count(*) AS c, sum(v*v)/count(*) AS q FROM near JOIN vl USING (vec_id) GROUP BY near.mc_id, vl.dim)"""

LINEAR = "(mean + dev) / kd"
EXPONENTIAL = "pow(2.0, ln(0.01) / ln(2.0) / 4.0 * (kd - (mean + dev)) / (mean + dev))"


def sql_truth(points: str, far: str = LINEAR) -> str:
    """Common tables from the labelled points ``v`` (id, class, x) and the spheres' means ``fl`` (f, dim, c, q)."""
    return f"""{points},
pd AS (SELECT a.id, b.class AS target, list_distance(a.x, b.x) AS d FROM v a JOIN v b ON a.id <> b.id WHERE b.class <> 9),
kd AS (SELECT id, target, avg(d) AS kd FROM (SELECT *, row_number() OVER (PARTITION BY id, target ORDER BY d) AS r FROM pd)
       WHERE r <= 2 GROUP BY id, target),
kc AS (SELECT kd.*, v.class FROM kd JOIN v USING (id)),
lim AS (SELECT class, avg(kd) AS mean, avg(kd * kd) - avg(kd) * avg(kd) AS var FROM kc WHERE class = target GROUP BY class),
up AS (SELECT class AS target, mean, sqrt(CASE WHEN var <= 0 THEN 1e-50 ELSE var END) AS dev FROM lim),
conn AS (SELECT id, class, target, CASE WHEN kd < mean + dev THEN 1.0::DOUBLE ELSE {far} END AS conn FROM kc JOIN up USING (target)),
own AS (SELECT v.id, v.class, coalesce(conn.conn, 1.0) AS w FROM v LEFT JOIN conn ON conn.id = v.id AND conn.target = v.class),
gm AS (SELECT class AS h, unnest(range(len(x))) AS dim, unnest(x) AS e FROM v WHERE class <> 9),
gt AS (SELECT h, list(c ORDER BY dim) AS c FROM (SELECT h, dim, avg(e) AS c FROM gm GROUP BY h, dim) GROUP BY h),
gtr AS (SELECT h, any_value(gt.c) AS c, max(list_distance(v.x, gt.c)) AS r FROM gt JOIN v ON v.class = gt.h GROUP BY h),
ingt AS (SELECT v.id, v.class, h FROM v JOIN gtr ON list_distance(v.x, gtr.c) <= r),
prof AS (SELECT h, class, count(DISTINCT id) AS g FROM (SELECT h, class, id FROM ingt WHERE class <> 9
         UNION ALL SELECT class AS h, class, id FROM v WHERE class <> 9) GROUP BY h, class),
fs AS (SELECT f, list(c ORDER BY dim) AS c, sqrt(sum(greatest(q - c * c, 0))) AS r FROM fl GROUP BY f),
inf AS (SELECT v.id, v.class, f FROM v JOIN fs ON list_distance(v.x, fs.c) <= r),
fc AS (SELECT f, class, count(*) AS k FROM inf WHERE class <> 9 GROUP BY f, class),
sur AS (SELECT f, h, sum(greatest(k - coalesce(g, 0), 0)) AS surplus, sum(CASE WHEN h = class THEN k ELSE 0 END) AS votes
        FROM (SELECT fc.f, fc.class, fc.k, hs.h FROM fc CROSS JOIN (SELECT DISTINCT h FROM gt) hs) LEFT JOIN prof USING (h, class) GROUP BY f, h),
pick AS (SELECT f, h FROM (SELECT *, row_number() OVER (PARTITION BY f ORDER BY surplus,
         CASE WHEN surplus = 0 THEN -votes ELSE 0 END, h) AS o FROM sur) WHERE o = 1),
kinds AS (SELECT f, count(*) AS kinds, min(class) AS sole FROM fc GROUP BY f),
m AS (SELECT fs.f, CASE WHEN kinds = 1 THEN sole ELSE coalesce(h, -1) END AS match FROM fs LEFT JOIN kinds USING (f) LEFT JOIN pick USING (f))"""


TRUTH = sql_truth(EMBEDDINGS)


def sql_errors(truth: str) -> str:
    return f"""{truth},
cov AS (SELECT inf.id, inf.class, own.w, m.match, ingt.h IS NOT NULL AS model, 1 - coalesce(conn.conn, 0) AS apart
  FROM inf JOIN m USING (f) JOIN own ON own.id = inf.id LEFT JOIN ingt ON ingt.id = inf.id AND ingt.h = m.match
  LEFT JOIN conn ON conn.id = inf.id AND conn.target = m.match),
worst AS (SELECT id, max(CASE WHEN class = 9 THEN CASE WHEN match = -1 THEN 1 WHEN model THEN 1e-5 ELSE apart END
  WHEN match = class THEN 0 WHEN match = -1 THEN 1 WHEN model OR apart = 0 THEN 1e-5 ELSE apart * w END) AS e FROM cov GROUP BY id),
hull AS (SELECT v.id, least(1.0, coalesce(min((list_distance(v.x, fs.c) - r) / (list_distance(v.x, fs.c) + r)), 1.0)) AS h
  FROM v LEFT JOIN m ON m.match = v.class LEFT JOIN fs USING (f) GROUP BY v.id),
err AS (SELECT own.id, own.class, own.w, worst.e IS NOT NULL AS covered,
  coalesce(worst.e, CASE WHEN own.class = 9 THEN 0 ELSE w * (1 - exp(-1.0 * hull.h)) END) AS e
  FROM own LEFT JOIN worst USING (id) JOIN hull USING (id))"""


ERRORS = sql_errors(TRUTH)
SCORES = ("cmm", "cmm_basic", "missed", "misplaced", "noise", "ca_separability", "ca_noise", "ca_model")


def sql_scores(separability: str = "1.0::DOUBLE") -> str:
    """The outputs of the measure from ``err``, ``nz``, ``v`` and ``ingt``; noise is class 9."""
    real, base = "CASE WHEN class <> 9 AND {} covered THEN e ELSE 0 END", "CASE WHEN class <> 9 THEN w ELSE 0 END"
    return ", ".join([
        sql_r6("1 - sum(e) / sum(w)", "cmm"), sql_r6("1 - avg(CASE WHEN e <> 0 THEN 1.0 ELSE 0.0 END)", "cmm_basic"),
        sql_r6(f"1 - sum({real.format('NOT')}) / sum({base})", "missed"),
        sql_r6(f"1 - sum({real.format('')}) / sum({base})", "misplaced"),
        sql_r6("coalesce(1 - sum(CASE WHEN class = 9 AND covered THEN e ELSE 0 END) "
               "/ nullif(sum(CASE WHEN class = 9 THEN w ELSE 0 END), 0), 1.0)", "noise"),
        sql_r6(separability, "ca_separability"),
        sql_r6("coalesce(1 - (SELECT sum(c) FROM nz) / nullif((SELECT count(*) FROM v WHERE class = 9), 0), 1.0)", "ca_noise"),
        sql_r6("1 - (SELECT count(DISTINCT id) FROM ingt WHERE h <> class) / (SELECT count(*) FROM v)", "ca_model")])


NZ = "nz AS (SELECT id, max(conn) AS c FROM conn WHERE class = 9 GROUP BY id)"


@add("cmm_knn", f"WITH {TRUTH} SELECT id, target, {sql_r6('kd', 'kd')} FROM kd")
def cmm_knn(spark, sf):
    return cmm.class_knn(_points(spark, sf), NOISE).select("id", "target", r6("kd", "kd"))


@add("cmm_limits", f"WITH {TRUTH} SELECT target AS class, {sql_r6('mean', 'mean')}, {sql_r6('mean + dev', 'upper')} FROM up")
def cmm_limits(spark, sf):
    return cmm.class_limits(cmm.class_knn(_points(spark, sf), NOISE)).select("class", r6("mean", "mean"), r6("upper", "upper"))


@add("cmm_connectivity", f"WITH {TRUTH} SELECT id, class, target, {sql_r6('conn', 'conn')} FROM conn")
def cmm_connectivity(spark, sf):
    kd = cmm.class_knn(_points(spark, sf), NOISE)
    return cmm.connectivity(kd, cmm.class_limits(kd), NOISE).select("id", "class", "target", r6("conn", "conn"))


@add("cmm_class_connection", f"""
WITH {TRUTH}, c AS (SELECT conn.class, conn.target, own.w * conn.conn AS c FROM conn JOIN own USING (id)
  WHERE conn.class <> conn.target AND conn.class <> 9),
r AS (SELECT *, row_number() OVER (PARTITION BY class, target ORDER BY c DESC) AS o FROM c)
SELECT class, target, {sql_r6('avg(c)', 'connection')} FROM r WHERE o <= 2 GROUP BY class, target""")
def cmm_class_connection(spark, sf):
    kd = cmm.class_knn(_points(spark, sf), NOISE)
    out = cmm.class_connections(cmm.connectivity(kd, cmm.class_limits(kd), NOISE))
    return out.select("class", "target", r6("connection", "connection"))


@add("cmm_match", f"WITH {TRUTH} SELECT f AS cluster_id, match FROM m")
def cmm_match(spark, sf):
    return cmm.evaluate(_points(spark, sf), _spheres(spark, sf), d=64, params=NOISE).matches.select("cluster_id", "match")


@add("cmm_errors", f"WITH {ERRORS} SELECT id, covered, {sql_r6('w', 'conn')}, {sql_r6('e', 'err')} FROM err")
def cmm_errors(spark, sf):
    out = cmm.evaluate(_points(spark, sf), _spheres(spark, sf), d=64, params=NOISE).points
    return out.select("id", "covered", r6("conn", "conn"), r6("err", "err"))


@add("cmm_score", f"WITH {ERRORS}, {NZ} SELECT {sql_scores()} FROM err")
def cmm_score(spark, sf):
    out = cmm.evaluate(_points(spark, sf), _spheres(spark, sf), d=64, params=NOISE).result
    return out.select(*[r6(c, c) for c in SCORES])


# ---- parts as labelled points: classes at growing gaps, so that only the first ones merge below tau < 1 ----------------


def _parts(spark, sf):
    """The last 10,000 parts (the window is the feature): x from size and price, class by size, ``f`` a given cluster."""
    size, price = F.col("p_size"), (F.col("p_retailprice") - 900) / 16
    kind = F.floor((size - 1) / 5).cast("long")
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.array(size / 8 + kind * kind / 8.0, price).alias("x"),
                                           kind.alias("class"), (kind * 100 + F.floor(price / 4)).cast("long").alias("f"))
    return cmm.evaluation_window(rows, ["id"])


def _part_features(spark, sf):
    return cf.cf_aggregate(_parts(spark, sf).withColumnRenamed("f", "mc_id"), t=None, d=2)


def _part_spheres(spark, sf):
    return cmm.spheres_of(_part_features(spark, sf).withColumnRenamed("mc_id", "cluster_id"))


PART_ROWS = """p AS (SELECT p_partkey AS id, (p_size - 1) // 5 AS k, p_size, (p_retailprice - 900) / 16 AS y
  FROM (SELECT * FROM part ORDER BY p_partkey DESC LIMIT 10000)),
v AS (SELECT id, CAST(k AS BIGINT) AS class, [p_size / 8 + k * k / 8.0::DOUBLE, y] AS x FROM p),
pf AS (SELECT id, CAST(k * 100 + floor(y / 4) AS BIGINT) AS f FROM p),
px AS (SELECT id, unnest(range(2)) AS dim, unnest(x) AS e FROM v)"""
PARTS = f"""{PART_ROWS},
fl AS (SELECT f, dim, avg(e) AS c, avg(e * e) AS q FROM px JOIN pf USING (id) GROUP BY f, dim)"""

TAU = 0.2
MERGING = cmm.CMMParams(noise=9, tau=TAU)
SHARP = cmm.CMMParams(noise=9, exponential=True)


def _merge_rounds(rounds: int = 8) -> str:
    """names{rounds} (class, merged): one merge a round while the strongest mutual connection is above tau.

    The nine classes that are not noise merge at most eight times; a round without a merge leaves the names as they are.
    """
    text = f"""{PART_ROWS},
nn AS MATERIALIZED (SELECT id, target, d FROM (SELECT a.id, b.class AS target, list_distance(a.x, b.x) AS d,
    row_number() OVER (PARTITION BY a.id, b.class ORDER BY list_distance(a.x, b.x)) AS r
  FROM v a JOIN v b ON a.id <> b.id WHERE b.class <> 9) WHERE r <= 2),
names0 AS MATERIALIZED (SELECT DISTINCT class, class AS merged FROM v WHERE class <> 9)"""
    for i in range(rounds):
        text += f""",
c{i} AS MATERIALIZED (SELECT v.id, names{i}.merged AS class FROM v JOIN names{i} USING (class)),
k{i} AS MATERIALIZED (SELECT id, target, c{i}.class, avg(d) AS kd FROM (SELECT nn.id, merged AS target, d,
    row_number() OVER (PARTITION BY nn.id, merged ORDER BY d) AS r FROM nn JOIN names{i} ON names{i}.class = nn.target)
  JOIN c{i} USING (id) WHERE r <= 2 GROUP BY ALL),
u{i} AS (SELECT target, avg(kd) + sqrt(greatest(avg(kd * kd) - avg(kd) * avg(kd), 1e-50)) AS up FROM k{i} WHERE class = target GROUP BY target),
n{i} AS MATERIALIZED (SELECT id, class, target, CASE WHEN kd < up THEN 1.0::DOUBLE ELSE up / kd END AS conn FROM k{i} JOIN u{i} USING (target)),
t{i} AS (SELECT o.class, o.target, o.conn * coalesce(w.conn, 1.0) AS c,
    row_number() OVER (PARTITION BY o.class, o.target ORDER BY o.conn * coalesce(w.conn, 1.0) DESC) AS r
  FROM n{i} o LEFT JOIN n{i} w ON w.id = o.id AND w.target = w.class WHERE o.class <> o.target),
l{i} AS MATERIALIZED (SELECT class, target, avg(c) AS c FROM t{i} WHERE r <= 2 GROUP BY class, target),
b{i} AS MATERIALIZED (SELECT a.class AS keep, a.target AS gone FROM l{i} a JOIN l{i} b ON a.class = b.target AND a.target = b.class
  WHERE a.class < a.target AND least(a.c, b.c) > {TAU} ORDER BY least(a.c, b.c) DESC, keep, gone LIMIT 1),
names{i + 1} AS MATERIALIZED (SELECT class, coalesce(b{i}.keep, merged) AS merged FROM names{i} LEFT JOIN b{i} ON b{i}.gone = names{i}.merged)"""
    return text


@add("cmm_merge", f"WITH {_merge_rounds()} SELECT class, merged, count(*) AS n FROM v JOIN names8 USING (class) GROUP BY class, merged")
def cmm_merge(spark, sf):
    """Classes after merging at tau = 0.2, with their numbers of points."""
    points = _parts(spark, sf)
    merged = cmm.merge_classes(points, MERGING)
    return points.join(merged, "class").groupBy("class", "merged").agg(F.count("*").alias("n"))


@add("cmm_exponential", f"WITH {sql_errors(sql_truth(PARTS, EXPONENTIAL))}, {NZ} SELECT {sql_scores()} FROM err")
def cmm_exponential(spark, sf):
    """All outputs with exponential connectivity."""
    out = cmm.evaluate(_parts(spark, sf), _part_spheres(spark, sf), d=2, params=SHARP).result
    return out.select(*[r6(c, c) for c in SCORES])


@add("cmm_exponential_errors", f"WITH {sql_errors(sql_truth(PARTS, EXPONENTIAL))} SELECT id, covered, {sql_r6('w', 'conn')}, {sql_r6('e', 'err')} FROM err")
def cmm_exponential_errors(spark, sf):
    out = cmm.evaluate(_parts(spark, sf), _part_spheres(spark, sf), d=2, params=SHARP).points
    return out.select("id", "covered", r6("conn", "conn"), r6("err", "err"))


# ---- scores at the end of a job ---------------------------------------------------------------------------------------

MACRO = "f // 300"


def _job_level(level: str, found: str) -> str:
    points = f"""{PART_ROWS},
g AS (SELECT id, {found} AS f FROM pf),
fl AS (SELECT f, dim, avg(e) AS c, avg(e * e) AS q FROM px JOIN g USING (id) GROUP BY f, dim)"""
    return f"""SELECT * FROM (WITH {sql_errors(sql_truth(points))}, {NZ},
  sq AS (SELECT v.id, min(list_sum([(v.x[1] - fs.c[1]) * (v.x[1] - fs.c[1]), (v.x[2] - fs.c[2]) * (v.x[2] - fs.c[2])])) AS s FROM v, fs GROUP BY v.id)
SELECT '{level}' AS level, (SELECT count(*) FROM fs) AS clusters, count(*) AS n_rows, {sql_r6('(SELECT sum(s) FROM sq)', 'sse')}, {sql_scores()} FROM err)"""


@add("cmm_job", f"{_job_level('micro', 'f')} UNION ALL {_job_level('macro', MACRO)}")
def cmm_job(spark, sf):
    """SSE and mapping measure of micro clusters and of macro clusters added up from them, on the last 10,000 labelled rows."""
    micro = _part_features(spark, sf)
    macro = cf.cf_merge(micro.withColumn("cluster_id", F.floor(F.col("mc_id") / 300).cast("long")), by="cluster_id", d=2)
    out = score_run(_parts(spark, sf), ["id"], {"micro": micro, "macro": macro}, params=NOISE)
    return out.select("level", "clusters", "n_rows", r6("sse", "sse"), *[r6(c, c) for c in SCORES])


@add("coreset_weight", "SELECT count(*) AS n, 1000 AS size FROM lineitem")
def coreset_weight(spark, sf):
    """A coreset of all line items carries their whole weight in at most 1000 rows."""
    out = coreset.coreset(items(spark, sf), 1_000, seed=11)
    return out.agg(F.sum("weight").cast("long").alias("n"), F.greatest(F.count("*"), F.lit(1000)).cast("int").alias("size"))


@add("coreset")
def coreset_rows(spark, sf):
    return coreset.coreset(items(spark, sf), 200, seed=11).select("x", "weight")


@add("streamkm_run")
def streamkm_run(spark, sf):
    from tidepool.catalog.decaying import _years

    params = streamkm.StreamKMParams(k=5, size=500, window=100_000, iterations=20, seed=3)
    state = streamkm.BucketState(streamkm.empty_buckets(spark))
    for batch in _years(spark, sf):
        state = streamkm.step(state, batch, params)
    return streamkm.final_clusters(state.model, params).select(
        "cluster_id", r6("weight", "weight"), *[r6(F.col("centre")[j], f"c{j}") for j in range(3)])


@add("clustree_run")
def clustree_run(spark, sf):
    from tidepool.catalog.decaying import _years

    state = denstream.DecayingState(spark.createDataFrame([], DECAYING_CLUSTER))
    for batch in _years(spark, sf):
        state = clustree.step(state, batch, 0.15, 0.001)
    return state.model.select("mc_id", r6("w", "w"), F.size("ls").alias("d"))


@add("stream_metrics", """
WITH n AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i FROM events), b AS (SELECT i // 1000 AS b, count(*) AS k FROM n GROUP BY 1)
SELECT sum(k)::BIGINT AS records, count(*) AS batches, max(k)::BIGINT AS largest FROM b""")
def stream_metrics(spark, sf):
    """The throughput report over replayed batches (counts only; times are not reproducible)."""
    from tidepool.operators.rows import replay_stamp
    from tidepool.streaming.metrics import throughput

    stamped = replay_stamp(visits(spark, sf).select("event_id"), ["event_id"], interval=1000)
    table = stamped.groupBy(F.col("tick").alias("batch_id")).agg(F.count("*").alias("n_rows")).withColumns(
        {"processing_ms": F.lit(1000).cast("long"), "total_ms": F.lit(1000).cast("long")})
    out = throughput(table)
    return out.select("records", "batches", F.col("max_throughput").cast("long").alias("largest"))


@add("evaluation_window", f"""
WITH w AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 10000)
SELECT event_type, count(*) AS n, {sql_r6('sum(value)', 'total')}, min(event_id) AS first_id FROM w GROUP BY event_type""")
def evaluation_window(spark, sf):
    """The last 10,000 rows: the window is the feature."""
    w = cmm.evaluation_window(visits(spark, sf), ["event_id"])
    return w.groupBy("event_type").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"), F.min("event_id").alias("first_id"))


@add("cmm_found_spheres", f"WITH {TRUTH} SELECT f AS cluster_id, {sql_r6('r', 'radius')}, {sql_r6('c[1]', 'c0')} FROM fs")
def cmm_found_spheres(spark, sf):
    return _spheres(spark, sf).select("cluster_id", r6("radius", "radius"), r6(F.col("centre")[0], "c0"))


@add("cmm_class_spheres", f"WITH {TRUTH} SELECT h AS class, {sql_r6('r', 'radius')}, {sql_r6('c[1]', 'c0')} FROM gtr")
def cmm_class_spheres(spark, sf):
    out = cmm.class_spheres(_points(spark, sf).filter("class <> 9"), d=64)
    return out.select("class", r6("radius", "radius"), r6(F.col("centre")[0], "c0"))
