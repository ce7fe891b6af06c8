"""What whole online runs must conserve: totals of the model after yearly batches against their closed forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.catalog.data import ITEMS, Registry, items, r6, sql_r6, tiles
from tidepool.catalog.decaying import _years
from tidepool.operators import assign
from tidepool.plans import clustream, clustree, denstream, streamkm
from tidepool.schema import DECAYING_CLUSTER

registry = Registry()
add = registry.add

#: the tiles' centres as clusters of one member at time 0
SEEDS = "seeds AS (SELECT count(*) AS k, sum(c0) AS s0, sum(c1) AS s1, sum(c2) AS s2 FROM (SELECT avg(x0) AS c0, avg(x1) AS c1, avg(x2) AS c2 FROM items GROUP BY tile))"

CLUSTREAM_TOTALS = f"""
WITH {ITEMS}, {SEEDS} SELECT {sql_r6('any_value(k) + count(*)', 'n')}, {sql_r6('any_value(s0) + sum(x0)', 'ls0')}, {sql_r6('any_value(s1) + sum(x1)', 'ls1')},
  {sql_r6('any_value(s2) + sum(x2)', 'ls2')}, {sql_r6('sum(t)', 'lst')}, any_value(k)::BIGINT AS clusters FROM items CROSS JOIN seeds"""


def _totals(spark, sf, fold=clustream.step, **params):
    """The horizon is long, so clusters are merged and never given up: all counts and sums stay."""
    state = clustream.Clustering(clustream._model(assign.centres_of(tiles(spark, sf))))
    chosen = clustream.CluStreamParams(q=45, m=50, horizon=1e9, t_factor=1.5, **params)
    for batch in _years(spark, sf):
        state = fold(state, batch, chosen)
    return state.model.agg(r6(F.sum("n"), "n"), *[r6(F.sum(F.col("ls")[j]), f"ls{j}") for j in range(3)], r6(F.sum("lst"), "lst"),
                           F.count("*").alias("clusters"))


@add("clustream_totals", CLUSTREAM_TOTALS)
def clustream_totals(spark, sf):
    return _totals(spark, sf)


@add("clustream_totals_unchecked", CLUSTREAM_TOTALS)
def clustream_totals_unchecked(spark, sf):
    """Without the recheck every sum of left-over rows asks for a slot: many more merges, the same totals."""
    return _totals(spark, sf, recheck=False)


@add("clustream_totals_batch_time", f"""
WITH {ITEMS}, {SEEDS} SELECT {sql_r6('any_value(k) + count(*)', 'n')}, {sql_r6('any_value(s0) + sum(x0)', 'ls0')},
  {sql_r6('any_value(s1) + sum(x1)', 'ls1')}, {sql_r6('any_value(s2) + sum(x2)', 'ls2')} FROM items CROSS JOIN seeds""")
def clustream_totals_batch_time(spark, sf):
    return _totals(spark, sf, order="batch_time").drop("lst", "clusters")


def _sites(spark, sf, **params):
    """Rows far from every cluster, standing at one place a line number: each place must become one cluster, in the stalest slots."""
    far = F.array(*[(F.col("l_linenumber") * v).cast("double") for v in (1000, -500, 250)])
    batch = items(spark, sf).select(far.alias("x"), (F.col("t") + 10_000).alias("t"))
    state = clustream.Clustering(clustream._model(assign.centres_of(tiles(spark, sf))))
    model = clustream.step(state, batch, clustream.CluStreamParams(q=45, m=10 ** 9, horizon=5000.0, **params)).model
    return model.select(r6("n", "n"), *[r6(F.col("ls")[j], f"ls{j}") for j in range(3)], r6(F.col("ss")[0], "ss0"), r6("lst", "lst"),
                        r6("sst", "sst")).filter("n > 1")


SITES = f"""
WITH {ITEMS} SELECT {sql_r6('count(*)', 'n')}, {sql_r6('sum(l_linenumber * 1000)', 'ls0')}, {sql_r6('sum(l_linenumber * -500)', 'ls1')},
  {sql_r6('sum(l_linenumber * 250)', 'ls2')}, {sql_r6('sum(l_linenumber * l_linenumber * 1000000)', 'ss0')}, {sql_r6('sum(t + 10000)', 'lst')},
  {sql_r6('sum((t + 10000) * (t + 10000))', 'sst')} FROM items GROUP BY l_linenumber HAVING count(*) > 1"""


@add("clustream_sites", SITES)
def clustream_sites(spark, sf):
    return _sites(spark, sf)


@add("clustream_sites_bounded", SITES)
def clustream_sites_bounded(spark, sf):
    """The same with at most 64 sums of left-over rows in the last task: trees of features merge them before, level by level."""
    return _sites(spark, sf, left_most=64)


@add("clustream_records_totals", CLUSTREAM_TOTALS)
def clustream_records_totals(spark, sf):
    """Record by record in every task, changes of the tasks added up: the same totals."""
    return _totals(spark, sf, fold=clustream.record_step)


@add("clustream_records_sites", f"""
WITH {ITEMS} SELECT {sql_r6('count(*)', 'n')}, {sql_r6('sum(pow(4, l_linenumber))', 'ls0')}, {sql_r6('sum(-pow(4, l_linenumber))', 'ls1')},
  {sql_r6('sum(pow(4, l_linenumber) / 2)', 'ls2')}, {sql_r6('sum(t + 10000)', 'lst')}, {sql_r6('sum((t + 10000) * (t + 10000))', 'sst')}
FROM items GROUP BY l_linenumber HAVING count(*) > 1""")
def clustream_records_sites(spark, sf):
    """Rows at one place a line number, each place farther off than all nearer ones: the first record of a place in a task opens a
    cluster in the stalest slot, the others join it, and the clusters that several tasks opened at a place become one."""
    scale = F.pow(F.lit(4.0), F.col("l_linenumber"))
    batch = items(spark, sf).select(F.array(scale, -scale, scale / 2).alias("x"), (F.col("t") + 10_000).alias("t"))
    state = clustream.Clustering(clustream._model(assign.centres_of(tiles(spark, sf))))
    tasks = max(5, spark.sparkContext.defaultParallelism)
    model = clustream.record_step(state, batch.repartition(tasks), clustream.CluStreamParams(q=45, m=10 ** 9, horizon=5000.0)).model
    return model.select(r6("n", "n"), *[r6(F.col("ls")[j], f"ls{j}") for j in range(3)], r6("lst", "lst"), r6("sst", "sst")).filter("n > 1")


RUN_LAM = 0.001


def _faded(start: str = "") -> str:
    f = f"pow(2.0, -{RUN_LAM} * (now - t))"
    more = [f" + any_value({s}) * pow(2.0, -{RUN_LAM} * any_value(now))" if start else "" for s in ("k", "s0", "s1", "s2")]
    columns = ", ".join(sql_r6(f"sum({x}{f}){m}", name) for x, m, name in zip(("", "x0 * ", "x1 * ", "x2 * "), more, ("w", "ls0", "ls1", "ls2")))
    return f"WITH {ITEMS}, now AS (SELECT max(t) AS now FROM items){', ' + SEEDS if start else ''} SELECT {columns} FROM items CROSS JOIN now {start}"


def _faded_totals(model):
    return model.agg(r6(F.sum("w"), "w"), *[r6(F.sum(F.col("ls")[j]), f"ls{j}") for j in range(3)])


def _denstream_totals(spark, sf, **params):
    """Without pruning all weight and all sums are there at the end, faded to the latest time."""
    centres = assign.centres_of(tiles(spark, sf))
    start = centres.select("mc_id", F.lit("p").alias("kind"), F.lit(1.0).alias("w"), F.col("centre").alias("ls"),
                           F.transform("centre", lambda v: v * v).alias("ss"), F.lit(0).cast("long").alias("t0"), F.lit(0).cast("long").alias("t_last"))
    state = denstream.DecayingState(start)
    chosen = denstream.DenStreamParams(eps=0.12, mu=40.0, beta=0.3, lam=RUN_LAM, prune="never", **params)
    for batch in _years(spark, sf):
        state = denstream.step(state, batch, chosen)
    return _faded_totals(state.model)


@add("denstream_totals", _faded("CROSS JOIN seeds"))
def denstream_totals(spark, sf):
    return _denstream_totals(spark, sf)


@add("denstream_totals_p_only", _faded("CROSS JOIN seeds"))
def denstream_totals_p_only(spark, sf):
    """Old o-clusters take nothing: every miss is born anew."""
    return _denstream_totals(spark, sf, reuse_old_outliers=False)


@add("clustree_totals", _faded())
def clustree_totals(spark, sf):
    state = denstream.DecayingState(spark.createDataFrame([], DECAYING_CLUSTER))
    for batch in _years(spark, sf):
        state = clustree.step(state, batch, 0.15, RUN_LAM)
    return _faded_totals(state.model)


@add("streamkm_totals", f"WITH {ITEMS} SELECT {sql_r6('count(*)', 'weight')}, true AS bounded FROM items")
def streamkm_totals(spark, sf):
    """The buckets hold the weight of all rows in a bounded number of points."""
    params = streamkm.StreamKMParams(k=5, size=500, window=100_000, seed=3)
    state = streamkm.BucketState(streamkm.empty_buckets(spark))
    for batch in _years(spark, sf):
        state = streamkm.step(state, batch, params)
    return state.model.agg(r6(F.sum("weight"), "weight"), (F.count("*") <= 500 * 20).alias("bounded"))


@add("sample_ranked", """
SELECT event_id, user_id FROM events ORDER BY md5('7' || '|' || event_id::VARCHAR), event_id LIMIT 100""")
def sample_ranked(spark, sf):
    """A fixed sample by a hash both engines have: the seed fixes the draw, not the layout."""
    events = spark.read.parquet(f"{sf}/events.parquet")
    rank = F.md5(F.concat(F.lit("7|"), F.col("event_id").cast("string")))
    return events.select("event_id", "user_id").orderBy(rank, "event_id").limit(100)
