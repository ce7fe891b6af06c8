"""Points, streams and models derived from the shared tables, with their SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def items(spark: SparkSession, sf: str) -> DataFrame:
    """Line items as 3-d timed points: x, t (day), tile (a coarse starting cluster).

    All components are whole numbers over a power of two, so that their sums do not depend on the order.
    """
    li = table(spark, sf, "lineitem")
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1995-01-01").cast("date")).cast("long")
    tile = (F.floor(F.col("l_quantity") / 12.5) * 100 + F.floor(F.col("l_discount") / 0.035) * 10
            + F.floor(F.col("l_tax") / 0.03)).cast("long")
    return li.select(
        F.array(F.col("l_quantity") / 64, F.rint(F.col("l_discount") * 100) / 8, F.rint(F.col("l_tax") * 100) / 8).alias("x"),
        day.alias("t"), tile.alias("tile"), "l_returnflag", "l_linenumber")


ITEMS = """items AS (
  SELECT l_quantity / 64 AS x0, round_even(l_discount * 100, 0) / 8 AS x1, round_even(l_tax * 100, 0) / 8 AS x2,
         date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) AS t,
         CAST(floor(l_quantity / 12.5) * 100 + floor(l_discount / 0.035) * 10 + floor(l_tax / 0.03) AS BIGINT) AS tile,
         l_returnflag, l_linenumber
  FROM lineitem)"""

#: cluster features of the tiles
TILES = """tiles AS (
  SELECT tile AS mc_id, count(*)::DOUBLE AS n, sum(x0) AS ls0, sum(x1) AS ls1, sum(x2) AS ls2,
         sum(x0*x0) AS ss0, sum(x1*x1) AS ss1, sum(x2*x2) AS ss2,
         sum(t)::DOUBLE AS lst, sum(t*t)::DOUBLE AS sst, max(t) AS t_max
  FROM items GROUP BY tile)"""


def tiles(spark: SparkSession, sf: str) -> DataFrame:
    from tidepool.operators.cf import cf_aggregate

    return (cf_aggregate(items(spark, sf).withColumnRenamed("tile", "mc_id"), d=3))


def visits(spark: SparkSession, sf: str) -> DataFrame:
    """Events as 1-d timed points keyed by user."""
    ev = table(spark, sf, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("long")
    return ev.select("event_id", "user_id", "event_type", day.alias("t"), F.array("value").alias("x"), "value")


VISITS = """visits AS (
  SELECT event_id, user_id, event_type, value, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t
  FROM events)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as labelled 64-d points."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.col("label").cast("long").alias("label"),
                    F.col("embedding").cast("array<double>").alias("x"))


#: embeddings and the per-label means in long form
VECTORS = """vl AS (
  SELECT vec_id, CAST(label AS BIGINT) AS label, unnest(generate_series(0, 63)) AS dim,
         unnest(CAST(embedding AS DOUBLE[])) AS v FROM embeddings),
means AS (SELECT label AS mc_id, dim, avg(v) AS c, count(*) AS n FROM vl GROUP BY label, dim),
vd AS (SELECT p.vec_id, p.label, m.mc_id, sum((p.v - m.c) * (p.v - m.c)) AS d2
       FROM vl p JOIN means m USING (dim) GROUP BY p.vec_id, p.label, m.mc_id),
near AS (SELECT vec_id, label, arg_min(mc_id, d2) AS mc_id, sqrt(min(d2)) AS dist FROM vd GROUP BY vec_id, label)"""


def label_model(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster features of the labels, as a model for the embeddings."""
    from tidepool.operators.cf import cf_aggregate

    return cf_aggregate(vectors(spark, sf).withColumnRenamed("label", "mc_id"), t=None, d=64)


def r6(col, name: str):
    """Rounded to six places, halves to even as in the SQL twins, without negative zero."""
    c = F.col(col) if isinstance(col, str) else col
    return (F.rint(c * 1e6) / 1e6 + F.lit(0.0)).alias(name)


def sql_r6(expr: str, name: str) -> str:
    return f"round_even(({expr}) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0 AS {name}"


class Registry:
    """Queries with their SQL twins, in the order they are declared."""

    def __init__(self):
        self.queries, self.sql = {}, {}

    def add(self, name: str, sql: str | None = None):
        def wrap(fn):
            self.queries[name] = fn
            if sql is not None:
                self.sql[name] = sql
            return fn
        return wrap


def orders2d(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as 2-d points: price and day."""
    o = table(spark, sf, "orders")
    day = F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return o.select(F.array(F.col("o_totalprice") / 65536, day / 512.0).alias("x"))


ORDERS2D = """orders2d AS (
  SELECT o_totalprice / 65536 AS x0, date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) / 512.0::DOUBLE AS x1
  FROM orders)"""
