"""Queries over parsing, replay stamps, nominal features and vector algebra."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidepool.catalog.data import ITEMS, Registry, items, r6, sql_r6, table, vectors, visits
from tidepool.functions import vec
from tidepool.operators import rows
from tidepool.sources import text

registry = Registry()
add = registry.add


@add("parse_timed", f"""
SELECT event_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, {sql_r6('value', 'x0')},
       {sql_r6('value * 2', 'x1')} FROM events""")
def parse_timed(spark, sf):
    pts = visits(spark, sf).withColumn("x", F.array("value", F.col("value") * 2))
    lines = pts.select("event_id", text.format_timed("t", "x").alias("value"))
    return text.parse_timed(lines).select("event_id", "t", r6(F.col("x")[0], "x0"), r6(F.col("x")[1], "x1"))


@add("parse_untimed", f"""
WITH {ITEMS}
SELECT {sql_r6('x0', 'x0')}, {sql_r6('x1', 'x1')}, {sql_r6('x2', 'x2')}, count(*) AS n FROM items GROUP BY x0, x1, x2""")
def parse_untimed(spark, sf):
    lines = items(spark, sf).select(text.format_dense("x").alias("value"))
    pts = text.parse_untimed(lines)
    return (pts.groupBy("x").count()
            .select(*[r6(F.col("x")[j], f"x{j}") for j in range(3)], F.col("count").alias("n")))


@add("parse_labelled", """
SELECT label, count(*) AS n, round_even((sum(embedding[1]::DOUBLE)) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0 AS s0, round_even((sum(embedding[64]::DOUBLE)) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0 AS s63
FROM embeddings GROUP BY label""")
def parse_labelled(spark, sf):
    v = vectors(spark, sf)
    lines = v.select(F.concat(text.format_dense("x"), F.lit(","), F.col("label").cast("string")).alias("value"))
    noise = v.limit(1).select(F.explode(F.array(F.lit("% comment"), F.lit("@data"), F.lit("  "))).alias("value"))
    pts = text.labelled_rows(lines.unionByName(noise), 65, n_classes=25)
    return (pts.groupBy(F.col("class").alias("label"))
            .agg(F.count("*").alias("n"), r6(F.sum(F.col("x")[0]), "s0"), r6(F.sum(F.col("x")[63]), "s63")))


@add("parse_example", f"""
SELECT event_id, {sql_r6('value', 'x0')}, user_id::DOUBLE AS y0, {sql_r6('value / 10', 'weight')} FROM events""")
def parse_example(spark, sf):
    ev = visits(spark, sf)
    lines = ev.select("event_id", F.concat_ws(
        " ", F.col("user_id").cast("string"), F.col("value").cast("string"),
        (F.col("value") / 10).cast("string")).alias("value"))
    ex = text.parse_examples(lines)
    return ex.select("event_id", r6(F.col("x")[0], "x0"), F.col("y")[0].alias("y0"), r6("weight", "weight"))


@add("parse_sparse", """
SELECT event_id, 0.0::DOUBLE AS v0, round_even((value) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0 AS v1,
       user_id::DOUBLE AS v4, round_even((value * value + user_id * user_id) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0 AS norm2 FROM events""")
def parse_sparse(spark, sf):
    lines = visits(spark, sf).select("event_id", F.concat(
        F.lit("2:"), F.col("value").cast("string"), F.lit(",5:"), F.col("user_id").cast("string")).alias("value"))
    m = lines.select("event_id", text.parse_sparse("value").alias("m"))
    again = m.withColumn("m", text.parse_sparse(text.format_sparse("m")))
    return again.select("event_id", vec.sparse_element("m", 0).alias("v0"), r6(vec.sparse_element("m", 1), "v1"),
                        vec.sparse_element("m", 4).alias("v4"), r6(vec.sparse_dot("m", "m"), "norm2"))


@add("replay_stamp", """
WITH n AS (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
SELECT event_id, i AS row, i // 1000 AS tick, CAST(i % 32 AS INTEGER) AS slot FROM n""")
def replay_stamp(spark, sf):
    ev = table(spark, sf, "events").select("event_id")
    return rows.replay_stamp(ev, ["event_id"], interval=1000, partitions=32).select("event_id", "row", "tick", "slot")


@add("head_n", """
SELECT event_id, user_id FROM events ORDER BY event_id LIMIT 434""")
def head_n(spark, sf):
    return rows.head(table(spark, sf, "events").select("event_id", "user_id"), ["event_id"], 434)


@add("nominal_index", """
WITH d AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS idx FROM (SELECT DISTINCT event_type FROM events))
SELECT event_type, idx, count(*) AS n FROM events JOIN d USING (event_type) GROUP BY event_type, idx""")
def nominal_index(spark, sf):
    ev = table(spark, sf, "events").select("event_type")
    names = text.nominal_dictionary(ev, "event_type")
    coded = text.nominal_to_index(ev, "event_type", names, "idx").select("idx")
    return (coded.groupBy("idx").agg(F.count("*").alias("n"))
            .transform(lambda df: text.index_to_nominal(df, "idx", names, "event_type")))


@add("vector_algebra", """
WITH v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
l AS (SELECT vec_id, unnest(generate_series(0, 63)) AS dim, unnest(x) AS v FROM v),
m AS (SELECT dim, avg(v) AS c FROM l GROUP BY dim)
SELECT vec_id, round_even((sum(v * c)) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0 AS dot, round_even((sqrt(sum((v - c) * (v - c)))) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0 AS dist,
       round_even((sum(v + c)) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0 AS added, round_even((sum(v * v * c)) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0 AS had_dot,
       round_even((sqrt(sum((CASE WHEN v > 0 THEN v ELSE 0 END - c) * (CASE WHEN v > 0 THEN v ELSE 0 END - c)))) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0 AS sparse_dist,
       round_even((sum(CASE WHEN v > 0 THEN v * v ELSE 0 END)) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0 AS sparse_dot
FROM l JOIN m USING (dim) GROUP BY vec_id""")
def vector_algebra(spark, sf):
    v = vectors(spark, sf)
    mean = v.agg(*[F.avg(F.col("x")[j]).alias(f"c{j}") for j in range(64)]).select(
        F.array(*[f"c{j}" for j in range(64)]).alias("c")).scalar()
    v = v.withColumn("c", mean)
    m = vec.to_sparse(F.transform("x", lambda e: F.greatest(e, F.lit(0.0))))
    return v.withColumn("m", m).select(
        "vec_id", r6(vec.dot("x", "c"), "dot"), r6(vec.distance("x", "c"), "dist"),
        r6(vec.total(vec.add("x", "c")), "added"), r6(vec.dot(vec.hadamard("x", "x"), "c"), "had_dot"),
        r6(vec.sparse_dense_distance("m", "c"), "sparse_dist"), r6(vec.sparse_dot("m", "m"), "sparse_dot"))


@add("example_edit", """
SELECT vec_id, round_even((embedding[1]::DOUBLE) * 1000000.0::DOUBLE, 0) / 1000000.0::DOUBLE + 0.0 AS f0, -1.0::DOUBLE AS f5, label::DOUBLE AS l0, 2.5::DOUBLE AS weight,
       (label * 2)::DOUBLE AS l0_new FROM embeddings""")
def example_edit(spark, sf):
    ex = vectors(spark, sf).select("vec_id", "x", F.array(F.col("label").cast("double")).alias("y"), F.lit(1.0).alias("weight"))
    edited = ex.withColumns({"x": vec.with_element("x", 5, -1.0), "weight": F.lit(2.5),
                             "y2": vec.with_element("y", 0, F.col("y")[0] * 2)})
    return edited.select("vec_id", r6(vec.element("x", 0), "f0"), vec.element("x", 5).alias("f5"),
                         vec.element("y", 0).alias("l0"), "weight", vec.element("y2", 0).alias("l0_new"))


@add("word_count", """
WITH w AS (SELECT unnest(string_split(text, ' ')) AS word FROM documents)
SELECT word, count(*) AS n FROM w GROUP BY word""")
def word_count(spark, sf):
    words = rows.tokens(table(spark, sf, "documents"), "text")
    return words.groupBy("word").agg(F.count("*").alias("n"))


@add("batch_counts", """
WITH n AS (SELECT row_number() OVER (ORDER BY event_id) - 1 AS i FROM events)
SELECT i // 1000 AS tick, count(*) AS n FROM n GROUP BY 1""")
def batch_counts(spark, sf):
    stamped = rows.replay_stamp(table(spark, sf, "events").select("event_id"), ["event_id"], interval=1000)
    return stamped.groupBy("tick").agg(F.count("*").alias("n"))


@add("sample_fixed")
def sample_fixed(spark, sf):
    return rows.sample_fixed(visits(spark, sf).select("event_id", "user_id", "t"), 100, ["event_id"], seed=7)


@add("sample_weighted")
def sample_weighted(spark, sf):
    ev = visits(spark, sf).select("event_id", "value")
    return rows.draw_weighted(ev, "value", 1000, ["event_id"], seed=7).select("event_id", "value", "copies")
