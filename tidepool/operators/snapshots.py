"""Pyramidal snapshots of a model: which ticks are kept, lookup, horizon queries, parquet store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.functions import vec


def order_of(tick, alpha: int = 2) -> Column:
    """Largest i with alpha^i dividing the tick."""
    t = F.col(tick) if isinstance(tick, str) else tick
    out = F.lit(0)
    power, i = alpha, 1
    while power < 1 << 62:
        out = F.when(F.pmod(t, F.lit(power)) == 0, F.lit(i)).otherwise(out)
        power, i = power * alpha, i + 1
    return F.when(t > 0, out)


def expiry(tick, alpha: int = 2, l: int = 2) -> Column:  # noqa: E741
    """The tick at which this tick's snapshot is dropped."""
    t = F.col(tick) if isinstance(tick, str) else tick
    return t + F.lit(alpha ** l + 1) * F.pow(F.lit(float(alpha)), order_of(t, alpha) + 1).cast("long")


def kept_ticks(ticks: DataFrame, now: Column, alpha: int = 2, l: int = 2, tick: str = "tick") -> DataFrame:  # noqa: E741
    """Ticks whose snapshot exists at ``now`` (every tick up to now having run)."""
    return ticks.filter((F.col(tick) <= now) & (expiry(tick, alpha, l) > now))


def pick(ticks: DataFrame, now: int, horizon: int, tick: str = "tick") -> DataFrame:
    """One row (t1, t2): the latest tick <= now, and the latest <= t1 - horizon, else the earliest above; -1 if none."""
    t1 = F.coalesce(ticks.filter(F.col(tick) <= now).agg(F.max(tick)).scalar(), F.lit(-1))
    t = F.col(tick)
    base = ticks.withColumn("_t1", t1)
    return base.agg(
        F.coalesce(F.max("_t1"), F.lit(-1)).alias("t1"),
        F.coalesce(F.max(F.when(t <= F.col("_t1") - horizon, t)), F.min(F.when(t > F.col("_t1") - horizon, t)),
                   F.lit(-1)).alias("t2")).select(
        "t1", F.when(F.col("t1") == -1, F.lit(-1)).otherwise(F.col("t2")).alias("t2"))


def horizon_features(newer: DataFrame, older: DataFrame) -> DataFrame:
    """Newer cluster features minus the older ones that went into them (shared lineage ids).

    Lineage ids are exploded to an equi-join, each old cluster is taken off once.
    """
    new_ids = newer.select(F.col("mc_id"), F.explode("ids").alias("lid"))
    old_ids = older.select(F.col("mc_id").alias("old_id"), F.explode("ids").alias("lid"))
    links = new_ids.join(old_ids, "lid").select("mc_id", "old_id").distinct()
    past = older.select(F.col("mc_id").alias("old_id"), "n", "ls", "ss", "lst", "sst")
    taken = links.join(past, "old_id")
    from tidepool.operators.cf import cf_merge

    minus = taken.select("mc_id", (-F.col("n")).alias("n"), vec.scale("ls", -1.0).alias("ls"),
                         vec.scale("ss", -1.0).alias("ss"), (-F.col("lst")).alias("lst"), (-F.col("sst")).alias("sst"))
    plus = newer.select("mc_id", "n", "ls", "ss", "lst", "sst")
    return cf_merge(plus.unionByName(minus)).filter("n > 0")


def prune_lineage(model: DataFrame, older: DataFrame) -> DataFrame:
    """The model with one lineage id for every cluster of a kept snapshot that went into it, and one for all it got since.

    ``older`` is (tick, mc_id, ids) of the snapshots still kept, all before the model.  Clusters only ever join, so ids that share a
    cluster in the earliest snapshot that knows them, and in the model, share one in all between and ever after: the largest stands for all.
    A horizon query against any of these snapshots finds the same links, and the number of ids is at most clusters x (snapshots + 1).
    The largest id of all stays, so that new ids remain new.  Clusters without ids keep none.
    """
    now = model.select("mc_id", F.explode("ids").alias("lid"))
    past = older.select("tick", F.col("mc_id").alias("_at"), F.explode("ids").alias("lid"))
    known = past.groupBy("lid").agg(F.min(F.struct("tick", "_at")).alias("_seen"))
    kept = (now.join(known, "lid", "left").groupBy("mc_id", "_seen").agg(F.max("lid").alias("lid"))
            .groupBy("mc_id").agg(F.sort_array(F.collect_list("lid")).alias("_ids")))
    ids = F.coalesce("_ids", F.when(F.col("ids").isNotNull(), F.array().cast("array<bigint>")))
    return model.join(kept, "mc_id", "left").withColumn("ids", ids).select(*model.columns)


# ---- store ------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def save(model: DataFrame, folder: str, tick: int, alpha: int = 2, l: int = 2) -> None:  # noqa: E741
    """Write the model at a tick and drop the snapshot this tick replaces."""
    spark = model.sparkSession
    model.write.mode("overwrite").parquet(f"{folder}/tick={tick}")
    if tick <= 0:
        return
    order = 0
    while tick % alpha ** (order + 1) == 0:
        order += 1
    old = tick - (alpha ** l + 1) * alpha ** (order + 1)
    if old > 0:
        fs, path = _fs(spark, f"{folder}/tick={old}")
        fs.delete(path, True)


def saved_ticks(spark: SparkSession, folder: str) -> DataFrame:
    """(tick) of the snapshots on disk, from the folder listing."""
    fs, path = _fs(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
    ticks = [(int(n[5:]),) for n in names if n.startswith("tick=")]
    return spark.createDataFrame(ticks, "tick long")


def load(spark: SparkSession, folder: str, tick: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/tick={tick}")


def prune_against_saved(model: DataFrame, folder: str, before: int) -> DataFrame:
    """``prune_lineage`` against the snapshots on disk of ticks below ``before``."""
    spark = model.sparkSession
    ticks = [r["tick"] for r in saved_ticks(spark, folder).filter(F.col("tick") < before).collect()]
    older = spark.createDataFrame([], "tick long, mc_id long, ids array<bigint>")
    for tick in ticks:  # logarithmically many
        older = older.unionByName(load(spark, folder, tick).select(F.lit(tick).cast("long").alias("tick"), "mc_id", "ids"))
    return prune_lineage(model, older)


def horizon_query(spark: SparkSession, folder: str, now: int, horizon: int) -> DataFrame:
    """Cluster features of the last ``horizon`` ticks before ``now``."""
    row = pick(saved_ticks(spark, folder), now, horizon).first()
    if row["t1"] == -1:
        raise ValueError("no snapshot at or before the given tick")
    newer = load(spark, folder, row["t1"])
    return newer if row["t2"] in (-1, row["t1"]) else horizon_features(newer, load(spark, folder, row["t2"]))
