"""Row numbering, replay stamps, samples and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidepool.session import LIMITS, cut_lineage


def number_rows(df: DataFrame, order: list, out: str = "idx") -> DataFrame:
    """0-based global row numbers in the given order, without one task seeing all rows.

    Rows are range-partitioned and sorted, numbered inside each partition, and shifted by the
    sizes of the partitions before (one small row per partition).
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [o if isinstance(o, Column) else F.col(o) for o in order]
    laid = cut_lineage(df.repartitionByRange(parts, *names).sortWithinPartitions(*names)
                       .withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright("_mid", 33).alias("_part")
    sizes = laid.groupBy(part).agg(F.count("*").alias("_n"))
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    shift = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    return (laid.withColumn("_part", part)
            .join(F.broadcast(shift), "_part")
            .withColumn(out, inside + F.col("_shift"))
            .drop("_part", "_mid", "_shift"))


def replay_stamp(df: DataFrame, order: list, *, interval: int = 1000, partitions: int = 32,
                 count: int | None = None, start: int = 0) -> DataFrame:
    """Stamp rows for a replay: tick = row // interval, partition = row mod partitions.

    With ``count`` beyond the table the rows wrap around, as often as needed; with ``count``
    below it the replay stops there.
    """
    rows = number_rows(df, order, "_i")
    if count is not None:
        total = rows.agg(F.count("*").alias("n")).scalar()
        rounds = F.ceil((F.lit(count) - F.col("_i")) / total).cast("int")
        rows = (rows.withColumn("_rounds", rounds).filter("_rounds > 0")
                .withColumn("_round", F.explode(F.sequence(F.lit(0), F.col("_rounds") - 1)))
                .withColumn("_i", F.col("_i") + F.col("_round") * total)
                .drop("_round", "_rounds"))
    return (rows.withColumn("tick", F.floor(F.col("_i") / interval).cast("long") + start)
            .withColumn("slot", F.pmod(F.col("_i"), F.lit(partitions)).cast("int"))
            .withColumnRenamed("_i", "row"))


def head(df: DataFrame, order: list, n: int) -> DataFrame:
    """First n rows in the given order: a top-k, so no task sorts the whole table."""
    return df.orderBy(*order).limit(n)


def row_slice(df: DataFrame, order: list, start: int, stop: int) -> DataFrame:
    return number_rows(df, order, "_i").filter((F.col("_i") >= start) & (F.col("_i") < stop)).drop("_i")


def last_rows(df: DataFrame, order: list, n: int) -> DataFrame:
    """The last n rows in the given order (an evaluation window)."""
    return df.orderBy(*[(F.col(o) if isinstance(o, str) else o).desc() for o in order]).limit(n)


def sample_fixed(df: DataFrame, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n rows drawn without replacement; the seed fixes the draw, not the row layout."""
    rank = F.xxhash64(F.lit(seed), *[F.col(k) for k in key])
    return df.orderBy(rank, *key).limit(n)


def sample_to_fill(df: DataFrame, need: int, *, oversample: float = 1.25, seed: int = 0) -> DataFrame:
    """A fraction sample sized to fill an initial buffer of ``need`` rows."""
    have = df.count()
    if have == 0 or need <= 0:
        return df.limit(0)
    fraction = oversample * need / have
    return df if fraction >= 1.0 else df.sample(False, fraction, seed)


def draw_weighted(df: DataFrame, weight: str, n: int, key: list[str], seed: int = 0) -> DataFrame:
    """n draws with replacement, each row with probability weight / total.

    Returns the drawn rows with the number of times each was drawn (``copies``), so a heavy row
    stays one row.  Draw i is a uniform number from [i, i+1) on a line of length n on which every
    row owns a span as long as its share (stratified drawing): the draws strictly inside a span
    are counted, only the two strata at its ends are looked at, and nothing is joined.
    """
    total = df.agg(F.sum(weight).cast("double").alias("s")).scalar()
    spans = cumulative(df.filter(F.col(weight) > 0), weight, key, "_cum").withColumns({
        "_lo": (F.col("_cum") - F.col(weight)) / total * n,
        "_hi": F.col("_cum") / total * n})

    def drawn(i):
        return i + F.pmod(F.xxhash64(F.lit(seed), i), F.lit(1 << 20)) / float(1 << 20)

    first, last = F.floor("_lo").cast("long"), F.floor("_hi").cast("long")
    same = (drawn(first) >= F.col("_lo")) & (drawn(first) < F.col("_hi"))
    at_ends = ((drawn(first) >= F.col("_lo")).cast("long")
               + ((drawn(last) < F.col("_hi")) & (last < n)).cast("long"))
    copies = F.when(first == last, same.cast("long")).otherwise(at_ends + last - first - 1)
    return spans.withColumn("copies", copies).filter("copies > 0").drop("_cum", "_lo", "_hi")


def cumulative(df: DataFrame, value: str, key: list[str], out: str) -> DataFrame:
    """Running sum of ``value`` in key order, partition by partition."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(parts, *key).withColumn("_part", F.spark_partition_id())
    laid = cut_lineage(laid)
    sums = laid.groupBy("_part").agg(F.sum(value).alias("_s"))
    shift = sums.select("_part", F.coalesce(
        F.sum("_s").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)).alias("_shift"))
    run = F.sum(value).over(W.partitionBy("_part").orderBy(*key).rowsBetween(W.unboundedPreceding, 0))
    return (laid.withColumn("_run", run).join(F.broadcast(shift), "_part")
            .withColumn(out, F.col("_run") + F.col("_shift")).drop("_part", "_run", "_shift"))


def shuffle_take(df: DataFrame, q: int, key: list[str], seed: int = 0) -> DataFrame:
    """Random order, first q rows."""
    return sample_fixed(df, q, key, seed)


def tokens(df: DataFrame, text: str = "value", sep: str = " ") -> DataFrame:
    return df.select(F.explode(F.split(F.col(text), f"\\Q{sep}\\E")).alias("word"))


def check_size(df: DataFrame, limit: int = LIMITS.block_rows) -> bool:
    """True if the table has at most ``limit`` rows; reads no further than that."""
    return df.select(F.lit(1)).limit(limit + 1).count() <= limit


def small_side(df: DataFrame, limit: int = LIMITS.block_rows) -> DataFrame:
    """A broadcast hint, but only if the table is checked to be small; else the join is left to Spark."""
    return F.broadcast(df) if check_size(df, limit) else df
