"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidepool.session import fresh_dir

SLICE_ROWS = 256  # texts that a task holds as Python strings at a time


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def keep(df: DataFrame, name: str, *, codec: str = "snappy") -> DataFrame:
    """Write to the folder that all executors share and read again: cuts lineage and is computed once."""
    path = fresh_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Steps:
    """Tables of the steps of one operator: each is written by ``keep``, and goes when nothing reads it any more.

    After each step the driver lets go of the shuffles behind what was written, which Spark otherwise does only when the driver's memory fills.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def keep(self, df: DataFrame, name: str, *, codec: str = "zstd") -> DataFrame:
        out = keep(df, name, codec=codec)
        self.paths[name] = out.inputFiles()[:1]
        self.release()
        return out

    def release(self) -> None:
        self.spark.sparkContext._jvm.System.gc()

    def drop(self, *names: str) -> None:
        """Remove the tables of steps that are done."""
        jvm = self.spark.sparkContext._jvm
        for name in names:
            for file in self.paths.pop(name, []):
                folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
                folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def fold_of(key: Column | str, parts: int) -> Column:
    """crc32 of the key written as text, modulo ``parts``."""
    return F.crc32(F.col(key).cast("string") if isinstance(key, str) else key.cast("string")) % parts


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``rows`` rows; at the end the worker gives its buffers back, as others need the room."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
        del batch
    release()


def release() -> None:
    """Free memory back to the system: a worker that waits for its next task keeps none of what this one needed."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The column as strings, null as the empty text."""
    return ["" if t is None else t for t in batch.column(column).to_pylist()]


def bounded_sample(df: DataFrame, key: str, rows: int, seed: str) -> list:
    """At most ``rows`` rows, drawn by a hash of ``key``: the same rows whatever the layout of the input."""
    ranked = df.withColumn("_draw", F.xxhash64(F.lit(seed), F.col(key)))
    return ranked.orderBy("_draw", *[F.col(c) for c in df.columns]).limit(rows).drop("_draw").collect()


def stratified(df: DataFrame, label: str, key: str, per_label: int, seed: str, most_labels: int = 1000) -> list:
    """At most ``per_label`` different rows of each label on the driver, drawn by a hash of ``key`` and the row.

    The hash bound of a label follows from its count, so that about so many rows, and never a whole label, are gathered.  A key with many
    rows is drawn row by row; equal rows are one, and put together before they are shuffled.
    """
    counts = {r[label]: r["count"] for r in df.groupBy(label).count().limit(most_labels + 1).collect()}
    if len(counts) > most_labels:
        raise ValueError(f"more than {most_labels} labels in {label}")
    if not counts:
        return []
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(key), *[F.col(c) for c in df.columns if c not in (key, label)]), F.lit(1 << 30)) / F.lit(float(1 << 30))
    wanted = per_label + 5 * per_label ** 0.5 + 10
    share = F.create_map(*[x for v, n in counts.items() for x in (F.lit(v), F.lit(min(1.0, wanted / n)))])
    rows = df.withColumn("_draw", draw).filter(F.col("_draw") < share[F.col(label)]).dropDuplicates().collect()
    taken, out = dict.fromkeys(counts, 0), []
    for row in sorted(rows, key=lambda r: (r["_draw"], str(r))):
        if taken[row[label]] < per_label:
            taken[row[label]] += 1
            out.append(row)
    return out


def texts_for(sample: list, docs: DataFrame, key: str, text: str) -> list[tuple]:
    """(label, text) of the sampled (key, label) rows that have a text, in an order that only depends on the rows.

    The sample is of bounded size, so it goes to the texts.  Of several texts of a key the one with the least hash counts, so that as many texts
    as keys come back.
    """
    if not sample:
        return []
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(r["key"], r["label"]) for r in sample], "key bigint, label int")
    found = docs.select(docs[key].cast("bigint").alias("key"), docs[text].alias("text")).filter("text is not null").join(
        F.broadcast(wanted), "key").groupBy("key", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).collect()
    return [(r["label"], r["text"]) for r in sorted(found, key=lambda r: (r["key"], r["text"]))]
