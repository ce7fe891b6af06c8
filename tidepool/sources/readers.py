"""Batch and streaming readers: Kafka topics, text folders, parquet folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidepool.sources import text


def kafka_lines(spark: SparkSession, servers: str, topics: str, *, starting: str = "latest",
                max_per_batch: int | None = None, **options) -> DataFrame:
    """Topic values as text (needs the Kafka connector on the classpath)."""
    reader = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
              .option("subscribe", topics).option("startingOffsets", starting))
    if max_per_batch:
        reader = reader.option("maxOffsetsPerTrigger", max_per_batch)
    for key, value in options.items():
        reader = reader.option(key.replace("__", "."), value)
    return reader.load().selectExpr("CAST(value AS STRING) AS value")


def text_stream(spark: SparkSession, folder: str, *, files_per_batch: int | None = 1) -> DataFrame:
    """Lines of the files of a folder, a few files per micro-batch."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def table_stream(spark: SparkSession, folder: str, schema, *, files_per_batch: int | None = 1,
                 pattern: str | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.format("parquet").schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(folder)


def timed_points(lines: DataFrame) -> DataFrame:
    return text.parse_timed(lines)


def untimed_points(lines: DataFrame) -> DataFrame:
    return text.parse_untimed(lines)


def vectors_from_text(spark: SparkSession, path: str) -> DataFrame:
    """Batch scan of ``f1,f2,...`` lines."""
    return text.parse_untimed(spark.read.text(path))


def labelled_from_text(spark: SparkSession, path: str, *, sep: str = ",", has_class: bool = True, n_classes: int = 25,
                       on_bad: str = "raise") -> DataFrame:
    """Batch scan of labelled lines; the width is that of the first data line."""
    lines = spark.read.text(path)
    return text.labelled_rows(lines, text.infer_width(lines, sep=sep), sep=sep, has_class=has_class,
                              n_classes=n_classes, on_bad=on_bad)
