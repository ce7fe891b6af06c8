"""Session set-up, lineage cutting and size checks shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_FLOAT = 1.7976931348623157e308


@dataclass(frozen=True)
class Limits:
    """Bounds that decide between a one-piece and a divided way of doing the same work.

    block_rows / block_bytes   size of one broadcast piece of a model; larger models are
                               broadcast piece by piece, see ``operators.blocks``
    fold_rows                  rows that a coreset is reduced to before its last round
    index_rows                 centres from which a lookup goes through a two-level index
    inline_terms               q*d up to which a model is inlined as column expressions
    """

    block_rows: int = 65_536
    block_bytes: int = 64 << 20
    fold_rows: int = 35_000
    index_rows: int = 512
    inline_terms: int = 96


LIMITS = Limits()


def get_session(app: str = "tidepool", master: str | None = None, **conf) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **{k.replace("__", "."): str(v) for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    ship_package(spark)
    return spark


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers of all executors (once per application)."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if os.path.isdir(root):
        path = os.path.join(tempfile.mkdtemp(prefix="tidepool-code-"), "tidepool.zip")
        with zipfile.ZipFile(path, "w") as out:
            for folder, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        full = os.path.join(folder, name)
                        out.write(full, os.path.join("tidepool", os.path.relpath(full, root)))
        context.addPyFile(path)
    _shipped.add(context.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by the cluster.

    Only a local session without the setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tidepool-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder (not created)."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors, unlike a local one."""
    spark = df.sparkSession
    folder = shared_dir(spark)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def is_empty(df: DataFrame) -> bool:
    """Empty-batch guard: stops at the first row found."""
    return df.isEmpty()


def width_of(df: DataFrame, x: str = "x") -> int:
    """Number of dimensions; an error if the vectors differ in it (0 without vectors)."""
    size = F.when(F.col(x).isNotNull(), F.size(x))
    low, high = df.agg(F.min(size), F.max(size)).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} dimensions in {x}")
    return low or 0
