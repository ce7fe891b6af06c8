"""Versioned model tables on a shared folder.

Version n + 1 is what batch n made of version n.  A version counts once its small commit file is
there, so a batch replayed after a failure either finds its version or writes it again.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ModelStore:
    """Folders ``version=<n>`` below ``path``; keeps the last ``keep`` versions."""

    COMMIT = "_commit.json"
    OWNER = "_owner"

    def __init__(self, spark: SparkSession, path: str, keep: int = 2):
        self.spark, self.path, self.keep = spark, path.rstrip("/"), keep

    def _at(self, *parts: str):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path("/".join((self.path, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def versions(self) -> list[int]:
        fs, root = self._at()
        if not fs.exists(root):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(root)]
        return sorted(int(n[8:]) for n in names if n.startswith("version=") and self.has(int(n[8:])))

    def bind(self, owner: str) -> None:
        """Tie the store to the checkpoint of one query; raise if it is another's."""
        fs, path = self._at(self.OWNER)
        if fs.exists(path):
            held = self._text(path, fs)
            if held != owner:
                raise ValueError(f"{self.path} holds the models of the query with checkpoint {held}, not {owner}")
            return
        out = fs.create(path, True)
        out.write(bytearray(owner.encode()))
        out.close()

    def _text(self, path, fs) -> str:
        return self.spark._jvm.org.apache.commons.io.IOUtils.toString(fs.open(path), "UTF-8")

    def has(self, version: int) -> bool:
        fs, path = self._at(f"version={version}", self.COMMIT)
        return fs.exists(path)

    def write(self, model: DataFrame, version: int) -> DataFrame:
        """Write the rows (not yet committed) and return them as read back."""
        folder = f"{self.path}/version={version}"
        model.write.mode("overwrite").parquet(folder)
        return self.spark.read.schema(model.schema).parquet(folder)

    def commit(self, version: int, meta: dict) -> None:
        fs, path = self._at(f"version={version}", self.COMMIT)
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        for old in self.versions()[:-self.keep]:
            fs, path = self._at(f"version={old}")
            fs.delete(path, True)

    def meta(self, version: int) -> dict:
        fs, path = self._at(f"version={version}", self.COMMIT)
        return json.loads(self._text(path, fs))

    def read(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/version={version}")

    def latest(self) -> int | None:
        found = self.versions()
        return found[-1] if found else None


class KeyedTable:
    """Latest values by key on a shared folder, written batch by batch.

    A batch writes only the rows of the keys it changed, to a folder of its own, so writing it again changes nothing.  A reader takes
    the row of the last batch of each key.  Every ``fold`` batches the folders are put together in one base; a base counts once it is whole, and
    what it holds is removed only then.
    """

    BATCH = "_batch"

    def __init__(self, spark: SparkSession, path: str, key: str, fold: int = 20):
        self.spark, self.path, self.key, self.fold = spark, path.rstrip("/"), key, fold

    def _folders(self, kind: str) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        numbers = sorted(int(n[len(kind) + 1:]) for n in names if n.startswith(kind + "="))
        done = self.spark._jvm.org.apache.hadoop.fs.Path
        return [n for n in numbers if fs.exists(done(f"{self.path}/{kind}={n}/_SUCCESS"))]

    def _remove(self, kind: str, number: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}={number}")
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def upsert(self, rows: DataFrame, batch: int) -> None:
        """The new rows of the keys that a batch changed, one row a key."""
        base = max(self._folders("base"), default=-1)
        if batch <= base:  # a replay of what the base holds
            return
        rows.withColumn(self.BATCH, F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        if batch - base >= self.fold:
            self._latest().write.mode("overwrite").parquet(f"{self.path}/base={batch}")
            for kind in ("base", "batch"):
                for old in self._folders(kind):
                    if old < batch or kind == "batch" and old == batch:
                        self._remove(kind, old)

    def _latest(self) -> DataFrame:
        base = self._folders("base")[-1:]
        later = [b for b in self._folders("batch") if not base or b > base[0]]
        paths = [f"{self.path}/base={b}" for b in base] + [f"{self.path}/batch={b}" for b in later]
        rows = self.spark.read.parquet(*paths)
        rest = [c for c in rows.columns if c not in (self.key, self.BATCH)]
        last = rows.groupBy(self.key).agg(F.max(F.struct(self.BATCH, *rest)).alias("_last"))
        return last.select(self.key, F.col(f"_last.{self.BATCH}").alias(self.BATCH), *[F.col(f"_last.{c}").alias(c) for c in rest])

    def read(self) -> DataFrame:
        return self._latest().drop(self.BATCH)


def save_model(model: DataFrame, path: str) -> None:
    """A model on its own, as a starting state for later runs."""
    model.write.mode("overwrite").parquet(path)


def load_model(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
