"""Near duplicates of vectors by Euclidean p-stable hashing, with exact cosine checks.

Vectors are brought to length one, where a cosine is a distance.  A table cuts ``width`` wide slices across ``projections`` random
directions; two vectors meet in a table if they share all slices.  Width goes with the distance of the threshold; the number of directions
grows with the logarithm of the rows, so that strangers stay about ``strangers`` to a bucket, and the number of tables follows
from the recall wanted for pairs exactly at the threshold (closer pairs are found more surely).

Equal vectors are one row with a count.  A bucket beyond ``block`` rows is dealt to blocks, and each pair of blocks is a task's own
work.  A pair is counted in the first table where it meets, so nothing is emitted by pair: each part gives the links of its
rows and the smallest row that links reach.  Components are settled from those.

Null, zero and non-finite vectors link with nothing; vectors of different lengths do not either.  Rows of one key are one
vector's: they share the component.  A row with a null key keeps to itself.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import keep, slices
from tidepool.operators.components import connected_components
from tidepool.session import ship_package


@dataclass(frozen=True)
class Hashing:
    threshold: float = 0.9
    recall: float = 0.995
    width: float = 4.0  # in distances of a pair at the threshold
    strangers: int = 64
    block: int = 1024
    seed: int = 11


def meets(ratio: float) -> float:
    """Probability that a pair shares a slice, by the slice's width over the pair's distance."""
    below = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * below - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-ratio * ratio / 2))


class Tables:
    def __init__(self, how: Hashing, rows: int):
        near = math.sqrt(2 - 2 * how.threshold)
        self.width = how.width * near
        stranger = meets(self.width / math.sqrt(2))  # vectors at right angles
        self.projections = max(4, round(math.log(max(1.0, rows / how.strangers)) / -math.log(stranger)))
        together = meets(how.width) ** self.projections
        self.count = math.ceil(math.log(1 - how.recall) / math.log1p(-together))
        self.seed = how.seed
        self._drawn: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def _draw(self, d: int) -> tuple[np.ndarray, np.ndarray]:
        if d not in self._drawn:
            draws = np.random.default_rng([self.seed, d])
            size = self.count * self.projections
            self._drawn[d] = draws.standard_normal((d, size)), draws.uniform(0, self.width, size)
        return self._drawn[d]

    def keys(self, unit: np.ndarray) -> np.ndarray:
        """(rows, tables) 32-bit bucket keys of vectors of length one."""
        direction, shift = self._draw(unit.shape[1])
        cell = np.floor((unit @ direction + shift) / self.width).astype(np.int64).astype(np.uint64)
        cell = cell.reshape(len(unit), self.count, self.projections)
        key = np.full(cell.shape[:2], unit.shape[1], np.uint64)
        for j in range(self.projections):
            key = (key ^ cell[:, :, j]) * np.uint64(0x9E3779B97F4A7C15)
            key ^= key >> np.uint64(29)
        return (key >> np.uint64(32)).astype(np.uint32).view(np.int32)


def usable(values) -> np.ndarray | None:
    """The vector in double precision, -0 as 0; None if it links with nothing."""
    if values is None or not len(values) or any(v is None for v in values):
        return None
    x = np.asarray(values, np.float64) + 0.0
    return x if np.isfinite(x).all() and x.any() else None


def signed(vectors: DataFrame, tables: Tables) -> DataFrame:
    """(id, copy, x, keys) of the usable vectors: digest, values and bucket keys as bytes."""

    def run(batches):
        for part in slices(batches, 2048):
            rows = [(i, x) for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()) if (x := usable(v)) is not None]
            keys = {}
            for d in {len(x) for _, x in rows}:
                where = [k for k, (_, x) in enumerate(rows) if len(x) == d]
                x = np.stack([rows[k][1] for k in where])
                unit = x / np.abs(x).max(axis=1, keepdims=True)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                keys |= dict(zip(where, tables.keys(unit)))
            yield pa.RecordBatch.from_arrays(
                [pa.array([i for i, _ in rows], pa.int64()), pa.array([xxhash.xxh3_128_digest(x.tobytes()) for _, x in rows], pa.binary()),
                 pa.array([x.tobytes() for _, x in rows], pa.binary()), pa.array([keys[k].tobytes() for k in range(len(rows))], pa.binary()),
                 pa.array([keys[k].tolist() for k in range(len(rows))], pa.list_(pa.int32()))],
                names=["id", "copy", "x", "keys", "buckets"])

    return vectors.mapInArrow(run, "id long, copy binary, x binary, keys binary, buckets array<int>")


def compare(x: np.ndarray, keys: np.ndarray, table: int, copies: np.ndarray, threshold: float,
            side: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Linked vectors of each row that meet in no earlier table, and the smallest position links reach."""
    norm = np.linalg.norm(x, axis=1)
    near = (x @ x.T) / np.outer(norm, norm) >= threshold
    if side is not None:
        near &= side[:, None] != side[None, :]
    a, b = np.nonzero(np.triu(near, 1))
    root = np.arange(len(x))
    links = np.zeros(len(x), np.int64)
    if len(a):
        while True:
            low = np.minimum(root[a], root[b])
            new = root.copy()
            np.minimum.at(new, a, low)
            np.minimum.at(new, b, low)
            new = new[new]
            if np.array_equal(new, root):
                break
            root = new
        for at in range(0, len(a), 1 << 16):
            i, j = a[at:at + (1 << 16)], b[at:at + (1 << 16)]
            first = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
            np.add.at(links, i[first], copies[j[first]])
            np.add.at(links, j[first], copies[i[first]])
    return links, root


def _verify(threshold: float):
    def settle(part, rows):
        if len(rows) < 2:
            return [], [], []
        order = sorted(rows, key=lambda r: r[0])
        ids = [r[0] for r in order]
        lengths = [len(r[1]) for r in order]
        found = []
        for size in set(lengths):  # equal keys of vectors of different lengths
            some = [r for r, n in zip(order, lengths) if n == size]
            side = np.array([r[4] for r in some]) if part[2] != part[3] else None
            links, root = compare(np.stack([np.frombuffer(r[1]) for r in some]), np.stack([np.frombuffer(r[2], np.int32) for r in some]),
                                  part[0], np.array([r[3] for r in some], np.int64), threshold, side)
            found += [(some[k][0], int(links[k]), some[int(root[k])][0]) for k in range(len(some)) if links[k] or root[k] != k]
        return tuple(map(list, zip(*found))) if found else ([], [], [])

    def packed(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "links", "root"])

    def run(batches):
        part, rows = None, []
        out = ([], [], [])
        for batch in slices(batches, 1024):
            for *now, i, x, keys, copies, side in zip(*(c.to_pylist() for c in batch.columns)):
                if now != part:
                    for have, new in zip(out, settle(part, rows)):
                        have += new
                    part, rows = now, []
                rows.append((i, x, keys, copies, side))
            if len(out[0]) > 10_000:
                yield packed(out)
                out = ([], [], [])
        for have, new in zip(out, settle(part, rows)):
            have += new
        yield packed(out)

    return run


def near_duplicates(vectors: DataFrame, how: Hashing = Hashing(), *, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(key, n_links, component_id, kept) of every row; ``key`` is a whole number."""
    ship_package(vectors.sparkSession)
    source = vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("v"))
    tables = Tables(how, source.count())
    rows = keep(signed(source.filter("id is not null and v is not null"), tables), "vectors")
    copies = keep(rows.groupBy("copy").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "copies")
    one = rows.dropDuplicates(["copy", "id"]).join(copies, "copy").filter("id = rep")
    met = one.select("id", "x", "keys", "copies", F.posexplode("buckets").alias("t", "bucket"))
    crowded = (one.select(F.posexplode("buckets").alias("t", "bucket")).groupBy("t", "bucket").agg(F.count("*").alias("n"))
               .filter("n > 1").withColumn("blocks", F.ceil(F.col("n") / how.block).cast("int")).drop("n"))
    parts = (met.join(crowded, ["t", "bucket"]).withColumn("side", F.pmod(F.hash("id", F.lit(3)), "blocks"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("t", "bucket", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"),
                     "id", "x", "keys", "copies", "side"))
    found = keep(parts.repartition("t", "bucket", "a", "b").sortWithinPartitions("t", "bucket", "a", "b")
                 .mapInArrow(_verify(how.threshold), "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.filter("root <> id").select(F.col("id").alias("src"), F.col("root").alias("dst")).distinct()
    component = connected_components(links.select(F.col("id").alias("node")), edges).select(F.col("node").alias("rep"), "component")
    known = copies.join(links.withColumnRenamed("id", "rep"), "rep", "left").join(component, "rep", "left").select(
        "copy", F.coalesce("component", "rep").alias("component_id"),
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    told = rows.select("id", "copy").join(known, "copy").groupBy("id").agg(
        F.min("component_id").alias("component_id"), F.max("n_links").alias("n_links"))
    return source.select("id").join(told, "id", "left").select(
        F.col("id").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
        (F.col("id") == F.coalesce("component_id", "id")).alias("kept"))
