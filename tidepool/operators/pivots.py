"""Range joins in any number of dimensions: rows meet at pivots, bounded by rings.

A bounded sample of rows serves as pivots.  Every row is at home at its nearest pivot, in a ring as wide as the reach.  Two rows within
reach of each other differ by no more than the reach in their distance to any pivot, and a row can only have neighbours at home at pivots
that are at most twice the reach farther than its own (the hyperplane between two cells).  So a row visits those pivots, in the ring of its
distance and the rings beside it, and meets all its neighbours there; one shuffle brings both together.

A ring with many rows is dealt to parts of ``block`` rows at home; visitors go to each part and stream past.  Each row is at home in one part
only, so what is said about it needs no further aggregation, and no pairs are emitted.  Nothing but the pivots reaches the driver.

Where the reach is so wide that most rows would visit most pivots, blocks of rows meet blocks of visitors instead (``operators.pairs``).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.blocks import list_column, squared_distances, vector_matrix
from tidepool.operators.components import forest
from tidepool.operators.pairs import Reference, meet_all, within
from tidepool.session import LIMITS, Limits, ship_package

MOST_PIVOTS, BLOCK = 1024, 2048
BLOCKS = 16  # visits of a row from which all blocks are sent to all blocks instead, see ``operators.pairs``
PLACED = "cell int, ring long, visitor int, id long, x array<double>, value double"


@dataclass(frozen=True)
class Pivots:
    """Centres of the cells and the width of a ring, the reach with room for rounding."""

    centre: np.ndarray
    ring: float
    visits: float = 0.0  # rings that a row visits, on average over the pivots

    def exclude(self, blocks: int) -> bool:
        """Whether rows visit fewer rings than there are blocks to send them to."""
        return self.visits <= blocks


def choose(rows: DataFrame, reach: float, *, x: str = "x", limits: Limits = LIMITS) -> Pivots | None:
    """Pivots drawn by a hash of the place, as many as the root of the rows, ``MOST_PIVOTS`` at most; None without rows."""
    size = F.array_max(F.transform(x, lambda v: F.abs(v)))
    told = rows.agg(F.count("*").alias("n"), F.max(size).alias("far"), F.max(F.size(x)).alias("d")).first()
    if not told["n"]:
        return None
    fits = max(1, limits.block_bytes // (8 * told["d"]))
    drawn = rows.select(x).distinct().orderBy(F.xxhash64(x), x).limit(min(MOST_PIVOTS, fits, math.ceil(math.sqrt(told["n"]))))
    centre = np.array([r[0] for r in drawn.collect()])
    ring = reach * (1 + 1e-9) + 1e-7 * math.sqrt(told["d"]) * (told["far"] or 0.0)
    gap = np.sqrt(squared_distances(centre, centre))
    np.fill_diagonal(gap, np.inf)  # a pivot as any other row
    visits = 3.0 * (gap <= gap.min(axis=1, keepdims=True) + 2 * ring).sum(axis=1).mean() if len(centre) > 1 else 3.0
    return Pivots(centre, ring, visits)


def _place(rows: DataFrame, pivots: Pivots, visitor: bool) -> DataFrame:
    """Rows at home, or in all the rings that they visit."""
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        centre, width = shared.value.centre, shared.value.ring
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                at = vector_matrix(batch.column("x"), centre.shape[1])
                gap = np.sqrt(squared_distances(at, centre))
                home = gap.argmin(axis=1)
                ids, value = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "value"))
                if visitor:
                    row, cell = np.nonzero(gap <= gap.min(axis=1, keepdims=True) + 2 * width)
                    ring = np.floor(gap[row, cell] / width).astype(np.int64)
                    row, cell = np.repeat(row, 3), np.repeat(cell, 3)
                    ring = (ring[:, None] + np.array([-1, 0, 1])).ravel()
                else:
                    row, cell = np.arange(len(at)), home
                    ring = np.floor(gap[row, cell] / width).astype(np.int64)
                for a in range(0, len(row), 8192):
                    r = row[a:a + 8192]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(cell[a:a + 8192].astype(np.int32)), pa.array(ring[a:a + 8192]), pa.array(np.full(len(r), int(visitor), np.int32)),
                         pa.array(ids[r]), list_column(at[r]), pa.array(value[r].astype(float))],
                        names=["cell", "ring", "visitor", "id", "x", "value"])

    return rows.select("id", "x", F.col("value").cast("double").alias("value")).mapInArrow(run, PLACED)


def meet(home: DataFrame, visitors: DataFrame, reach: float, pivots: Pivots, result: str, kernel: Callable, *, strict: bool = True,
         block: int = BLOCK) -> DataFrame:
    """Run ``kernel`` on the rows at home in each part.

    Both tables are (id, x, value) with finite x.  ``kernel(ids, values)`` gives a pair of functions: ``see(near, ids, values)`` for a matrix of
    who is within reach of some visitors, and ``done()``; both return lists of columns of ``result`` or None.
    """
    ship_package(home.sparkSession)
    if not pivots.exclude(BLOCKS):
        return _meet_in_blocks(home, visitors, reach, result, kernel, strict)
    at_home = _place(home, pivots, False)
    rings = (at_home.groupBy("cell", "ring").agg(F.count("*").alias("rows"))
             .select("cell", "ring", F.ceil(F.col("rows") / block).cast("int").alias("parts")))
    every = at_home.unionByName(_place(visitors, pivots, True)).join(rings, ["cell", "ring"])
    own = F.array(F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = every.withColumn("part", F.explode(F.when(F.col("visitor") == 0, own).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).drop("parts")
    limit2, schema = reach * reach, T._parse_datatype_string(result)
    names = schema.fieldNames()

    def run(batches):
        part, ids, xs, values, live = None, [], [], [], None

        def columns(out):
            return [] if out is None else [pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=names)]

        for whole in batches:
            keys = np.column_stack([whole.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "ring", "part", "visitor")])
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else []
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                now, visiting = tuple(keys[a, :3]), keys[a, 3]
                if now != part:
                    if live:
                        yield from columns(live[1]())
                    part, ids, xs, values, live = now, [], [], [], None
                got = whole.slice(a, b - a)
                there = vector_matrix(got.column("x"))
                theirs, worth = (got.column(c).to_numpy(zero_copy_only=False) for c in ("id", "value"))
                if not visiting:
                    ids, xs, values = [*ids, theirs], [*xs, there], [*values, worth]
                    continue
                if not ids:
                    continue
                if live is None:
                    x = np.vstack(xs)
                    live = kernel(np.concatenate(ids), np.concatenate(values))
                step = max(1, (1 << 21) // len(x))
                for lo in range(0, len(there), step):
                    d2 = squared_distances(x, there[lo:lo + step])
                    yield from columns(live[0](d2 < limit2 if strict else d2 <= limit2, theirs[lo:lo + step], worth[lo:lo + step]))
        if live:
            yield from columns(live[1]())

    return dealt.repartition("cell", "ring", "part").sortWithinPartitions("cell", "ring", "part", "visitor").mapInArrow(run, schema)


def _meet_in_blocks(home, visitors, reach, result, kernel, strict):
    """``meet`` where the pivots leave out little: blocks of rows meet blocks of visitors, and what blocks say about a row is put together."""

    def block_kernel(ids, _, x, values):
        reference, (see, done) = Reference(x), kernel(ids.to_numpy(), values)

        def visit(theirs, _, there, worth):
            theirs, step = theirs.to_numpy(), max(1, (1 << 21) // len(x))
            for lo in range(0, len(there), step):
                see(within(there[lo:lo + step], reference, reach * reach, strict), theirs[lo:lo + step], worth[lo:lo + step])

        return visit, done

    def sent(rows):
        return rows.select("id", F.lit(None).cast("long").alias("key"), "x", F.col("value").cast("double").alias("value"))

    parts = meet_all(sent(home), sent(visitors), result, block_kernel)
    put = {mass_kernel: ("id", F.sum("mass").alias("mass")), least_kernel: ("id", F.min("least").alias("least"))}
    if kernel not in put:
        return parts
    key, together = put[kernel]
    return parts.groupBy(key).agg(together)


def mass_kernel(ids, values):
    """(id, mass): what the visitors within reach weigh together."""
    mass = np.zeros(len(ids))

    def see(near, _, worth):
        mass[:] += near @ worth

    return see, lambda: [ids, mass]


def link_kernel(ids, values):
    """(src, dst): links that connect what is within reach, at most one for a row and a visitor."""
    kept, size = [], [0]

    def tied():
        a, b = (np.concatenate(c) for c in zip(*kept))
        nodes, inv = np.unique(np.concatenate([a, b]), return_inverse=True)
        root = forest(len(nodes), inv[:len(a)], inv[len(a):])
        link = root != np.arange(len(nodes))
        kept[:], size[0] = [(nodes[link], nodes[root[link]])], int(link.sum())

    def see(near, theirs, _):
        i, j = np.nonzero(near)
        kept.append((ids[i], theirs[j]))
        size[0] += len(i)
        if size[0] > 4 * len(ids) + (1 << 20):
            tied()

    def done():
        if kept:
            tied()
        return list(kept[0]) if size[0] else None

    return see, done


def least_kernel(ids, values):
    """(id, least): the smallest value of the visitors within reach."""
    least = np.full(len(ids), np.inf)

    def see(near, _, worth):
        least[:] = np.minimum(least, np.where(near, worth[None, :], np.inf).min(axis=1))

    def done():
        found = np.isfinite(least)
        return [ids[found], least[found]]

    return see, done
