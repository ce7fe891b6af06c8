"""Two tables row by row, whatever lies between: every block of the one meets every block of the other in a task of its own.

For work that is quadratic by nature, or where bounds leave nothing out.  Rows are dealt to blocks of bounded size by a hash, a block is sent
once to every block of the other table, and nothing passes through the driver.  With b blocks a side every row is sent b times, and b
follows from the cores and from ``Limits.block_bytes``, not from the number of pairs.

Distances of wide vectors are screened with one matrix product, and decided by the plain sum of squares wherever rounding could matter.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.blocks import squared_distances, vector_matrix
from tidepool.session import LIMITS, Limits, ship_package

LEAST_ROWS, WIDE = 2048, 12
COLUMNS = ("id", "key", "x", "value")


def whole_numbers(column) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of a column, 0 where it is NULL, and which of them are there."""
    there = np.asarray(column.is_valid())
    return column.fill_null(0).to_numpy(zero_copy_only=False), there


def blocks_of(home: int, visitors: int, d: int, cores: int, limits: Limits = LIMITS) -> tuple[int, int]:
    """Numbers of blocks: four tasks a core, fewer for few rows, more where a block would be too large."""
    side = math.ceil(math.sqrt(4 * cores))
    of_home, of_visitors = (max(1, math.ceil(rows / LEAST_ROWS)) for rows in (home, visitors))
    fits = max(1, min(limits.block_rows, limits.block_bytes // (8 * max(1, d))))
    h = max(min(max(1, side // 2), of_home), math.ceil(home / fits))
    return h, min(of_visitors, max(1, math.ceil(side * side / h)))


def meet_all(home: DataFrame, visitors: DataFrame, result: str | T.StructType, kernel: Callable, *, limits: Limits = LIMITS) -> DataFrame:
    """Run ``kernel`` on every pair of blocks; what it says about a row of ``home`` comes once for each block of visitors.

    Both tables are (id, key, x, value): numbers, vectors of one width (none NULL), a double.  ``kernel(ids, keys, x, values)`` gives a pair of
    functions, ``see`` of the same four for some visitors and ``done()``; both return lists of columns of ``result`` or None.
    ``ids`` and ``keys`` are Arrow columns.
    """
    spark = home.sparkSession
    ship_package(spark)
    home, visitors = home.select(*COLUMNS), visitors.select(*COLUMNS)
    told = [t.agg(F.count("*").alias("n"), F.max(F.size("x")).alias("d")).first() for t in (home, visitors)]
    h, v = blocks_of(told[0]["n"], told[1]["n"], max(t["d"] or 0 for t in told), spark.sparkContext.defaultParallelism, limits)

    def block(parts):
        return F.pmod(F.xxhash64(*COLUMNS), F.lit(parts)).cast("int")

    def every(parts):
        return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))

    sent = (home.withColumn("_b", block(h)).withColumn("_o", every(v)).select((F.col("_b") * v + F.col("_o")).alias("task"), F.lit(0).alias("visitor"), *COLUMNS)
            .unionByName(visitors.withColumn("_b", block(v)).withColumn("_o", every(h))
                         .select((F.col("_o") * v + F.col("_b")).alias("task"), F.lit(1).alias("visitor"), *COLUMNS)))
    schema = T._parse_datatype_string(result) if isinstance(result, str) else result
    names = schema.fieldNames()

    def run(batches):
        task, held, live, width = None, [], None, None

        def columns(out):
            return [] if out is None else [pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in out], names=names)]

        def four(batch):
            return batch.column("id"), batch.column("key"), vector_matrix(batch.column("x"), width), batch.column("value").to_numpy(zero_copy_only=False)

        for whole in batches:
            if not whole.num_rows:
                continue
            keys = np.column_stack([whole.column(c).to_numpy() for c in ("task", "visitor")])
            cuts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)])
            for a, b in zip(cuts, [*cuts[1:], len(keys)]):
                if keys[a, 0] != task:
                    if live:
                        yield from columns(live[1]())
                    task, held, live, width = keys[a, 0], [], None, None
                got = whole.slice(a, b - a)
                if not keys[a, 1]:
                    held.append(got)
                    continue
                if live is None and held:
                    block = four(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                    live, held, width = kernel(*block), [], block[2].shape[1]
                if live:
                    yield from columns(live[0](*four(got)))
        if live:
            yield from columns(live[1]())

    return sent.repartition(2 * h * v, "task").sortWithinPartitions("task", "visitor").mapInArrow(run, schema)


# ---- numeric kernels ------------------------------------------------------------------------


def rounding(d: int) -> float:
    """Bound of the rounding error of a squared distance taken from a matrix product, as a share of the squared lengths."""
    return 8 * (d + 4) * np.finfo(float).eps


def paired(x: np.ndarray, c: np.ndarray, i: np.ndarray, j: np.ndarray, step: int = 1 << 16) -> np.ndarray:
    """Squared distances of the pairs x[i], c[j], with the sums of ``squared_distances``."""
    out = np.zeros(len(i))
    for lo in range(0, len(i), step):
        a, b = x[i[lo:lo + step]], c[j[lo:lo + step]]
        a -= b
        a *= a
        for column in np.ascontiguousarray(a.T):
            out[lo:lo + step] += column
    return out


class Reference:
    """Finite rows to which others are compared, with what the screening needs."""

    def __init__(self, c: np.ndarray):
        self.c = c
        self.norm = (c * c).sum(axis=1)
        self.longest = self.norm.max(initial=0.0)

    def rough(self, x: np.ndarray, norm: np.ndarray, s: int, e: int) -> np.ndarray:
        out = x @ self.c[s:e].T
        out *= -2.0
        out += self.norm[s:e]
        out += norm[:, None]
        return out

    def screens(self, norm: np.ndarray) -> bool:
        return self.c.shape[1] > WIDE and bool(np.isfinite(norm).all()) and np.isfinite(self.longest)


def within(x: np.ndarray, reference: Reference, limit2: float, strict: bool = True) -> np.ndarray:
    """(rows of the reference, rows of x): whose squared distance is below ``limit2`` (or equal, if not strict)."""
    norm = (x * x).sum(axis=1)
    if not reference.screens(norm):
        d2 = squared_distances(reference.c, x)
        return d2 < limit2 if strict else d2 <= limit2
    rough = reference.rough(x, norm, 0, len(reference.c))
    slack = rounding(x.shape[1]) * (norm + reference.longest)
    near = rough < limit2 - slack[:, None]
    i, j = np.nonzero(near ^ (rough <= limit2 + slack[:, None]))
    if len(i):
        d2 = paired(x, reference.c, i, j)
        near[i, j] = d2 < limit2 if strict else d2 <= limit2
    return near.T


class Nearest:
    """The k nearest rows of every group, for rows that come in batches; rows with the same key do not count."""

    def __init__(self, keys, groups, x: np.ndarray, k: int):
        groups, _ = whole_numbers(groups)
        keys, keyed = whole_numbers(keys)
        whole = np.flatnonzero(np.isfinite(x).all(axis=1))
        order = whole[np.argsort(groups[whole], kind="stable")]
        self.reference, self.k = Reference(x[order]), k
        self.names, starts = np.unique(groups[order], return_index=True)
        self.bounds = np.append(starts, len(order))
        keys, keyed = keys[order], np.flatnonzero(keyed[order])
        self.place = keyed[np.argsort(keys[keyed], kind="stable")]
        self.keys = keys[self.place]

    def lists(self, keys, x: np.ndarray):
        """(rows, groups, list column of sorted distances) of some rows."""
        keys, keyed = whole_numbers(keys)
        found = []
        whole = np.flatnonzero(np.isfinite(x).all(axis=1))
        step = int(np.clip((1 << 20) // max(1, np.diff(self.bounds).max(initial=1)), 16, 4096))
        for lo in range(0, len(whole) if len(self.names) else 0, step):
            rows = whole[lo:lo + step]
            i, g, d2 = self._near(x[rows], keys[rows], keyed[rows])
            found.append((rows[i], g, d2))
        rows, g, d2 = (np.concatenate(c) for c in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        order = np.lexsort((d2, g, rows))
        rows, g, d2 = rows[order], g[order], d2[order]
        starts = np.flatnonzero(np.r_[True, (rows[1:] != rows[:-1]) | (g[1:] != g[:-1])]) if len(rows) else np.zeros(0, np.int64)
        size = np.diff(np.append(starts, len(rows)))
        keep = np.arange(len(rows)) - np.repeat(starts, size) < self.k
        offsets = np.concatenate([[0], np.minimum(size, self.k).cumsum()]).astype(np.int32)
        return rows[starts], self.names[g[starts]], pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.sqrt(d2[keep])))

    def _near(self, x, keys, keyed):
        """Candidates for the k nearest of every group, (row, group, squared distance); they hold the k nearest."""
        ref = self.reference
        first, last = (np.searchsorted(self.keys, keys, side) for side in ("left", "right"))
        same = np.where(keyed, last - first, 0)
        own = np.repeat(np.arange(len(x)), same)
        own_at = self.place[np.repeat(first - np.concatenate([[0], same.cumsum()[:-1]]), same) + np.arange(len(own))]
        norm = (x * x).sum(axis=1)
        screens = ref.screens(norm)
        slack = 2 * rounding(x.shape[1]) * (norm + ref.longest) if screens else np.zeros(len(x))
        rows, at, groups = [], [], []
        for g, (s, e) in enumerate(zip(self.bounds, self.bounds[1:])):
            d2 = ref.rough(x, norm, s, e) if screens else squared_distances(x, ref.c[s:e])
            mine = (own_at >= s) & (own_at < e)
            d2[own[mine], own_at[mine] - s] = np.inf
            i, j = _smallest(d2, self.k, slack if screens else None)
            rows.append(i)
            at.append(j + s)
            groups.append(np.full(len(i), g))
        i, j, g = np.concatenate(rows), np.concatenate(at), np.concatenate(groups)
        d2 = paired(x, ref.c, i, j)
        real = np.isfinite(d2)
        return i[real], g[real], d2[real]


def _smallest(d2: np.ndarray, k: int, slack: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the k smallest of every row and, with ``slack``, of all that may be among them; infinite ones are none.  Overwrites ``d2``."""
    n, q = d2.shape
    every = np.arange(n)
    if q <= k:
        return np.nonzero(np.isfinite(d2))
    if k > 8:
        top = np.partition(d2, k - 1, axis=1)[:, k - 1]
        return np.nonzero((d2 <= (top if slack is None else top + slack)[:, None]) & np.isfinite(d2))
    picked, value = [], []
    for _ in range(k):
        j = d2.argmin(axis=1)
        picked.append(j)
        value.append(d2[every, j])
        d2[every, j] = np.inf
    i, j, v = np.tile(every, k), np.concatenate(picked), np.concatenate(value)
    real = np.isfinite(v)
    i, j = i[real], j[real]
    if slack is not None:
        close = np.flatnonzero(d2.min(axis=1) <= value[-1] + slack)
        close = close[np.isfinite(value[-1][close])]
        if len(close):
            a, b = np.nonzero(d2[close] <= (value[-1] + slack)[close, None])
            i, j = np.concatenate([i, close[a]]), np.concatenate([j, b])
    return i, j
