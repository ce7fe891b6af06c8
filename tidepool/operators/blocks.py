"""Moving a model to the tasks in pieces of bounded size, and running numpy over Arrow batches.

A model (centroids, micro-clusters, spheres, a scoring window) is usually a few hundred rows.
It is read as one block if it fits ``Limits.block_rows`` and ``Limits.block_bytes``; otherwise
it is cut by a hash of its rows into blocks that do fit, and operators visit the blocks one
after the other, each visit being a narrow pass over the points.  No limit is placed on the
model itself, and points are never shuffled for it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.session import LIMITS, Limits, ship_package


@dataclass
class Block:
    """Columns of one model piece: scalars as 1-d arrays, vectors as 2-d arrays; ``index`` may hold one over its centres."""

    columns: dict[str, np.ndarray]
    index: object | None = None

    def __len__(self) -> int:
        return len(next(iter(self.columns.values()))) if self.columns else 0

    def __getitem__(self, name: str) -> np.ndarray:
        return self.columns[name]

    def __contains__(self, name: str) -> bool:
        return name in self.columns


def vector_matrix(column, width: int | None = None) -> np.ndarray:
    """List column to an (n, d) float64 matrix; NULL rows become NaN."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if column.null_count:
        keep = np.asarray(column.is_valid())
        part = vector_matrix(column.drop_null(), width)
        out = np.full((n, part.shape[1]), np.nan)
        out[keep] = part
        return out
    if n == 0:
        return np.zeros((0, width or 0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    d = len(flat) // n
    if (np.diff(column.offsets.to_numpy()) != d).any():
        raise ValueError("vectors of different length in one batch")
    if width and d != width:
        raise ValueError(f"vectors of {d} dimensions where {width} are needed")
    return flat.reshape(n, d)


def _to_block(table: pa.Table) -> Block:
    out = {}
    for name in table.column_names:
        col = table.column(name)
        if pa.types.is_list(col.type) or pa.types.is_large_list(col.type):
            out[name] = vector_matrix(col)
        else:
            out[name] = col.to_numpy()
    return Block(out)


def read_blocks(model: DataFrame, order: str, limits: Limits = LIMITS, place: str | None = None) -> Iterator[Block]:
    """Yield the model piece by piece, each piece sorted by ``order``; with ``place``, a vector column, rows of a piece lie close together."""
    ship_package(model.sparkSession)
    # How many rows make a block follows from a few of them, before more are fetched.
    probe = model.limit(64).toArrow()
    row_bytes = max(1, probe.nbytes // max(1, probe.num_rows))
    fits = max(1, min(limits.block_rows, limits.block_bytes // row_bytes))
    head = model.limit(fits + 1).toArrow() if probe.num_rows == 64 else probe
    if head.num_rows <= fits and head.nbytes <= limits.block_bytes:
        yield _to_block(head.sort_by(order))
        return
    kept = model.persist()
    try:
        pieces = -(-kept.count() // max(1, fits // 2))
        for piece in _slabs(kept, order, pieces, fits, place) if place else _shares(kept, order, pieces):
            piece = piece.toArrow()
            if piece.num_rows:
                yield _to_block(piece.sort_by(order))
    finally:
        kept.unpersist()


def _shares(rows: DataFrame, order: str, pieces: int) -> Iterator[DataFrame]:
    """Rows cut by a hash."""
    share = F.pmod(F.xxhash64(F.col(order)), F.lit(pieces))
    for i in range(pieces):
        yield rows.filter(share == i)


def _slabs(rows: DataFrame, order: str, pieces: int, fits: int, place: str) -> Iterator[DataFrame]:
    """Rows cut at quantiles of the dimension in which they reach farthest; a slab of more than ``fits`` rows is cut further by a hash."""
    d = rows.agg(F.max(F.size(place))).first()[0] or 0
    finite = [F.when(F.abs(v) < float("inf"), v) for v in (F.get(place, F.lit(j)) for j in range(d))]
    ends = rows.agg(*[F.max(v) - F.min(v) for v in finite]).first() if d else []
    widest = max(range(d), key=lambda j: ends[j] or 0.0, default=0)
    at = F.get(place, F.lit(widest))
    cuts = rows.select(at.alias("at")).approxQuantile("at", [i / pieces for i in range(1, pieces)], 1 / (8 * pieces))
    slab = F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c <= at)) if cuts else F.lit(0)
    sizes = rows.groupBy(slab.alias("slab")).agg(F.count("*").alias("n")).collect()
    for i, n in sorted((r["slab"], r["n"]) for r in sizes):
        yield from _shares(rows.filter(slab == i), order, -(-n // fits))


def list_column(matrix: np.ndarray) -> pa.Array:
    n, d = matrix.shape
    offsets = np.arange(0, (n + 1) * d, d, dtype=np.int32) if d else np.zeros(n + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.ascontiguousarray(matrix).ravel()))


def map_batches(df: DataFrame, add: list[T.StructField],
                kernel: Callable[[pa.RecordBatch], list], drop: tuple[str, ...] = ()) -> DataFrame:
    """Append columns computed batch by batch; all other columns pass through untouched."""
    keep = [f for f in df.schema.fields if f.name not in drop]
    names = [f.name for f in keep]
    schema = T.StructType(keep + add)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows == 0:
                continue
            extra = kernel(batch)
            yield pa.RecordBatch.from_arrays(
                [batch.column(n) for n in names] + [pa.array(e) if isinstance(e, np.ndarray) else e for e in extra],
                names=names + [f.name for f in add])

    return df.mapInArrow(run, schema)


# ---- numeric kernels ------------------------------------------------------------------------


def squared_distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """(n, q) squared distances, summed dimension by dimension (no cancellation)."""
    out = np.zeros((len(x), len(c)))
    for j in range(x.shape[1]):
        gap = x[:, j, None] - c[None, :, j]
        gap *= gap
        out += gap
    return out


def nearest_index(x: np.ndarray, c: np.ndarray, cells: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest row of c, first index on ties.

    Wide vectors are screened with one matrix product; rows whose best candidates lie within
    the rounding error of the product are decided by the plain sum of squares.
    """
    n, q = len(x), len(c)
    idx = np.zeros(n, np.int64)
    best = np.full(n, np.inf)
    usable = np.isfinite(c).all(axis=1) & (c.shape[1] == x.shape[1] > 0)  # a block of NULL centres has no width
    if not usable.all():  # a centre without numbers is infinitely far
        where = np.flatnonzero(usable)
        if len(where):
            idx, best = nearest_index(x, c[where], cells)
            idx = where[idx]
        return idx, best
    step = max(1, cells // max(1, q))
    wide = x.shape[1] > 12
    c_norm = (c * c).sum(axis=1) if wide else None
    for lo in range(0, n, step):
        part = x[lo:lo + step]
        if not wide:
            d2 = squared_distances(part, c)
            i = np.argmin(d2, axis=1)
            idx[lo:lo + step] = i
            best[lo:lo + step] = d2[np.arange(len(part)), i]
            continue
        x_norm = (part * part).sum(axis=1)
        rough = x_norm[:, None] - 2.0 * (part @ c.T) + c_norm[None, :]
        i = np.argmin(rough, axis=1)
        slack = 1e-9 * (x_norm + c_norm.max() + 1e-300)
        close = (rough <= rough[np.arange(len(part)), i][:, None] + slack[:, None]).sum(axis=1) > 1
        if close.any():
            i[close] = np.argmin(squared_distances(part[close], c), axis=1)
        gap = part - c[i]
        idx[lo:lo + step] = i
        best[lo:lo + step] = (gap * gap).sum(axis=1)
    return idx, best


def nearest_other(c: np.ndarray) -> np.ndarray:
    """Distance of every row to the nearest other row (inf if there is none)."""
    out = np.full(len(c), np.inf)
    step = max(1, (1 << 20) // max(1, len(c)))
    for lo in range(0, len(c), step):
        d2 = squared_distances(c[lo:lo + step], c)
        d2[np.arange(d2.shape[0]), np.arange(lo, lo + d2.shape[0])] = np.inf
        out[lo:lo + step] = np.sqrt(d2.min(axis=1))
    return out
