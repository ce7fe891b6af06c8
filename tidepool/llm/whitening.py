"""Whitening of embeddings along principal components found by spectral divide and conquer.

Entries are brought to whole numbers first, so every sum over the rows is exact and no layout or retry changes a digit.  The fit takes two
passes (sums; products of entries centred on the rounded mean), each adding up inside its tasks and handing on one matrix a task.  The
symmetric matrix that comes out has one row a dimension whatever the corpus holds, and is taken apart on the driver: the polar factor of
``V - shift`` by QR-based dynamically weighted Halley steps has the eigenvalues +1 above the shift and -1 below, hence two orthogonal
projectors; bases of their ranges split the matrix in two smaller ones, and so on down to single components.  Halves that hold none of the
wanted components are left alone.  The map (dimensions x components) goes to the tasks, which whiten row by row without a shuffle; a further
pass measures how far the covariance of what they write is from the identity.

Rows whose vector is null, empty, or holds null or non-finite entries are dropped, as are vectors of another length than the commonest (of
equally common ones the shortest stays) and rows with an entry of 2^53 or more after scaling.  Repeated rows count as often as they stand
there.  A component without variance (eigenvalue up to dimensions x 2^-52 of the largest) has ``whitened`` null; ``deviation`` is null where it
does not fit 64 bits.  Without usable rows the result is empty.
"""

from __future__ import annotations

from dataclasses import dataclass
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import slices
from tidepool.session import ship_package

EPS = 2.0 ** -52


@dataclass(frozen=True)
class Scale:
    """Whole numbers of the entries: floor(factor * c) + shift."""

    factor: float = 64.0
    shift: int = 1_000_000


# ---- eigenvectors of a symmetric matrix -----------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray | None:
    """The orthogonal polar factor of a symmetric matrix; None if it is singular to working precision."""
    d = len(a)
    size = np.linalg.norm(a)
    if size == 0:
        return None
    x = a / size
    try:
        low = 1 / np.linalg.norm(np.linalg.inv(x))  # at most the smallest singular value
    except np.linalg.LinAlgError:
        return None
    if not low > 8 * d * EPS:
        return None
    eye = np.eye(d)
    for _ in range(60):
        gap = np.cbrt(4 * (1 - low ** 2) / low ** 4)
        root = np.sqrt(1 + gap)
        weight = root + 0.5 * np.sqrt(8 - 4 * gap + 8 * (2 - low ** 2) / (low ** 2 * root))
        b = (weight - 1) ** 2 / 4
        c = weight + b - 1
        q, _ = np.linalg.qr(np.vstack([np.sqrt(c) * x, eye]))
        new = b / c * x + (weight - b / c) / np.sqrt(c) * (q[:d] @ q[d:].T)
        new = (new + new.T) / 2
        low = min(1.0, low * (weight + b * low ** 2) / (1 + c * low ** 2))
        moved = np.linalg.norm(new - x)
        x = new
        if moved <= np.cbrt(4 * EPS) * 1e-3 or (moved <= 1e-7 and abs(1 - low) <= 4 * EPS):
            return x
    return None


def range_of(projector: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal basis of a projector's range and of its complement, side by side."""
    order = np.argsort(-np.linalg.norm(projector, axis=0), kind="stable")
    draws = np.random.default_rng(len(projector)).standard_normal((len(projector), rank))
    start = projector @ draws + projector[:, order[:rank]]
    for _ in range(2):  # one more product brings what rounding left outside back to nothing
        start = projector @ np.linalg.qr(start)[0]
    return np.linalg.qr(start, mode="complete")[0]


def split(v: np.ndarray) -> tuple[np.ndarray, int] | None:
    """An orthogonal basis whose first vectors span the upper invariant subspace, and their number; None if all eigenvalues are equal."""
    d = len(v)
    diagonal = np.sort(np.diag(v))
    centre, width = np.trace(v) / d, np.linalg.norm(v - np.trace(v) / d * np.eye(d))
    if width <= 4 * d * EPS * np.linalg.norm(v):
        return None
    step = width / d
    shifts = [float(np.median(diagonal)), centre]
    shifts += [centre + s * step * k / 7 for k in range(1, 8) for s in (1, -1)]
    for shift in shifts:
        u = polar(v - shift * np.eye(d))
        if u is None:
            continue
        rank = int(round((np.trace(u) + d) / 2))
        if not 0 < rank < d:
            continue
        basis = range_of((u + np.eye(d)) / 2, rank)
        if np.linalg.norm(basis[:, :rank].T @ v @ basis[:, rank:]) <= 64 * d * EPS * np.linalg.norm(v):
            return basis, rank
    return None


def turn(v: np.ndarray) -> np.ndarray:
    """Eigenvectors of a matrix of two rows by one rotation."""
    angle = 0.5 * np.arctan2(2 * v[0, 1], v[0, 0] - v[1, 1])
    return np.array([[np.cos(angle), -np.sin(angle)], [np.sin(angle), np.cos(angle)]])


def sweep(v: np.ndarray) -> np.ndarray:
    """Plane rotations for the few rows of a cluster of eigenvalues that no shift tells apart."""
    d = len(v)
    basis, v = np.eye(d), v.copy()
    for _ in range(60):
        off = np.linalg.norm(v - np.diag(np.diag(v)))
        if off <= EPS * np.linalg.norm(v):
            break
        for i in range(d):
            for j in range(i + 1, d):
                r = turn(v[np.ix_([i, j], [i, j])])
                v[[i, j], :] = r.T @ v[[i, j], :]
                v[:, [i, j]] = v[:, [i, j]] @ r
                basis[:, [i, j]] = basis[:, [i, j]] @ r
    return basis


def components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit eigenvectors as columns."""
    v = (v + v.T) / 2
    found: list[np.ndarray] = []

    def divide(basis: np.ndarray, need: int) -> None:
        part = basis.T @ v @ basis
        part = (part + part.T) / 2
        if basis.shape[1] == 1:
            found.append(basis)
        elif basis.shape[1] == 2:
            found.append(basis @ turn(part))
        elif (cut := split(part)) is None:
            found.append(basis @ sweep(part))
        else:
            inner, rank = cut
            divide(basis @ inner[:, :rank], min(need, rank))
            if need > rank:
                divide(basis @ inner[:, rank:], need - rank)

    divide(np.eye(len(v)), min(wanted, len(v)))
    e = np.hstack(found)
    e /= np.linalg.norm(e, axis=0)
    values = np.einsum("ij,ij->j", e, v @ e)
    order = np.argsort(-values, kind="stable")[:wanted]
    e = e[:, order]
    e = e * np.where(e[np.abs(e).argmax(axis=0), np.arange(e.shape[1])] < 0, -1.0, 1.0)  # one sign for every run
    return values[order], e


# ---- passes over the rows ------------------------------------------------------------------------


def whole_numbers(values: pa.Array, d: int | None, scale: Scale) -> tuple[np.ndarray, np.ndarray]:
    """(positions of the usable rows, their whole numbers); ``d`` is the length that counts."""
    lists = values.to_pylist()
    at = [i for i, v in enumerate(lists) if v and (d is None or len(v) == d) and None not in v]
    if not at:
        return np.zeros(0, np.int64), np.zeros((0, d or 0), np.int64)
    x = np.array([lists[i] for i in at], dtype=np.float64)
    with np.errstate(over="ignore", invalid="ignore"):
        x = np.floor(scale.factor * x)
        fits = (np.isfinite(x) & (np.abs(x) < 2.0 ** 53)).all(axis=1)
    return np.array(at)[fits], x[fits].astype(np.int64) + scale.shift


def _lengths(rows: DataFrame, vector: str) -> int | None:
    size = F.size(vector)
    best = (rows.filter(F.col(vector).isNotNull() & (size > 0)).groupBy(size.alias("d")).count()
            .orderBy(F.desc("count"), "d").limit(1).collect())
    return best[0]["d"] if best else None


def _sums(rows: DataFrame, d: int, scale: Scale) -> tuple[int, list[int]]:
    """Number of usable rows and the exact sum of each dimension."""

    def run(batches):
        n, total = 0, [0] * d
        for part in slices(batches, 4096):
            _, x = whole_numbers(part.column(0), d, scale)
            n += len(x)
            if len(x):
                big = int(np.abs(x).max()) * len(x) >= 1 << 62
                total = [a + int(b) for a, b in zip(total, (x.astype(object) if big else x).sum(axis=0))]
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array([-1, *range(d)], pa.int32()), pa.array([Decimal(n), *map(Decimal, total)], pa.decimal128(38, 0))], names=["i", "s"])

    told = dict(rows.mapInArrow(run, "i int, s decimal(38,0)").groupBy("i").agg(F.sum("s").alias("s")).collect())
    return int(told.get(-1, 0)), [int(told.get(i, 0)) for i in range(d)]


def _products(rows: DataFrame, d: int, scale: Scale, centre: list[int]) -> list[list[int]]:
    """Exact sums of the products of entries less ``centre``."""

    def run(batches):
        total, some = np.zeros((d, d), object), False
        for part in slices(batches, 4096):
            _, x = whole_numbers(part.column(0), d, scale)
            if len(x):
                some = True
                y = x - np.array(centre, np.int64)
                if int(np.abs(y).max()) ** 2 * len(y) < 1 << 53:
                    y = y.astype(np.float64)  # products and sums stay whole numbers
                    total += (y.T @ y).astype(np.int64)
                else:
                    y = y.astype(object)
                    total += y.T @ y
        if some:
            for i in range(d):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i] * (d - i), pa.int32()), pa.array(range(i, d), pa.int32()), pa.array([str(t) for t in total[i, i:]])],
                    names=["i", "j", "s"])

    out = [[0] * d for _ in range(d)]
    added = rows.mapInArrow(run, "i int, j int, s string").groupBy("i", "j").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    for i, j, s in added.collect():
        out[i][j] = out[j][i] = int(s)
    return out


@dataclass
class Whitening:
    """What the fit leaves: counts and sums, eigenvalues, vectors, shares."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    scale: Scale

    def centred(self, x: np.ndarray) -> np.ndarray:
        """Entries less the mean, through n*x - S so that nothing is lost to a large mean."""
        d = self.offsets(x)
        return d.astype(np.float64) / self.n

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n*x - S as exact whole numbers."""
        middle = np.array([s // self.n for s in self.sums], np.int64)
        rest = [s - self.n * int(m) for s, m in zip(self.sums, middle)]
        y = x - middle
        if len(y) and (int(np.abs(y).max()) + 1) * self.n >= 1 << 62:
            return y.astype(object) * self.n - np.array(rest, object)
        return y * self.n - np.array(rest, np.int64)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        """(rows, components); a component without variance is not a number."""
        floor = len(self.sums) * EPS * max(float(self.values[0]), 0.0)
        with np.errstate(invalid="ignore", divide="ignore"):
            return self.centred(x) @ self.vectors / np.where(self.values > floor, np.sqrt(np.maximum(self.values, 0)), np.nan)


def fit(rows: DataFrame, *, vector: str = "embedding", wanted: int = 32, scale: Scale = Scale()) -> Whitening | None:
    """Components of all usable rows; None if there are none."""
    ship_package(rows.sparkSession)
    only = rows.select(F.col(vector).cast("array<double>").alias("v"))
    d = _lengths(only, "v")
    n, sums = _sums(only, d, scale) if d else (0, [])
    if not n:
        return None
    centre = [s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    product = _products(only, d, scale, centre)
    v = np.array([[float(Fraction(n * product[i][j] - rest[i] * rest[j], n * n)) for j in range(d)] for i in range(d)])
    values, vectors = components(v, wanted)
    trace = float(np.trace(v))
    return Whitening(n, sums, values, vectors, values / trace if trace > 0 else np.zeros(len(values)), scale)


def identity_error(rows: DataFrame, model: Whitening, *, vector: str = "embedding") -> float:
    """Largest entry of the covariance of the whitened rows less the identity, over components that have variance."""
    d = len(model.sums)

    def run(batches):
        total, some = 0.0, False
        for part in slices(batches, 4096):
            _, x = whole_numbers(part.column(0), d, model.scale)
            if len(x):
                some = True
                w = model.whiten(x)
                total = total + np.vstack([w.sum(axis=0), w.T @ w])
        if some:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))],
                                             names=["i", "s"])

    k = len(model.values)
    told = (rows.select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(run, "i int, s array<double>")
            .groupBy("i").agg(*[F.sum(F.col("s")[j]).alias(f"s{j}") for j in range(k)]).collect())
    sums = np.zeros((k + 1, k))
    for r in told:
        sums[r["i"]] = r[1:]
    mean = sums[0] / model.n
    off = np.abs(sums[1:] / model.n - np.outer(mean, mean) - np.eye(k))
    return float(np.nanmax(off)) if np.isfinite(off).any() else 0.0


OUT = ("component int, n long, deviation long, whitened double, explained double, identity_error double")


def whiten(rows: DataFrame, *, key: str = "vec_id", vector: str = "embedding", wanted: int = 32, scale: Scale = Scale()) -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of every usable row and component.

    Components are numbered from 1 by falling eigenvalue; ``deviation`` is the sum over dimensions of (n*x - S)^2, ``explained`` the share of
    the whole variance.  A null key stays null.
    """
    name, kind = key, rows.schema[key].dataType.simpleString()
    schema = f"`{name}` {kind}, {OUT}"
    source = rows.select(rows[key].alias("k"), rows[vector].cast("array<double>").alias("v"))
    model = fit(source, vector="v", wanted=wanted, scale=scale)
    if model is None:
        return rows.sparkSession.createDataFrame([], schema)
    error = identity_error(source, model, vector="v")
    d, k = len(model.sums), len(model.values)
    carried = rows.sparkSession.sparkContext.broadcast(model)  # d x components numbers

    def run(batches):
        m = carried.value
        for part in slices(batches, 1024):
            at, x = whole_numbers(part.column(1), d, m.scale)
            if not len(x):
                continue
            off = m.offsets(x)
            if off.dtype != object and int(np.abs(off).max()) ** 2 * d >= 1 << 63:
                off = off.astype(object)
            square = (off * off).sum(axis=1)
            deviation = [int(s) if s < 1 << 63 else None for s in square]
            w = m.whiten(x).ravel()
            yield pa.RecordBatch.from_arrays([
                part.column(0).take(pa.array(np.repeat(at, k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                pa.array(np.full(len(at) * k, m.n, np.int64)), pa.array(deviation, pa.int64()).take(pa.array(np.repeat(np.arange(len(at)), k))),
                pa.array(w, pa.float64(), mask=np.isnan(w)), pa.array(np.tile(m.explained, len(at))),
                pa.array(np.full(len(at) * k, error))],
                names=[name, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return source.mapInArrow(run, schema)
