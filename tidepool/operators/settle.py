"""The order-dependent part of the online step: where the rows go that no cluster took.

Rows arrive as cluster features (a single point has count 1).  One rule holds for every size: rows
that lie close in space and time, by the scale of the model, are added up first, by cells that do not depend on the layout; if more
than a stated number of sums is left, trees of features merge the closest of them, level by level; and the sums are settled in time order.
Counts and sums are conserved.  ``exact=True`` leaves the first steps out: every row is settled by itself, in one task, which is the
caller's choice and only meant for bounded input.
"""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.assign import absorb_radii
from tidepool.operators.blocks import list_column, nearest_index, squared_distances, vector_matrix
from tidepool.operators.cf import cf_merge, vector_sum
from tidepool.operators.feature_tree import bounded
from tidepool.schema import DECAYING_CLUSTER, MICRO_CLUSTER, VECTOR
from tidepool.session import MAX_FLOAT, cut_lineage, ship_package, width_of

LEFT_OVER = T.StructType([T.StructField("n", T.DoubleType()), T.StructField("ls", VECTOR), T.StructField("ss", VECTOR),
                          T.StructField("lst", T.DoubleType()), T.StructField("sst", T.DoubleType()),
                          T.StructField("t", T.DoubleType())])

QUANTILE = NormalDist().inv_cdf


def _matrix(series) -> np.ndarray:
    return np.array(series.tolist(), dtype=float) if len(series) else np.zeros((0, 0))


def spread(n, ls, ss, factor):
    """factor * sqrt(total variance) of features with count above 1 (numpy)."""
    n = np.asarray(n)[..., None]
    var = ss / n - (ls / n) ** 2
    return factor * np.sqrt(np.maximum(var, 1e-50).sum(axis=-1))


# ---- fixed number of slots: absorb, replace the stale, merge the closest ------------------------


class Slots:
    """A model of fixed size while left-over rows are settled."""

    def __init__(self, pdf: pd.DataFrame, m: float, horizon: float, factor: float, now: float):
        self.mc_id = pdf["mc_id"].to_numpy()
        self.n = pdf["n"].to_numpy(float).copy()
        self.ls, self.ss = _matrix(pdf["ls"]), _matrix(pdf["ss"])
        self.lst, self.sst = pdf["lst"].to_numpy(float).copy(), pdf["sst"].to_numpy(float).copy()
        self.ids = [list(v) if v is not None else [] for v in pdf["ids"]]
        self.next_id = max((max(v) for v in self.ids if v), default=-1) + 1
        self.m, self.horizon, self.factor, self.now = m, horizon, factor, now
        self.centre = self.ls / np.maximum(self.n, 1e-300)[:, None]
        self.stamp = np.array([self._stamp(i) for i in range(len(self.n))])
        self.fresh: list[int] = []
        self.gaps = None

    def _stamp(self, i):
        n = self.n[i]
        if n == 0:
            return -math.inf
        mean = self.lst[i] / n
        if n < 2 * self.m:
            return mean
        sd = math.sqrt(max(self.sst[i] / n - mean * mean, 0.0))
        return mean + sd * QUANTILE(1 - self.m / (2 * n))

    def _refresh(self, i):
        self.centre[i] = self.ls[i] / max(self.n[i], 1e-300)
        self.stamp[i] = self._stamp(i)
        if self.gaps is not None:
            row = np.sqrt(squared_distances(self.centre[i:i + 1], self.centre)[0])
            row[(self.n == 0)] = np.inf
            row[i] = np.inf
            self.gaps[i, :] = self.gaps[:, i] = row

    def _radius(self, i):
        if self.n[i] > 1:
            return float(spread(self.n[i], self.ls[i], self.ss[i], self.factor))
        d2 = squared_distances(self.centre[i:i + 1], self.centre)[0]
        d2[i] = np.inf
        d2[self.n == 0] = np.inf
        return math.sqrt(d2.min())

    def _add(self, i, n, ls, ss, lst, sst):
        self.n[i] += n
        self.ls[i] += ls
        self.ss[i] += ss
        self.lst[i] += lst
        self.sst[i] += sst
        self._refresh(i)

    def _put(self, i, n, ls, ss, lst, sst):
        self.n[i], self.ls[i], self.ss[i], self.lst[i], self.sst[i] = n, ls, ss, lst, sst
        self.ids[i] = [self.next_id]
        self.next_id += 1
        self._refresh(i)

    def _mark(self, i):
        if i not in self.fresh:
            self.fresh.append(i)

    def _stale(self):
        old = (self.stamp < self.now - self.horizon) | (self.n == 0)
        old[self.fresh] = False
        where = np.flatnonzero(old)
        return int(where[np.lexsort((self.mc_id[where], self.stamp[where]))[0]]) if len(where) else None

    def _closest(self):
        if self.gaps is None:
            self.gaps = np.sqrt(squared_distances(self.centre, self.centre))
            self.gaps[np.diag_indices(len(self.n))] = np.inf
            self.gaps[self.n == 0, :] = np.inf
            self.gaps[:, self.n == 0] = np.inf
        a, b = divmod(int(np.argmin(self.gaps)), len(self.n))
        return min(a, b), max(a, b)

    def settle(self, row, recheck: bool, keep_merged_open: bool):
        c = row[1] / row[0]
        if recheck and self.fresh:
            d2 = squared_distances(c[None, :], self.centre[self.fresh])[0]
            j = int(np.argmin(d2))
            i = self.fresh[j]
            if math.sqrt(d2[j]) <= self._radius(i):
                self._add(i, *row[:5])
                return
        slot = self._stale()
        if slot is None:
            a, slot = self._closest()
            if a == slot or not np.isfinite(self.gaps[a, slot]):
                self._add(int(np.argmin(squared_distances(c[None, :], self.centre)[0])), *row[:5])
                return
            ids = self.ids[a] + self.ids[slot]
            self._add(a, self.n[slot], self.ls[slot].copy(), self.ss[slot].copy(), self.lst[slot], self.sst[slot])
            self.ids[a] = ids
            if keep_merged_open:
                self._mark(a)
        self._put(slot, *row[:5])
        self._mark(slot)

    def frame(self):
        return pd.DataFrame({"mc_id": self.mc_id, "n": self.n, "ls": list(self.ls), "ss": list(self.ss),
                             "lst": self.lst, "sst": self.sst, "ids": self.ids})


def settle_in_slots(model: DataFrame, left: DataFrame, *, now: float, m: float, horizon: float, factor: float,
                    recheck: bool = True, keep_merged_open: bool = True, newest_first: bool = False,
                    exact: bool = False, most: int = 4096, rows: int | None = None) -> DataFrame:
    """New model of the same size after settling left-over rows in time order.

    Each row is absorbed by a cluster this pass has touched, or overwrites the stalest
    deletable cluster, or takes the slot freed by merging the closest pair.  At most ``most`` sums (and one without a place) reach
    the task that settles them; ``rows`` is the number of left-over rows, counted if not given.
    """
    ship_package(model.sparkSession)
    if not exact:
        width, span = model_scale(model, factor), horizon / SPANS
        if width:
            left = cut_lineage(condense(left, width=width, span=span))
            # The trees are laid out for the sums, not for the rows behind them; they see the sums of many rows at least once.
            rows = max(left.count(), min(most + 1, most + 1 if rows is None else rows))
        pace = width / span if 0 < span < math.inf and width else 0.0
        left = bounded(left, most, rows=rows, width=width or 0.0, pace=pace)
    rows = left.select(F.lit(1).alias("_k"), "n", "ls", "ss", "lst", "sst", "t")
    base = model.select(F.lit(1).alias("_k"), "mc_id", "n", "ls", "ss", "lst", "sst", "ids")

    def run(key, model_pdf, left_pdf):
        model_pdf = model_pdf.sort_values("mc_id").reset_index(drop=True)
        slots = Slots(model_pdf, m, horizon, factor, now)
        if len(left_pdf):
            n = left_pdf["n"].to_numpy(float)
            ls, ss = _matrix(left_pdf["ls"]), _matrix(left_pdf["ss"])
            lst, sst = left_pdf["lst"].to_numpy(float), left_pdf["sst"].to_numpy(float)
            order = np.lexsort(tuple(ls[:, j] for j in reversed(range(ls.shape[1]))) + (left_pdf["t"].to_numpy(float),))
            for i in (order[::-1] if newest_first else order):
                slots.settle((n[i], ls[i], ss[i], lst[i], sst[i]), recheck, keep_merged_open)
        return slots.frame()

    return base.groupBy("_k").cogroup(rows.groupBy("_k")).applyInPandas(run, MICRO_CLUSTER)


class Pool:
    """Provisional features of one task: absorb within the radius, halve by merging when full."""

    def __init__(self, cap: int, factor: float):
        self.cap, self.factor, self.k = cap, factor, 0

    def _grow(self, need, d):
        if self.k == 0 and not hasattr(self, "n"):
            size = max(16, need)
            self.n, self.lst, self.sst, self.t = (np.zeros(size) for _ in range(4))
            self.ls, self.ss = np.zeros((size, d)), np.zeros((size, d))
        while self.k + need > len(self.n):
            self.n, self.lst, self.sst, self.t = (np.concatenate([a, np.zeros(len(a))]) for a in (self.n, self.lst, self.sst, self.t))
            self.ls, self.ss = (np.concatenate([a, np.zeros_like(a)]) for a in (self.ls, self.ss))

    def feed(self, n, ls, ss, lst, sst, t):
        centre = ls / n[:, None]
        rest = np.arange(len(n))
        if self.k:
            mine = self.ls[:self.k] / self.n[:self.k, None]
            idx, d2 = nearest_index(centre, mine)
            many = self.n[idx] > 1
            radius = np.where(many, spread(self.n[idx], self.ls[idx], self.ss[idx], self.factor), 0.0)
            ok = np.sqrt(d2) <= radius
            for a, v in ((self.n, n), (self.lst, lst), (self.sst, sst)):
                np.add.at(a, idx[ok], v[ok])
            np.add.at(self.ls, idx[ok], ls[ok])
            np.add.at(self.ss, idx[ok], ss[ok])
            np.maximum.at(self.t, idx[ok], t[ok])
            rest = rest[~ok]
        for lo in range(0, len(rest), self.cap):
            part = rest[lo:lo + self.cap]
            self._grow(len(part), ls.shape[1])
            s = slice(self.k, self.k + len(part))
            self.n[s], self.ls[s], self.ss[s], self.lst[s], self.sst[s], self.t[s] = n[part], ls[part], ss[part], lst[part], sst[part], t[part]
            self.k += len(part)
            while self.k > self.cap:
                self._halve()

    def _halve(self):
        """Merge disjoint closest pairs, nearest first, until the cap holds (at most half go at once)."""
        k = self.k
        centre = self.ls[:k] / self.n[:k, None]
        near, gap = np.zeros(k, np.int64), np.full(k, np.inf)
        step = max(1, (1 << 20) // k)
        for lo in range(0, k, step):
            d2 = squared_distances(centre[lo:lo + step], centre)
            d2[np.arange(d2.shape[0]), np.arange(lo, lo + d2.shape[0])] = np.inf
            near[lo:lo + step] = d2.argmin(axis=1)
            gap[lo:lo + step] = d2.min(axis=1)
        free, excess = np.ones(k, bool), k - self.cap
        for i in np.argsort(gap, kind="stable"):
            j = near[i]
            if excess == 0:
                break
            if not (free[i] and free[j]):
                continue
            a, b = min(i, j), max(i, j)
            for arr in (self.n, self.ls, self.ss, self.lst, self.sst):
                arr[a] += arr[b]
            self.t[a] = max(self.t[a], self.t[b])
            free[a] = free[b] = False
            self.n[b] = -1
            excess -= 1
        keep = np.flatnonzero(self.n[:k] >= 0)
        for name in ("n", "ls", "ss", "lst", "sst", "t"):
            arr = getattr(self, name)
            arr[:len(keep)] = arr[keep]
        self.k = len(keep)


AXES, BINS, SPANS = 3, 16, 8


def radius_scale(features: DataFrame, factor: float) -> float | None:
    """Median radius of the features with a spread, as a power of two (round-off in the sums moves no cell); None without any."""
    var = F.zip_with("ss", "ls", lambda s, v: F.greatest(s / F.col("n") - (v / F.col("n")) ** 2, F.lit(0.0)))
    radius = factor * F.sqrt(F.aggregate(var, F.lit(0.0), lambda a, b: a + b))
    found = features.filter("n > 1").select(radius.alias("r")).filter("r > 1e-20 and r < double('inf')").agg(F.median("r")).first()[0]
    return None if found is None else 2.0 ** math.floor(math.log2(found))


def model_scale(model: DataFrame, factor: float) -> float | None:
    """Median radius of the model; without any radius, half the median gap between its centres; None if no two of them differ."""
    found = radius_scale(model, factor)
    if found is None:
        lone = absorb_radii(model.filter("n > 0"), factor=factor).filter(f"radius > 1e-20 and radius < {MAX_FLOAT}")
        gap = lone.agg(F.median("radius")).first()[0]
        found = None if gap is None else 2.0 ** math.floor(math.log2(gap / 2))
    return found


def condense(left: DataFrame, *, d: int | None = None, width: float | None = None, span: float = math.inf) -> DataFrame:
    """Left-over features added up by cell.

    With ``width``, a radius, the cells have a quarter of it as their diagonal and last ``span`` (ticks stay apart if it is 0): rows
    further apart are never added up, and there are as many sums as occupied cells.  Not a number and infinity are places of their own.

    Without a radius to go by there are at most ``BINS ** AXES * SPANS`` rows, however many come in.

    The cells cut the range of the rows along ``AXES`` directions (the axes themselves, or fixed
    random ones where there are more) and their time span into equal parts.  Both follow from the rows
    alone, so the layout of the input does not matter, and sums are combined before the shuffle.
    """
    d = d or width_of(left, "ls")
    if d == 0:
        return left
    if width is not None:
        def place(v, size):
            q = v / F.lit(size)
            return F.when(F.abs(q) < 2.0 ** 52, F.floor(q).cast("double")).otherwise(q)

        size = 2.0 ** math.floor(math.log2(width / 4 / math.sqrt(d)))
        tick = place(F.col("t"), span) if 0 < span < math.inf else F.col("t") if span <= 0 else F.lit(0.0)
        cell = F.concat(F.transform("ls", lambda v: place(v / F.col("n"), size)), F.array(tick))
        merged = cf_merge(left.withColumn("mc_id", cell), d=d, extra=(F.max("t").alias("t"),))
        return merged.select(*[f.name for f in LEFT_OVER.fields])
    directions = np.eye(d) if d <= AXES else np.random.default_rng(17).standard_normal((AXES, d))
    centre = F.transform("ls", lambda v: v / F.col("n"))
    along = {f"_p{k}": F.aggregate(F.zip_with(centre, F.array(*[F.lit(float(v)) for v in line]), lambda a, b: a * b), F.lit(0.0),
                                   lambda a, b: a + b) for k, line in enumerate(directions)} | {"_t": F.col("t")}
    laid = left.withColumns(along)
    box = laid.agg(*[f(c).cast("double").alias(f"{n}{c}") for c in along for n, f in (("lo", F.min), ("hi", F.max))]).first()
    cell = F.lit(0).cast("long")
    for name in along:
        low, high, parts = box[f"lo{name}"], box[f"hi{name}"], SPANS if name == "_t" else BINS
        if low is None or not high > low:
            continue
        place = F.floor((F.col(name) - low) / (high - low) * parts)
        cell = cell * parts + F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.coalesce(place, F.lit(0))))
    merged = cf_merge(laid.withColumn("mc_id", cell), d=d, extra=(F.max("t").alias("t"),))
    return merged.select(*[f.name for f in LEFT_OVER.fields])


# ---- decaying clusters: absorb within eps or be born -----------------------------------------------


class Born:
    """Decaying o-clusters of one task, grown from left-over rows in time order."""

    def __init__(self, eps, lam, factor):
        self.eps, self.lam, self.factor, self.k = eps, lam, factor, 0

    def _room(self, d):
        if not hasattr(self, "w"):
            self.w, self.t0, self.tl = (np.zeros(64) for _ in range(3))
            self.ls, self.ss, self.centre = (np.zeros((64, d)) for _ in range(3))
        elif self.k == len(self.w):
            self.w, self.t0, self.tl = (np.concatenate([a, np.zeros(len(a))]) for a in (self.w, self.t0, self.tl))
            self.ls, self.ss, self.centre = (np.concatenate([a, np.zeros_like(a)]) for a in (self.ls, self.ss, self.centre))

    def settle(self, w, ls, ss, t0, t):
        """Insert into the nearest cluster if the radius stays within eps, else start one."""
        if self.k:
            gap = self.centre[:self.k] - ls / w
            i = int(np.argmin((gap * gap).sum(axis=1)))
            top = max(t, self.tl[i])
            f, g = 2.0 ** (-self.lam * (top - self.tl[i])), 2.0 ** (-self.lam * (top - t))
            w1, ls1, ss1 = self.w[i] * f + w * g, self.ls[i] * f + ls * g, self.ss[i] * f + ss * g
            var = ss1 / w1 - (ls1 / w1) ** 2
            if w1 > 1 and self.factor * math.sqrt(max(var.max(), 0.0)) <= self.eps:
                self.w[i], self.ls[i], self.ss[i], self.tl[i] = w1, ls1, ss1, top
                self.t0[i] = min(self.t0[i], t0)
                self.centre[i] = ls1 / w1
                return
        self._room(len(ls))
        i = self.k
        self.w[i], self.ls[i], self.ss[i], self.t0[i], self.tl[i] = w, ls, ss, t0, t
        self.centre[i] = ls / w
        self.k += 1

    def columns(self):
        k = self.k
        if not k:
            return []
        return [pa.array(self.w[:k]), list_column(self.ls[:k]), list_column(self.ss[:k]),
                pa.array(self.t0[:k].astype(np.int64)), pa.array(self.tl[:k].astype(np.int64))]


BORN = T.StructType([f for f in DECAYING_CLUSTER.fields if f.name not in ("mc_id", "kind")])


def _grow_clusters(rows: DataFrame, eps: float, lam: float, factor: float) -> DataFrame:
    """Born clusters of every cell; the rows of a cell stand together, in time order."""

    def run(batches):
        cell, born = None, Born(eps, lam, factor)
        names = [f.name for f in BORN.fields]
        for batch in batches:
            if batch.num_rows == 0:
                continue
            ls, ss = vector_matrix(batch.column("ls")), vector_matrix(batch.column("ss"))
            w, t0, t = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("w", "t0", "t_last"))
            cells = batch.column("cell").to_pylist()
            for i in range(batch.num_rows):
                if cells[i] != cell:
                    if born.k:
                        yield pa.RecordBatch.from_arrays(born.columns(), names=names)
                    cell, born = cells[i], Born(eps, lam, factor)
                born.settle(w[i], ls[i], ss[i], t0[i], t[i])
        if born.k:
            yield pa.RecordBatch.from_arrays(born.columns(), names=names)

    ship_package(rows.sparkSession)
    return rows.select("cell", *[f.name for f in BORN.fields]).mapInArrow(run, BORN)


def settle_born(left: DataFrame, *, eps: float, lam: float, factor: float = 1.0, exact: bool = False) -> DataFrame:
    """(w, ls, ss, t0, t_last) of the o-clusters born from left-over rows.

    Rows of one tick within a quarter of eps are added up, before the shuffle, so that a crowded place
    becomes few rows.  The sums are then grown to clusters in time order, cell by cell of twice eps, and
    what has grown once more in cells shifted by eps, which joins what a border kept apart.
    ``exact=True`` settles row by row in one task.
    """
    if exact:
        ordered = left.withColumn("cell", F.lit(0).cast("long")).repartition(1).sortWithinPartitions("t_last", "ls")
        return _grow_clusters(ordered, eps, lam, factor)
    d = width_of(left, "ls")
    place = F.transform("ls", lambda v: F.floor(v / F.col("w") / (eps / 4)))
    near = left.groupBy(place.alias("_place"), "t_last").agg(
        F.sum("w").alias("w"), vector_sum(F.col("ls"), d).alias("ls"), vector_sum(F.col("ss"), d).alias("ss"), F.min("t0").alias("t0"))
    for shift in (0.0, 0.5):
        place = F.transform("ls", lambda v: F.floor(v / F.col("w") / (2 * eps) + shift))
        near = near.withColumn("cell", F.xxhash64(place)).repartition("cell").sortWithinPartitions("cell", "t_last", "ls")
        near = _grow_clusters(near, eps, lam, factor)
    return near


def shrink(features: DataFrame, q: int, *, factor: float) -> DataFrame:
    """(mc_id, n, ls, ss, lst, sst): at most q features from a bounded number of them, in one task."""
    schema = T.StructType([f for f in MICRO_CLUSTER.fields if f.name != "ids"])

    def run(batches):
        pool = Pool(q, factor)
        for batch in batches:
            num = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in ("n", "lst", "sst", "t")}
            if batch.num_rows:
                pool.feed(num["n"], vector_matrix(batch.column("ls")), vector_matrix(batch.column("ss")), num["lst"], num["sst"], num["t"])
        if pool.k:
            k = pool.k
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(k)), pa.array(pool.n[:k]), list_column(pool.ls[:k]), list_column(pool.ss[:k]),
                 pa.array(pool.lst[:k]), pa.array(pool.sst[:k])], names=[f.name for f in schema.fields])

    ship_package(features.sparkSession)
    ordered = features.select(*[f.name for f in LEFT_OVER.fields]).repartition(1).sortWithinPartitions("t", "ls")
    return ordered.mapInArrow(run, schema)
