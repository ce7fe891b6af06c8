"""Bounded numbers of cluster features from any number of them: trees that merge by a growing threshold, level by level over the tasks.

A tree holds at most ``cap`` features.  A new one goes down along the nearest centres to a leaf and joins the nearest feature there if
the radius of the two together stays within the threshold; else it stands for itself.  When there are too many, the threshold grows to
what the closest features of the leaves need, and the features are put in anew.  Time counts as one more axis, so that what is far apart
in time is merged as late as what is far apart in space.  Counts and sums are conserved.

Each level deals the features by place to tasks of at most four caps on average and leaves one cap a task; the last level is a
single task of bounded input.  The same features give the same result in any layout.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidepool.operators.blocks import list_column, squared_distances, vector_matrix
from tidepool.session import ship_package

FAN, LEAF, BLOCK = 16, 64, 512
NAMES = ["n", "ls", "ss", "lst", "sst", "t"]
SCHEMA = T.StructType([T.StructField("n", T.DoubleType()), T.StructField("ls", T.ArrayType(T.DoubleType())), T.StructField("ss", T.ArrayType(T.DoubleType())),
                       *[T.StructField(c, T.DoubleType()) for c in ("lst", "sst", "t")]])


class Node:
    """A leaf of features or a node of nodes, with the sum that places it."""

    __slots__ = ("leaf", "items", "n", "sum")

    def __init__(self, leaf: bool, items: list):
        self.leaf, self.items, self.n, self.sum = leaf, items, 0.0, 0.0


class FeatureTree:
    def __init__(self, cap: int, d: int, pace: float = 0.0):
        """``pace``: units of space that one tick is worth."""
        self.cap, self.d, self.pace, self.limit = cap, d, pace, 0.0
        self._clear(4 * cap + BLOCK)

    def _clear(self, room: int):
        self.k = 0
        self.sums = np.zeros((room, 2 * self.d + 4))  # n, lst, sst, t, ls, ss
        self.centre, self.scatter = np.zeros((room, self.d + 1)), np.zeros(room)
        self.root = Node(True, [])

    # ---- rows of features ----

    def _places(self, f: np.ndarray) -> np.ndarray:
        return np.column_stack([f[:, 4:4 + self.d], f[:, 1] * self.pace]) / f[:, :1]

    def _scatters(self, f: np.ndarray) -> np.ndarray:
        inner = f[:, 4 + self.d:].sum(axis=1) - (f[:, 4:4 + self.d] ** 2).sum(axis=1) / f[:, 0]
        along = self.pace ** 2 * (f[:, 2] - f[:, 1] ** 2 / f[:, 0])
        return np.maximum(inner, 0) + np.maximum(along, 0)

    def feed(self, f: np.ndarray, scatter: np.ndarray | None = None) -> None:
        """Put features in, in their order."""
        scatter = self._scatters(f) if scatter is None else scatter
        for lo in range(0, len(f), BLOCK):
            self._insert(f[lo:lo + BLOCK], scatter[lo:lo + BLOCK])
            while self.k > 2 * self.cap:
                self._tighten()

    def finish(self) -> np.ndarray:
        while self.k > self.cap:
            self._tighten()
        return self.sums[:self.k]

    def _insert(self, f, scatter) -> None:
        if self.k + len(f) > len(self.sums):
            more = len(self.sums)
            self.sums, self.centre = (np.vstack([a, np.zeros((more, a.shape[1]))]) for a in (self.sums, self.centre))
            self.scatter = np.concatenate([self.scatter, np.zeros(more)])
        nodes = self._route(self.root, np.arange(len(f)), f, self._places(f), scatter)
        while len(nodes) > 1:
            nodes = self._packed(nodes)
        self.root = nodes[0]

    # ---- the tree ----

    def _route(self, node: Node, rows, f, at, scatter) -> list[Node]:
        node.n += f[rows, 0].sum()
        node.sum = node.sum + (f[rows, :1] * at[rows]).sum(axis=0)
        if node.leaf:
            self._settle(node, rows, f, at, scatter)
            return [node] if len(node.items) <= LEAF else self._halved(node)
        centres = np.array([c.sum / c.n for c in node.items])
        nearest = squared_distances(at[rows], centres).argmin(axis=1)
        children: list[Node] = []
        for i, child in enumerate(node.items):
            mine = rows[nearest == i]
            children += self._route(child, mine, f, at, scatter) if len(mine) else [child]
        node.items = children
        return [node] if len(children) <= FAN else self._halved(node)

    def _joined(self, entries, rows, at, scatter, f, d2):
        """Squared radius of each row together with its entry."""
        n, m = self.sums[entries, 0], f[rows, 0]
        return (self.scatter[entries] + scatter[rows] + n * m / (n + m) * d2) / (n + m)

    def _settle(self, node, rows, f, at, scatter) -> None:
        if node.items and len(rows):
            entries = np.array(node.items)
            d2 = squared_distances(at[rows], self.centre[entries])
            best = d2.argmin(axis=1)
            d2, entries = d2[np.arange(len(rows)), best], entries[best]
            fits = self._joined(entries, rows, at, scatter, f, d2) <= self.limit
            self._absorb(entries[fits], rows[fits], f, at, scatter)
            rows = rows[~fits]
        while len(rows):
            i, row, rows = self.k, rows[0], rows[1:]
            self.k += 1
            self.sums[i], self.centre[i], self.scatter[i] = f[row], at[row], scatter[row]
            node.items.append(i)
            if len(rows) and self.limit > 0:
                d2 = ((at[rows] - self.centre[i]) ** 2).sum(axis=1)
                entries = np.full(len(rows), i)
                fits = self._joined(entries, rows, at, scatter, f, d2) <= self.limit
                self._absorb(entries[fits], rows[fits], f, at, scatter)
                rows = rows[~fits]

    def _absorb(self, entries, rows, f, at, scatter) -> None:
        for e in np.unique(entries):
            mine = rows[entries == e]
            members = np.vstack([self.centre[e], at[mine]])
            weight = np.r_[self.sums[e, 0], f[mine, 0]]
            middle = weight @ members / weight.sum()
            self.scatter[e] += scatter[mine].sum() + weight @ ((members - middle) ** 2).sum(axis=1)
            latest = max(self.sums[e, 3], f[mine, 3].max())
            self.sums[e] += f[mine].sum(axis=0)
            self.sums[e, 3] = latest
            self.centre[e] = middle

    def _halved(self, node: Node) -> list[Node]:
        where = self.centre[node.items] if node.leaf else np.array([c.sum / c.n for c in node.items])
        a = int(((where - where.mean(axis=0)) ** 2).sum(axis=1).argmax())
        b = int(((where - where[a]) ** 2).sum(axis=1).argmax())
        first = ((where - where[a]) ** 2).sum(axis=1) <= ((where - where[b]) ** 2).sum(axis=1)
        if first.all() or not first.any():
            first = np.arange(len(where)) < len(where) // 2
        out, most = [], LEAF if node.leaf else FAN
        for side in (first, ~first):
            half = self._node(node.leaf, [x for x, s in zip(node.items, side) if s])
            out += [half] if len(half.items) <= most else self._halved(half)
        return out

    def _node(self, leaf: bool, items: list) -> Node:
        node = Node(leaf, items)
        if leaf:
            node.n = self.sums[items, 0].sum()
            node.sum = (self.sums[items, :1] * self.centre[items]).sum(axis=0)
        else:
            node.n, node.sum = sum(c.n for c in items), sum(c.sum for c in items)
        return node

    def _packed(self, nodes: list[Node]) -> list[Node]:
        """The nodes below as few new ones as their number asks for."""
        top = self._node(False, nodes)
        return [top] if len(nodes) <= FAN else self._halved(top)

    def _leaves(self, node: Node):
        if node.leaf:
            yield node.items
        else:
            for child in node.items:
                yield from self._leaves(child)

    def _tighten(self) -> None:
        """A larger threshold, and everything put in anew."""
        need = []
        order = list(self._leaves(self.root))
        for items in order:
            if len(items) > 1:
                at, n = self.centre[items], self.sums[items, 0]
                d2 = squared_distances(at, at)
                np.fill_diagonal(d2, np.inf)
                j = d2.argmin(axis=1)
                m, s = n[j], self.scatter[items]
                need.append((s + s[j] + n * m / (n + m) * d2[np.arange(len(items)), j]) / (n + m))
        need = np.concatenate(need) if need else np.zeros(1)
        share = min(0.9, max(0.1, 1 - self.cap / self.k))
        before, flat = self.k, np.concatenate([np.array(i, np.int64) for i in order])
        grown = max(float(np.quantile(need, share)), 1.05 * self.limit)
        if grown <= self.limit or not np.isfinite(grown):
            grown = max(self.limit * 2, float((self.centre[:self.k] ** 2).sum(axis=1).max()) * 1e-24, 1e-300)
        self.limit = grown
        f, scatter = self.sums[flat].copy(), self.scatter[flat].copy()
        self._clear(max(4 * self.cap, before) + BLOCK)
        for lo in range(0, len(f), BLOCK):
            self._insert(f[lo:lo + BLOCK], scatter[lo:lo + BLOCK])


def _grow(cap: int, pace: float):
    def run(batches):
        tree, odd = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            ls, ss = vector_matrix(batch.column("ls")), vector_matrix(batch.column("ss"))
            f = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("n", "lst", "sst", "t")] + [ls, ss])
            tree = tree or FeatureTree(cap, ls.shape[1], pace)
            whole = np.isfinite(f).all(axis=1)
            if not whole.all():  # without a place: one feature
                strange = f[~whole]
                odd = strange if odd is None else np.vstack([odd, strange])
                odd = np.r_[odd[:, :3].sum(axis=0), odd[:, 3].max(), odd[:, 4:].sum(axis=0)][None, :]
            tree.feed(f[whole])
        if tree is not None:
            f = tree.finish()
            f = f if odd is None else np.vstack([f, odd])
            d = tree.d
            yield pa.RecordBatch.from_arrays([pa.array(f[:, 0]), list_column(f[:, 4:4 + d]), list_column(f[:, 4 + d:]),
                                              *(pa.array(f[:, c]) for c in (1, 2, 3))], names=NAMES)

    return run


def bounded(features: DataFrame, most: int, *, rows: int | None = None, width: float = 0.0, pace: float = 0.0) -> DataFrame:
    """(n, ls, ss, lst, sst, t): at most ``most`` features (one more if some have no finite place), unchanged if there are no more.

    ``rows`` is an upper bound of their number (counted if not given), ``width`` a distance below which features are neighbours: it only
    decides which meet early.  ``pace`` is the distance that one tick is worth.
    """
    ship_package(features.sparkSession)
    rows = features.count() if rows is None else rows
    out = features.select(*NAMES)
    while rows > most:
        parts = math.ceil(rows / (4 * most))
        if parts == 1:
            place = F.lit(0)
        elif width > 0:
            cell = F.transform("ls", lambda v: F.floor(F.nanvl(v / F.col("n"), F.lit(0.0)) / F.lit(16 * width)))
            place = F.xxhash64(cell, F.pmod(F.xxhash64("ls", "t"), F.lit(8)))
        else:
            place = F.xxhash64("ls")
        out = out.repartition(parts, place).sortWithinPartitions("t", "ls", "n").mapInArrow(_grow(most, pace), SCHEMA)
        if parts == 1:
            break
        rows, width = parts * most, 4 * width
    return out
