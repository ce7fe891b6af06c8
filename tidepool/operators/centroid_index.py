"""A two-level index over a model's centres: exact nearest lookups with far fewer distances than centres.

Centres are grouped around about sqrt(q) leaders, every centre with its nearest one.  A group is visited for a row only
if one of two triangle bounds allows a member as near as the best centre known so far:

* ``|x - leader| - radius of the group``;
* the distance to the plane halfway between the row's nearest leader and the group's.

Bounds are widened by more than their rounding error and distances are summed as in the flat lookup, so that ids and
ties (smallest index) are those of ``blocks.nearest_index``.  Where the bounds exclude little, as for random directions in many
dimensions, a batch falls back to the flat lookup; that changes the work, never the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tidepool.operators.blocks import Block, nearest_index, squared_distances
from tidepool.session import LIMITS, Limits

SLACK = 1e-9
ROWS = 8192  # rows looked up at a time

@dataclass
class CentroidIndex:
    """Groups of centres: members of group g are ``order[start[g]:start[g + 1]]``, in rising order."""

    leaders: np.ndarray  # (g, d)
    radius: np.ndarray  # (g,) largest distance of a member from its leader
    between: np.ndarray  # (g, g) distances between leaders
    order: np.ndarray
    start: np.ndarray

    def __len__(self) -> int:
        return len(self.order)


def build(centres: np.ndarray, rounds: int = 4) -> CentroidIndex | None:
    """Index of the rows of ``centres`` that hold only finite numbers (None if there are fewer than two)."""
    where = np.flatnonzero(np.isfinite(centres).all(axis=1))
    if centres.shape[1] == 0 or len(where) < 2:
        return None
    c = centres[where]
    groups = int(np.ceil(np.sqrt(len(c))))
    # Leaders start at evenly spaced ranks along the widest dimension and move to the means of their members.
    wide = np.argmax(np.ptp(c, axis=0))
    leaders = c[np.argsort(c[:, wide], kind="stable")[np.linspace(0, len(c) - 1, groups).astype(int)]]
    for _ in range(rounds):
        home, _ = _home(c, leaders)
        size = np.bincount(home, minlength=len(leaders))
        sums = np.stack([np.bincount(home, weights=c[:, j], minlength=len(leaders)) for j in range(c.shape[1])], axis=1)
        leaders = sums[size > 0] / size[size > 0, None]
    home, far = _home(c, leaders)
    radius = np.zeros(len(leaders))
    np.maximum.at(radius, home, far)
    by_group = np.argsort(home, kind="stable")
    start = np.searchsorted(home[by_group], np.arange(len(leaders) + 1))
    return CentroidIndex(leaders, radius, np.sqrt(squared_distances(leaders, leaders)), where[by_group], start)


def _home(c: np.ndarray, leaders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    home, far = np.empty(len(c), np.int64), np.empty(len(c))
    step = max(1, (1 << 20) // len(leaders))
    for lo in range(0, len(c), step):
        d2 = squared_distances(c[lo:lo + step], leaders)
        home[lo:lo + step] = d2.argmin(axis=1)
        far[lo:lo + step] = np.sqrt(d2.min(axis=1))
    return home, far


def search(x: np.ndarray, centres: np.ndarray, index: CentroidIndex,
           most: float = 0.34) -> tuple[np.ndarray, np.ndarray, int] | None:
    """(index, squared distance, distances computed) of the nearest centre of every row.

    None if some row has no finite distance, or if the bounds leave more than the share ``most`` of all pairs: the flat
    lookup is the better one then.
    """
    n, groups = len(x), len(index.leaders)
    to_leader = np.sqrt(squared_distances(x, index.leaders))
    if n == 0 or not np.isfinite(to_leader).all():
        return None
    size = np.diff(index.start)
    counted = n * groups
    best, near = np.full(n, np.inf), np.full(n, len(centres), np.int64)
    home = to_leader.argmin(axis=1)
    if counted + int(size[home].sum()) > most * n * len(index):
        return None

    def visit(group: int, rows: np.ndarray) -> None:
        members = index.order[index.start[group]:index.start[group + 1]]
        step = max(1, (1 << 20) // len(members))
        for lo in range(0, len(rows), step):
            part = rows[lo:lo + step]
            d2 = squared_distances(x[part], centres[members])
            first = d2.argmin(axis=1)
            found, label = d2[np.arange(len(part)), first], members[first]
            better = (found < best[part]) | ((found == best[part]) & (label < near[part]))
            best[part[better]], near[part[better]] = found[better], label[better]

    by_home = np.argsort(home, kind="stable")
    edges = np.searchsorted(home[by_home], np.arange(groups + 1))
    for g in range(groups):
        rows = by_home[edges[g]:edges[g + 1]]
        if len(rows):
            visit(g, rows)
            counted += len(rows) * int(size[g])

    low = to_leader - index.radius[None, :]
    low -= SLACK * (to_leader + index.radius[None, :])
    own = to_leader[np.arange(n), home][:, None]
    gap = index.between[home]
    with np.errstate(divide="ignore", invalid="ignore"):
        plane = (to_leader * to_leader - own * own) / (2.0 * gap)
        plane -= SLACK * (to_leader * to_leader + own * own + index.radius * index.radius) / (2.0 * gap)
    np.fmax(low, plane, out=low)  # equal leaders give no plane
    low[np.arange(n), home] = np.inf
    open_pairs = (low <= np.sqrt(best)[:, None]) @ size
    if counted + int(open_pairs.sum()) > most * n * len(index):
        return None
    for g in range(groups):
        rows = np.flatnonzero(low[:, g] <= np.sqrt(best))
        if len(rows):
            visit(g, rows)
            counted += len(rows) * int(size[g])
    return near, best, counted


def indexed(block: Block, limits: Limits = LIMITS) -> Block:
    """The block with an index over its column ``centre``, if it holds at least ``limits.index_rows`` rows."""
    if len(block) < limits.index_rows:
        return block
    return Block(block.columns, build(block["centre"]))


def nearest(x: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Index of and squared distance to the nearest of the block's centres, through its index where that pays."""
    centres = block["centre"]
    if block.index is None or x.shape[1] != centres.shape[1]:
        return nearest_index(x, centres)
    idx, best = np.zeros(len(x), np.int64), np.full(len(x), np.inf)
    whole = np.isfinite(x).all(axis=1)  # the others have no nearest centre
    rows = np.flatnonzero(whole)
    for lo in range(0, len(rows), ROWS):
        part = rows[lo:lo + ROWS]
        hit = search(x[part], centres, block.index)
        idx[part], best[part] = nearest_index(x[part], centres) if hit is None else hit[:2]
    return idx, best
