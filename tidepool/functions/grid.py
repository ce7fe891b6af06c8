"""Density-grid expressions: cell coordinates, thresholds, classes, sporadic test."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Density classes of a cell.
UNSET, SPARSE, TRANSITIONAL, DENSE = -1, 0, 1, 2


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def cell_of(x, gaps: list[float]) -> Column:
    """Coordinates truncated toward zero."""
    x = _c(x)
    return F.array(*[(x[i] / F.lit(float(g))).cast("int") for i, g in enumerate(gaps)])


def cell_centre(cell, gaps: list[float]) -> Column:
    cell = _c(cell)
    return F.array(*[cell[i] * F.lit(float(g)) + F.lit(g / 2.0) for i, g in enumerate(gaps)])


def in_cell(x, cell, gaps: list[float]) -> Column:
    """1.0 if the point falls into the cell, else 0.0."""
    return (cell_of(x, gaps) == _c(cell)).cast("double")


def faded(density, dt, lam: float) -> Column:
    return _c(density) * F.pow(F.lit(float(lam)), _c(dt))


def dense_floor(n_cells: Column, lam: float, cm: float) -> Column:
    return F.lit(cm) / (n_cells * F.lit(1.0 - lam))


def sparse_ceiling(n_cells: Column, lam: float, cl: float) -> Column:
    return F.lit(cl) / (n_cells * F.lit(1.0 - lam))


def density_class(density, dm: Column, dl: Column) -> Column:
    density = _c(density)
    return F.when(density >= dm, F.lit(DENSE)).when(density <= dl, F.lit(SPARSE)).otherwise(F.lit(TRANSITIONAL))


def sporadic(density, t_update, t_removed, now: Column, n_cells: Column,
             lam: float, cl: float, beta: float) -> Column:
    """Thin for its age, and not back too soon after an earlier removal."""
    age = now - _c(t_update) + F.lit(1)
    floor = F.lit(cl) * (F.lit(1.0) - F.pow(F.lit(float(lam)), age)) / (n_cells * F.lit(1.0 - lam))
    removed = _c(t_removed)
    settled = (F.coalesce(removed, F.lit(0)) == 0) | (now >= F.lit(1.0 + beta) * removed)
    return (_c(density) < floor) & settled
