"""Anytime leaf clustering: one table of decaying entries, nearest entry by trial insertion.

The leaf level of a clustering tree is a table of entries; the descent through inner nodes is
the block-wise nearest lookup of ``operators.fold``.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators import dbscan
from tidepool.plans.denstream import DecayingState, DenStreamParams
from tidepool.plans.denstream import step as decaying_step
from tidepool.session import LIMITS, Limits, cut_lineage


def leaf_params(eps: float, lam: float, t_factor: float = 1.0, order: str = "merge") -> DenStreamParams:
    """Entries never lose their place: no promotion threshold, no pruning."""
    return DenStreamParams(eps=eps, lam=lam, mu=0.0, beta=0.0, tp=1, t_factor=t_factor, prune="never",
                           reuse_old_outliers=False, order=order)


def step(state: DecayingState, batch: DataFrame, eps: float, lam: float, *, x: str = "x", t: str = "t", keep=cut_lineage,
         limits: Limits = LIMITS) -> DecayingState:
    """Insert a batch; every entry decays to the batch's latest time, misses become new entries."""
    new = decaying_step(state, batch, leaf_params(eps, lam), x=x, t=t, keep=keep, limits=limits)
    return replace(new, last_prune=0)


def leaves(model: DataFrame) -> DataFrame:
    return model.select("mc_id", "w", "ls", "ss")


def final_clusters(model: DataFrame, eps: float, mu: float, *, d: int | None = None, limits: Limits = LIMITS) -> DataFrame:
    return dbscan.offline_clusters(leaves(model), eps, mu, d=d, limits=limits)


def alive(model: DataFrame, least: float) -> DataFrame:
    """Entries that still carry weight."""
    return model.filter(F.col("w") >= least)
