"""StreamKM++: a bucket table of coresets fed batch by batch, k-means on the extracted coreset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidepool.operators import coreset as cs
from tidepool.operators import kmeans
from tidepool.schema import CORESET
from tidepool.session import LIMITS, Limits, cut_lineage


@dataclass(frozen=True)
class StreamKMParams:
    """size: rows per coreset; window: stream length the bucket levels are laid out for."""

    k: int = 10
    size: int = 1_000
    window: int = 1_100_000
    iterations: int = 100
    seed: int = 0


def empty_buckets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CORESET)


@dataclass
class BucketState:
    """The bucket table between batches."""

    model: DataFrame
    batches: int = 0


def step(state: BucketState, batch: DataFrame, params: StreamKMParams, *, x: str = "x",
         weight: str | None = None, keep=cut_lineage, limits: Limits = LIMITS) -> BucketState:
    """Reduce the batch to a coreset, carry it into the buckets."""
    seed = params.seed * 1_000_003 + state.batches
    small = cs.coreset(batch, params.size, x=x, weight=weight, window=params.window, seed=seed, limits=limits)
    if small.isEmpty():
        return BucketState(state.model, state.batches + 1)
    return BucketState(keep(cs.carry_in(state.model, small, params.size, window=params.window, seed=seed)), state.batches + 1)


def final_clusters(state: DataFrame, params: StreamKMParams, *, limits: Limits = LIMITS) -> DataFrame:
    """(cluster_id, centre, weight)."""
    small = cs.extract(state, params.size, seed=params.seed)
    start = kmeans.seed_centres(small, params.k, ["x", "weight"], seed=params.seed)
    return kmeans.weighted_clusters(small, start, params.iterations, until_stable=True, limits=limits)
