"""Ready jobs: stream in, versioned model out, final clusters and scores on request."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.operators import cmm, evaluate
from tidepool.operators.rows import sample_to_fill, tokens
from tidepool.plans import clustream, clustree, denstream, dstream, streaming_kmeans, streamkm
from tidepool.schema import DECAYING_CLUSTER
from tidepool.session import LIMITS, Limits, cut_lineage, width_of
from tidepool.sources.store import KeyedTable, ModelStore, save_model
from tidepool.streaming.runner import run_online


def _step(fn, params):
    def run(state, batch, keep):
        return fn(state, batch, params, keep=keep)
    return run


def run_clustream(stream: DataFrame, params: clustream.CluStreamParams, initial, store: ModelStore, checkpoint: str, **kw):
    """``initial`` is a model table, a saved model read back, or a function of the first batch."""
    start = initial if callable(initial) else clustream.Clustering(initial)
    return run_online(stream, start, _step(clustream.step, params), store, checkpoint,
                      state_type=clustream.Clustering, **kw)


def run_clustream_records(stream: DataFrame, params: clustream.CluStreamParams, initial, store: ModelStore, checkpoint: str, **kw):
    """Like ``run_clustream``, each record against the model its predecessor left; parameters as of ``CluStreamParams.per_record``."""
    start = initial if callable(initial) else clustream.Clustering(initial)
    return run_online(stream, start, _step(clustream.record_step, params), store, checkpoint,
                      state_type=clustream.Clustering, **kw)


def clustream_from_buffer(params: clustream.CluStreamParams, need: int, *, seed: int = 0):
    """Initial state from the stream itself: k-means seeds on a sample of the first batch."""
    def start(batch: DataFrame):
        buffer = sample_to_fill(batch, need, seed=seed)
        return clustream.Clustering(clustream.init_kmeans(buffer, params.q, seed=seed))
    return start


def run_denstream(stream: DataFrame, params: denstream.DenStreamParams, initial: DataFrame, store: ModelStore,
                  checkpoint: str, **kw):
    return run_online(stream, denstream.DecayingState(initial), _step(denstream.step, params), store, checkpoint, **kw)


def run_dstream(stream: DataFrame, params: dstream.DStreamParams, store: ModelStore, checkpoint: str, **kw):
    start = dstream.GridState(dstream.empty_grid(stream.sparkSession))
    return run_online(stream, start, _step(dstream.step, params), store, checkpoint, **kw)


def run_clustree(stream: DataFrame, eps: float, lam: float, store: ModelStore, checkpoint: str, **kw):
    start = denstream.DecayingState(stream.sparkSession.createDataFrame([], DECAYING_CLUSTER))

    def step(state, batch, keep):
        return clustree.step(state, batch, eps, lam, keep=keep)
    return run_online(stream, start, step, store, checkpoint, **kw)


def run_streamkm(stream: DataFrame, params: streamkm.StreamKMParams, store: ModelStore, checkpoint: str, **kw):
    start = streamkm.BucketState(streamkm.empty_buckets(stream.sparkSession))
    return run_online(stream, start, _step(streamkm.step, params), store, checkpoint, **kw)


def run_streaming_kmeans(stream: DataFrame, k: int, d: int, alpha: float, store: ModelStore, checkpoint: str, *,
                         weight: float = 0.0, seed: int = 0, initial: DataFrame | None = None, **kw):
    start = initial if initial is not None else streaming_kmeans.random_centres(
        stream.sparkSession, k, d, weight=weight, seed=seed)

    def step(state, batch, keep):
        return streaming_kmeans.step(state, batch, alpha, keep=keep)
    return run_online(stream, streaming_kmeans.CentreState(start), step, store, checkpoint, **kw)


def build_clustream_model(points: DataFrame, q: int, path: str, *, seed: int = 0) -> None:
    """k-means seeds from an initial sample, saved for later runs."""
    save_model(clustream.init_kmeans(points, q, seed=seed), path)


def build_denstream_model(points: DataFrame, path: str, *, eps: float | None = None, mu: float | None = None,
                          k: int | None = None, seed: int = 0) -> None:
    """Density clusters (eps, mu) or k-means centres (k) of an initial sample, saved for later runs."""
    model = denstream.init_kmeans(points, k, seed=seed) if k else denstream.init_dbscan(points, eps, mu)
    save_model(model, path)


def running_word_count(lines: DataFrame, table: KeyedTable, checkpoint: str, *, trigger: dict | None = None):
    """Keyed counts over the whole stream: each batch writes the new counts of the words it held to a table (``word``, ``n``)."""
    counts = tokens(lines).groupBy("word").agg(F.count("*").alias("n"))
    writer = counts.writeStream.outputMode("update").foreachBatch(table.upsert).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def batch_probe(stream: DataFrame, path: str, checkpoint: str):
    """Append (batch_id, n_rows) per micro-batch to a parquet table."""
    def on_batch(batch, batch_id):
        batch.agg(F.count("*").alias("n_rows")).withColumn("batch_id", F.lit(batch_id)).coalesce(1).write.mode(
            "append").parquet(path)
    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def score_sse(points: DataFrame, clusters: DataFrame) -> DataFrame:
    """SSE of rows against final clusters (cluster_id, centre)."""
    return evaluate.sse_given(points, clusters.select(F.col("cluster_id").alias("mc_id"), "centre"))



def score_run(rows: DataFrame, order: list, clusters: dict[str, DataFrame], *, weight: str = "n", n: int = 10_000,
              params: cmm.CMMParams = cmm.CMMParams(), limits: Limits = LIMITS) -> DataFrame:
    """Scores at the end of a job: one row per level with SSE and mapping measure on the last n labelled rows.

    rows      labelled points of the stream (id, x, class); the last n by ``order`` are the window
    clusters  level to cluster features, e.g. ``{"macro": final, "micro": state.model}``; their ids are ``cluster_id`` or
              ``mc_id``, clusters of no weight do not count
    weight    name of the clusters' count, "w" for decaying ones
    """
    window = cmm.evaluation_window(rows.select("id", "x", "class", *[c for c in order if c not in ("id", "x", "class")]), order, n)
    window = cut_lineage(window.select("id", "x", "class"))
    levels = {level: cmm.spheres_of(model.filter(F.col(weight) > 0), n=weight,
                                    cluster_id="cluster_id" if "cluster_id" in model.columns else "mc_id")
              for level, model in clusters.items()}
    return cmm.score_levels(window, levels, d=width_of(window), params=params, limits=limits)
