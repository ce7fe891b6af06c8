"""Driving an online algorithm from a stream: foreachBatch over a versioned model store."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidepool.operators import snapshots
from tidepool.sources.store import ModelStore
from tidepool.streaming.metrics import PhaseTimer


def _scalars(state) -> dict:
    return {f.name: getattr(state, f.name) for f in dataclasses.fields(state) if f.name != "model"}


def restore(store: ModelStore, kind: type, version: int | None = None):
    """The saved state of a run, or None."""
    version = store.latest() if version is None else version
    if version is None or not store.has(version):
        return None
    meta = {k: v for k, v in store.meta(version).items() if not k.startswith("late_")}
    return kind(store.read(version), **meta)


def late_counts(store: ModelStore, version: int | None = None) -> dict:
    """``late_clock``, the latest time up to a version, and ``late_rows``, the rows dropped as too old so far."""
    version = store.latest() if version is None else version
    meta = store.meta(version) if version else {}
    return {"late_clock": meta.get("late_clock"), "late_rows": meta.get("late_rows", 0)}


def drop_late(batch: DataFrame, time: str, bound: float, seen: dict) -> tuple[DataFrame, dict]:
    """The batch without rows older than ``bound`` before the latest time of earlier batches, and the counts after it.

    Rows of one batch are not late to each other, and rows without a time pass.  One more scan of the time column tells the counts.
    """
    clock = seen["late_clock"]
    late = F.lit(False) if clock is None else F.coalesce(F.col(time) < clock - bound, F.lit(False))
    told = batch.agg(F.max(F.col(time).cast("double")).alias("clock"), F.count_if(late).alias("rows")).first()
    known = [c for c in (clock, told["clock"]) if c is not None]
    return batch.filter(~late), {"late_clock": max(known, default=None), "late_rows": seen["late_rows"] + told["rows"]}


def run_online(stream: DataFrame, initial, step: Callable, store: ModelStore, checkpoint: str, *,
               state_type: type | None = None, watch: Callable | None = None,
               pyramid: tuple[str, int, int] | None = None, prune_every: int = 16, late: tuple[str, float] | None = None,
               timer: PhaseTimer | None = None, trigger: dict | None = None, name: str | None = None) -> StreamingQuery:
    """Start ``step(state, batch, keep=...)`` on every micro-batch.

    initial     state before the first batch, or a function of the first batch
    state_type  class of the state, needed if ``initial`` is a function
    watch       called with (state, batch, batch_id) after each batch, e.g. to score it
    pyramid     (folder, alpha, l): also keep pyramidal snapshots by batch number; every ``prune_every`` batches the lineage ids
                that no kept snapshot tells apart are given up, so that models do not grow
    late        (time column, bound): drop rows that are older than the bound before the latest time of earlier batches;
                ``late_counts`` tells how many.  Without it every row counts, however late

    The store belongs to the checkpoint: another checkpoint on it, or a missing version, is an error.
    """
    timer = timer or PhaseTimer()
    if state_type is None:
        if callable(initial):
            raise ValueError("name the state_type when the initial state comes from the first batch")
        state_type = type(initial)
    store.bind(checkpoint)

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        version = batch_id + 1
        latest = store.latest()
        if latest == version:  # the batch was committed before its offset was
            return
        if latest != (batch_id or None):
            raise RuntimeError(f"batch {batch_id} needs version {batch_id} of {store.path}, whose last is {latest}: "
                               "the store and the checkpoint do not belong together")
        counts = {}
        if late:
            batch, counts = drop_late(batch, *late, late_counts(store, batch_id))
        with timer.phase("load"):
            state = restore(store, state_type, batch_id) if batch_id else initial(batch) if callable(initial) else initial
        if pyramid and batch_id and batch_id % prune_every == 0 and "ids" in state.model.columns:
            state.model = snapshots.prune_against_saved(state.model, pyramid[0], version)
        with timer.phase("update"):
            state = step(state, batch, keep=lambda df: store.write(df, version))
            if not _wrote(store, version):
                state.model = store.write(state.model, version)
            if pyramid:  # before the commit, so that a replay after a crash writes it again
                folder, alpha, l = pyramid  # noqa: E741
                snapshots.save(state.model, folder, version, alpha, l)
            store.commit(version, {**_scalars(state), **counts})
        if watch:
            with timer.phase("watch"):
                watch(state, batch, batch_id)

    writer = stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def _wrote(store: ModelStore, version: int) -> bool:
    fs, path = store._at(f"version={version}", "_SUCCESS")
    return fs.exists(path)
