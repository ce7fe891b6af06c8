"""Exact top-k search by inner product with multi-resolution segment statistics.

A vector is cut into equal segments, of each of which the mean and the deviation are known.  For two vectors the products of the
means and of the deviations, weighted by the segments' lengths, bound the inner product from above (equally: they bound the
distance from below).  Few segments give a coarse bound, more segments a finer one.

Queries and candidates are dealt to blocks, and each pair of blocks is one task: it bounds all pairs coarsely, computes the most promising
ones exactly, which sets each query's bar (its k-th best so far), and lets only rows whose bound reaches a bar on to the finer
level and then to the exact product.  The k best of every pair of blocks meet in a last ranking.  No answer is lost.
How many rows the bounds leave out depends on the vectors: smooth ones many, random directions hardly any.

Null vectors and those with null or non-finite components take no part, vectors of different lengths do not meet.  Ties go to the
smaller key.  Repeated candidates are ranked as often as they occur; a query never meets rows of its own key.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import keep, slices
from tidepool.session import ship_package

LEVELS = (4, 16)  # segments, coarse to fine
FIRST = 64  # candidates of the highest coarse bounds that set the bar
QUERIES_AT_ONCE = 64


def statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, scaled so that a product of two rows bounds the vectors' inner product."""
    out = []
    for part in np.array_split(x, min(segments, x.shape[1]), axis=1):
        scale = np.sqrt(part.shape[1])
        out += [part.mean(axis=1) * scale, part.std(axis=1) * scale]
    return np.stack(out, axis=1)


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int):
    """(query position, row position, score) of each query's k best rows among these; whole numbers as doubles are exact.

    A few queries are answered at once.  A row goes on to the next level while it may still be among the best of one of
    them, so that every level is one matrix product over the rows that are left.
    """
    levels = [(statistics(queries, n), statistics(rows, n)) for n in LEVELS]
    reach = np.linalg.norm(rows, axis=1).max(initial=0.0)
    first = min(FIRST, len(rows))
    for at in range(0, len(queries), QUERIES_AT_ONCE):
        now = slice(at, at + QUERIES_AT_ONCE)
        q = queries[now]
        slack = 1e-9 * (np.linalg.norm(q, axis=1) * reach + 1)[:, None]  # rounding of the bounds
        left, bar = np.arange(len(rows)), None
        for mine, theirs in levels:
            bound = mine[now] @ theirs[left].T + slack
            bound[query_ids[now, None] == ids[left][None, :]] = -np.inf
            if bar is None:  # the k-th best of the most promising rows
                top = np.argpartition(-bound, first - 1, axis=1)[:, :first]
                score = np.einsum("qd,qnd->qn", q, rows[top])
                score[np.isneginf(np.take_along_axis(bound, top, axis=1))] = -np.inf
                bar = np.full(len(q), -np.inf) if first < k else -np.partition(-score, k - 1, axis=1)[:, k - 1]
            left = left[(bound >= np.maximum(bar, -1e300)[:, None]).any(axis=0)]
        score = q @ rows[left].T
        score[query_ids[now, None] == ids[left][None, :]] = -np.inf
        if len(left) > k:
            bar = np.maximum(bar, -np.partition(-score, k - 1, axis=1)[:, k - 1])
        i, j = np.nonzero((score >= bar[:, None]) & ~np.isneginf(score))
        score, j = score[i, j], left[j]
        order = np.lexsort((ids[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, i) < k
        yield at + i[best], j[best], score[best]


def whole_vectors(vectors: DataFrame, key: str, vector: str, scale: float) -> DataFrame:
    """(id, d, x): floor(scale * component) of the vectors that take part, as bytes of doubles."""
    shape = "id long, d int, x binary"

    def run(batches):
        for part in slices(batches, 4096):
            found = []
            for i, v in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                if i is not None and v and not any(c is None for c in v):
                    x = np.floor(scale * np.asarray(v, np.float64))
                    if np.isfinite(x).all():
                        found.append((i, len(x), x.tobytes()))
            ids, size, data = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int32()), pa.array(data, pa.binary())],
                                             names=["id", "d", "x"])

    return vectors.select(vectors[key].cast("long").alias("id"), vectors[vector].alias("v")).mapInArrow(run, shape)


def top_k(vectors: DataFrame, is_query, *, k: int = 20, scale: float = 64.0, key: str = "vec_id", vector: str = "embedding",
          query_rows: int = 1024, candidate_rows: int = 8192) -> DataFrame:
    """(query_id, rank, key, score) of the k best rows for each row where ``is_query`` (a condition on ``id``) holds."""
    ship_package(vectors.sparkSession)
    rows = keep(whole_vectors(vectors, key, vector, scale), "whole")
    queries = rows.filter(is_query).dropDuplicates(["id"])
    across = max(1, -(-queries.count() // query_rows))
    down = max(1, -(-rows.count() // candidate_rows))
    asked = queries.withColumn("qb", F.pmod(F.hash("id", F.lit(1)), F.lit(across))).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("kind", F.lit(0))
    offered = rows.withColumn("cb", F.pmod(F.hash("id", F.lit(2)), F.lit(down))).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("kind", F.lit(1))
    tasks = asked.select("d", "cb", "qb", "kind", "id", "x").union(offered.select("d", "cb", "qb", "kind", "id", "x"))

    def settle(part):
        sides = [(np.array([i for i, _ in side], np.int64), np.stack([np.frombuffer(x) for _, x in side])) for side in part if side]
        if len(sides) < 2:
            return
        (query_ids, q), (ids, x) = sides
        for i, j, score in search(q, query_ids, x, ids, k):
            yield pa.RecordBatch.from_arrays(
                [pa.array(query_ids[i]), pa.array(ids[j]), pa.array(score.astype(np.int64))], names=["query_id", "row_id", "score"])

    def run(batches):
        now, part = None, ([], [])
        for batch in slices(batches, 4096):
            for d, cb, qb, kind, i, x in zip(*(c.to_pylist() for c in batch.columns)):
                if (d, cb, qb) != now:
                    yield from settle(part)
                    now, part = (d, cb, qb), ([], [])
                part[kind].append((i, x))
        yield from settle(part)

    near = (tasks.repartition("d", "cb", "qb").sortWithinPartitions("d", "cb", "qb", "kind")
            .mapInArrow(run, "query_id long, row_id long, score long"))
    ranking = Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id")
    return near.withColumn("rank", F.row_number().over(ranking)).filter(F.col("rank") <= k).select(
        "query_id", "rank", F.col("row_id").alias(key), "score")
