"""Best-fit packing of token sequences by a configuration linear program over the histogram of lengths.

Documents are encoded, closed by an end id and, where longer than ``capacity``, cut into full pieces behind a shorter first one.
What is to be packed is known by its histogram alone: at most ``capacity`` counts, whatever the corpus.

The linear program asks for the fewest sequences, each filled after some configuration (how many pieces of which length), so that
all pieces find a place.  Multiplicative weights solve it: every length has a price that falls as it gets covered; a knapsack by
dynamic programming finds the configurations of highest price.  The amounts are then rounded, without ever placing
more than there is; what is left is solved and rounded again, and a last rest is packed by best fit.

Pieces take their places by rank within their length.  Ranks are dealt over hashed buckets, so that a very common length is
split, and the places, a sorted table no larger than the configurations, go to the tasks.

A null text counts as empty: one piece with the end id alone.  Repeated rows are packed as often as they stand in the table.
"""

from __future__ import annotations

import json
import zlib
from array import array
from bisect import bisect_left, insort
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.bpe import PATTERN, Chunks, token_bytes
from tidepool.llm.common import keep, slices, texts_of
from tidepool.session import ship_package

STEP = 1.0  # share of a length's pieces that one step may cover
SHARPNESS = 0.1  # how fast prices fall with coverage
SLACK = 0.1  # how far below the best price a configuration may be to be taken in the same step
ROUNDS = 3

Plan = list[tuple[dict[int, int], int]]


class Ids(Chunks):
    """Ids of whole texts, those of the tokenizer file: common chunks from a cache, new ones from the byte-pair ranks."""

    def __init__(self, tokenizer: str):
        import tiktoken

        with open(tokenizer, encoding="utf-8") as file:
            spec = json.load(file)
        super().__init__({t["content"]: t["id"] for t in spec["added_tokens"]})
        vocab = spec["model"]["vocab"]
        made = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in spec["model"]["merges"]]
        if made != sorted(made):
            raise ValueError("ids of the tokenizer do not follow its merges, so they are no ranks")
        self.coding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks={b: n for n, b in token_bytes(spec).items()},
                                        special_tokens={})

    def _by_pattern(self, text: str) -> bytes:
        return array("I", self.coding.encode_ordinary(text)).tobytes()


@lru_cache(maxsize=1)
def _ids(tokenizer: str) -> Ids:
    return Ids(tokenizer)


def pieces(docs: DataFrame, tokenizer: str, *, capacity: int, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32) of every document's pieces, in one narrow pass."""
    ship_package(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        encode = _ids(tokenizer).encode
        for part in slices(batches):
            row, number, start, length, check = [], [], [], [], []
            for i, t in enumerate(texts_of(part, "text")):
                ids = np.append(encode(t), np.uint32(end_id)).astype("<u4")
                at, k = 0, 0
                to = len(ids) % capacity or capacity
                while at < len(ids):
                    row.append(i)
                    number.append(k)
                    start.append(at)
                    length.append(to - at)
                    check.append(zlib.crc32(ids[at:to]))
                    at, to, k = to, to + capacity, k + 1
            yield pa.RecordBatch.from_arrays(
                [part.column(0).take(pa.array(row, pa.int64())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(check, pa.int64())], names=[key, "piece", "start", "length", "ids_crc32"])

    return docs.select(docs[key], docs[text].alias("text")).mapInArrow(
        run, f"{key} {kind}, piece int, start long, length long, ids_crc32 long")


def _knapsack(lengths: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Best price for each room up to ``capacity``, and the position of one length in it (-1: none, go one down)."""
    best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fits = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        if n := fits[room]:
            value = best[room - lengths[:n]] + prices[:n]
            k = int(value.argmax())
            if value[k] > best[room] + 1e-12:
                best[room], pick[room] = value[k], k
    return best, pick


def _configuration(first: int, lengths: np.ndarray, pick: np.ndarray, capacity: int) -> dict[int, int]:
    """Counts by position of the length: ``first``, then the best for the room it leaves."""
    out, room = {first: 1}, capacity - int(lengths[first])
    while room > 0:
        k = int(pick[room])
        if k < 0:
            room -= 1
        else:
            out[k] = out.get(k, 0) + 1
            room -= int(lengths[k])
    return out


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int) -> dict[tuple, float]:
    """Fractional amounts of configurations (pairs of position and number) that cover all counts, by multiplicative weights."""
    covered = np.zeros(len(lengths))
    amounts: dict[tuple, float] = {}
    while (open_ := covered < 1 - 1e-9).any():
        # A length's weight starts as its share of all tokens.
        prices = np.where(open_, lengths * np.exp(-SHARPNESS * covered), 0.0)
        best, pick = _knapsack(lengths, prices, capacity)
        value = prices + best[capacity - lengths]
        used: set[int] = set()
        for k in np.flatnonzero(value >= (1 - SLACK) * best[capacity])[::-1]:  # the longest first, they are the hardest
            if not open_[k] or k in used:
                continue
            config = _configuration(int(k), lengths, pick, capacity)
            if used & config.keys():
                continue
            used |= config.keys()
            amount = min(min(STEP, 1 - covered[j]) * counts[j] / c for j, c in config.items())
            for j, c in config.items():
                covered[j] += amount * c / counts[j]
            name = tuple(sorted(config.items()))
            amounts[name] = amounts.get(name, 0.0) + amount
    return amounts


def plan(histogram: dict[int, int], capacity: int) -> Plan:
    """(configuration, number of sequences) that place every piece of the histogram exactly once.

    The rounded program, or plain best fit of all pieces should that need fewer sequences.
    """
    rounded, plain = rounded_plan(histogram, capacity), best_fit({n: c for n, c in histogram.items() if c > 0}, capacity)
    return plain if sum(t for _, t in plain) < sum(t for _, t in rounded) else rounded


def rounded_plan(histogram: dict[int, int], capacity: int) -> Plan:
    """Configurations of the linear program in whole numbers, and best fit for what they leave."""
    left = {n: c for n, c in histogram.items() if c > 0}
    out: Plan = []
    for _ in range(ROUNDS):
        if not left:
            break
        lengths = np.array(sorted(left), np.int64)
        rest = np.array([left[n] for n in lengths.tolist()], np.int64)
        placed = 0
        for config, amount in sorted(solve(lengths, rest.astype(float), capacity).items(), key=lambda x: (-x[1], x[0])):
            # A configuration that wastes room is left for the next round, as long as better ones go.
            times = min(int(np.ceil(amount - 1e-9)), *[int(rest[k]) // c for k, c in config])
            full = sum(int(lengths[k]) * c for k, c in config) >= 0.99 * capacity
            if times > 0 and full:
                for k, c in config:
                    rest[k] -= times * c
                placed += times
                out.append(({int(lengths[k]): c for k, c in config}, times))
        left = {int(n): int(c) for n, c in zip(lengths, rest) if c}
        if not placed:
            break
    return out + best_fit(left, capacity)


def best_fit(histogram: dict[int, int], capacity: int) -> Plan:
    """The longest pieces first, each where it leaves least room.

    Works on groups of equal sequences, so its steps depend on the lengths and not on how many pieces there are.
    """
    rooms: list[tuple[int, int]] = []  # (room left, number of the group), sorted
    held: list[tuple[dict[int, int], int]] = []

    def put(config: dict[int, int], times: int) -> None:
        if times:
            held.append((config, times))
            insort(rooms, (capacity - sum(n * c for n, c in config.items()), len(held) - 1))

    for n in sorted(histogram, reverse=True):
        many = histogram[n]
        while many:
            at = bisect_left(rooms, (n, -1))
            if at < len(rooms):
                room, group = rooms.pop(at)
                config, times = held[group]
            else:
                room, group, config, times = capacity, -1, {}, -(-many // (capacity // n))
            each = room // n
            whole = min(times, many // each)
            if whole:
                put({**config, n: each}, whole)
                many -= whole * each
            if whole < times and many:  # fewer than one more sequence takes
                put({**config, n: many}, 1)
                many, whole = 0, whole + 1
            if group >= 0:
                put(config, times - whole)
                held[group] = (config, 0)
    return [held[k] for _, k in rooms]


@dataclass
class Places:
    """For each length, intervals of ranks: where they start, the first sequence, pieces a sequence takes, the offset of the first."""

    key: np.ndarray
    sequence: np.ndarray
    each: np.ndarray
    offset: np.ndarray

    SHIFT = 44  # bits of a rank

    @classmethod
    def of(cls, chosen: Plan) -> Places:
        next_rank: dict[int, int] = {}
        rows, sequence = [], 0
        for config, times in chosen:
            offset = 0
            for n in sorted(config, reverse=True):
                rank = next_rank.get(n, 0)
                rows.append(((n << cls.SHIFT) + rank, sequence, config[n], offset))
                next_rank[n] = rank + times * config[n]
                offset += n * config[n]
            sequence += times
        rows.sort()
        return cls(*(np.array(c, np.int64) for c in (zip(*rows) if rows else ((), (), (), ()))))

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << self.SHIFT) + rank
        at = np.searchsorted(self.key, key, side="right") - 1
        within = key - self.key[at]
        return self.sequence[at] + within // self.each[at], self.offset[at] + within % self.each[at] * length


def ranked(rows: DataFrame, total: int, *, order: list[str], rows_per_bucket: int = 50_000) -> DataFrame:
    """Adds ``rank``, from 0 within the rows of a length; each length is dealt to hashed buckets and ranked in each."""
    buckets = max(1, -(-total // rows_per_bucket))
    dealt = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n")).select(
        "length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("length", "bucket").orderBy(*order))
    return dealt.withColumn("_place", place - 1).join(offsets, ["length", "bucket"]).withColumn(
        "rank", F.col("before") + F.col("_place")).drop("_place", "before", "bucket")


def pack(docs: DataFrame, tokenizer: str, *, capacity: int = 1024, end_id: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    cut = keep(pieces(docs, tokenizer, capacity=capacity, end_id=end_id, key=key, text=text), "pieces")
    histogram = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    places = Places.of(plan(histogram, capacity))
    order = [key, "piece", "start", "ids_crc32"]
    names = [*cut.columns, "sequence_id", "offset"]
    shape = cut.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")}).schema

    def run(batches):
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False)
            length = batch.column(names.index("length")).to_numpy(zero_copy_only=False)
            sequence, offset = places.find(length, rank) if len(rank) else (rank, rank)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                                             names=names)

    return ranked(cut, sum(histogram.values()), order=order).select(*cut.columns, "rank").mapInArrow(run, shape)
