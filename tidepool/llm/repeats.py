"""Passages that stand in an earlier document, found by prefix-free parsing and sorted suffixes.

Texts are bytes.  A byte goes if a string of ``length`` bytes that covers it also begins in a document with a smaller id.

*Parsing.*  A rolling hash runs over ``gram`` bytes.  The least hash among those inside a string of ``length`` bytes is its trigger (the leftmost
of equals), so equal strings have equal triggers at equal places, whatever surrounds them.  Consecutive strings with one trigger
are one *phrase*: from the first one's start to the last one's end.  A document is its sequence of phrases, and every string of ``length`` bytes lies
in just one of them; the overlap of neighbours is what keeps phrases apart from one another's prefixes.

*Dictionary and order.*  Whole texts come first: a document whose text an earlier one has is a repeat from end to end and goes no further.  A phrase can only share a string with phrases of its trigger.  Phrases whose trigger no other document has are dropped
before their bytes are shipped: a corpus mostly made of copies leaves few distinct ones.  Equal phrases are one entry of the dictionary, which
keeps the smallest id it occurs in; an occurrence in a later document is a repeat as a whole.  The suffixes of the entries are sorted to a
depth of ``length`` bytes, one range of triggers at a time, which puts equal strings next to each other in corpus order; each such
group is known by its smallest id, and what the entry's own document finds there from earlier ones are its partial repeats.  The parse (which
entry stands where in which document) turns entries back to places.

*Crowds.*  The occurrences of a trigger that more than ``crowd`` documents share, by count or by what a sample lets expect, do not meet in one task: an
aggregation makes their dictionary, only its entries are sorted by trigger, and the parse is joined back with common entries dealt over
several tasks.  Should even the entries of one trigger be more than ``crowd``, their suffixes are grouped as rows instead, summed before the
shuffle.  All ways give the same, no unbounded group is held in memory, and no pairs are made.

Null text is empty.  A row with a null id keeps all its bytes and is no reason to remove others'.  Rows of one id are judged each by itself:
none is earlier than another.  Texts of fewer than ``length`` bytes keep all.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepool.llm.common import Steps, keep, slices
from tidepool.session import ship_package

SLICE_BYTES = 1 << 20
SORTED_AT_ONCE = 16_384  # phrases, more only if one trigger has more


@dataclass(frozen=True)
class Repeats:
    length: int = 50
    gram: int = 24
    crowd: int = 32_768
    sampled: int = 2000  # documents looked at for common triggers
    common: int = 8      # of them that a trigger must be in to be thought to have a crowd
    seed: int = 13

    def __post_init__(self):
        if not 0 < self.gram <= self.length:
            raise ValueError("gram must be between 1 and length")


# ---- parsing -------------------------------------------------------------------------------------


class Parser:
    """Phrases of byte strings."""

    def __init__(self, how: Repeats):
        self.how = how
        draws = np.random.default_rng(how.seed)
        self.letters = draws.integers(1, 1 << 63, 256, dtype=np.uint64)
        self.base = int(draws.integers(1 << 62, 1 << 63)) | 1
        self.power = self.inverse = np.zeros(0, np.uint64)

    def rolling(self, data: np.ndarray) -> np.ndarray:
        """Hash of the ``gram`` bytes from every position."""
        w = self.how.gram
        if len(data) > len(self.power):
            size = max(len(data), 2 * SLICE_BYTES)
            self.power = np.cumprod(np.r_[np.uint64(1), np.full(size, self.base, np.uint64)], dtype=np.uint64)
            self.inverse = np.cumprod(np.r_[np.uint64(1), np.full(size, pow(self.base, -1, 1 << 64), np.uint64)], dtype=np.uint64)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.letters[data] * self.power[:len(data)], dtype=np.uint64)])
        h = (sums[w:] - sums[:-w]) * self.inverse[:len(data) - w + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        return h

    def phrases(self, texts: list[bytes]):
        """(data, number of text, offset in it, start and end in data, trigger) of the phrases, in pieces of bounded size."""
        part, size = [], 0
        for i, t in enumerate(texts):
            for at in range(0, len(t) - self.how.length + 1, SLICE_BYTES):
                piece = t[at:at + SLICE_BYTES + self.how.length - 1]
                if part and size + len(piece) > SLICE_BYTES + self.how.length:
                    yield self._parse(part)
                    part, size = [], 0
                part.append((i, at, piece))
                size += len(piece)
        if part:
            yield self._parse(part)

    def _parse(self, part):
        length, among = self.how.length, self.how.length - self.how.gram + 1
        data = np.frombuffer(b"".join(p for _, _, p in part), np.uint8)
        sizes = np.array([len(p) for _, _, p in part])
        begin = np.cumsum(sizes) - sizes
        h = self.rolling(data)
        least = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        span = 1
        while 2 * span <= among:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < among:
            least = np.minimum(least[:len(least) - (among - span)], least[among - span:])
        trigger = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
        strings = sizes - length + 1
        start = np.repeat(begin - np.cumsum(strings) + strings, strings) + np.arange(strings.sum())
        owner = np.repeat(np.arange(len(part)), strings)
        at = trigger[start]
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (owner[1:] != owner[:-1])])
        last = np.r_[first[1:], len(start)] - 1
        piece = owner[first]
        number, offset = np.array([i for i, _, _ in part])[piece], np.array([a for _, a, _ in part])[piece]
        low = start[first]
        return data, number, offset + low - begin[piece], low, start[last] + length, h[at[first]].view(np.int64)


def _texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.to_pylist()]


def _triggers(docs: DataFrame, how: Repeats, common: frozenset) -> DataFrame:
    """(trigger, row): distinct within a piece, without the common ones."""

    def run(batches):
        parser = Parser(how)
        known = np.array(sorted(common), np.int64)
        for batch in slices(batches):
            rows = batch.column(0).to_numpy()
            for _, number, _, _, _, trigger in parser.phrases(_texts(batch.column(1))):
                order = np.lexsort((trigger, number))
                number, trigger = number[order], trigger[order]
                new = np.r_[True, (number[1:] != number[:-1]) | (trigger[1:] != trigger[:-1])] & ~np.isin(trigger, known)
                yield pa.RecordBatch.from_arrays([pa.array(trigger[new]), pa.array(rows[number[new]])], names=["trigger", "row"])

    return docs.select("row", "data").mapInArrow(run, "trigger long, row long")


PHRASE = "trigger long, crowded boolean, digest binary, x binary, doc long, row long, places array<long>"


def _shared(docs: DataFrame, how: Repeats, common: frozenset) -> DataFrame:
    """Phrases with a trigger of other documents, once a document; ``docs`` has the document's lists of such triggers."""

    def run(batches):
        parser = Parser(how)
        for batch in slices(batches):
            rows, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            few, many = ([frozenset(v or ()) for v in batch.column(c).to_pylist()] for c in (3, 4))
            for data, number, offset, low, high, trigger in parser.phrases(_texts(batch.column(2))):
                raw, found = data.tobytes(), {}
                for i, at, a, b, t in zip(number.tolist(), offset.tolist(), low.tolist(), high.tolist(), trigger.tolist()):
                    if t in few[i] or t in many[i] or t in common:
                        found.setdefault((i, raw[a:b], t), []).append(at)
                if found:
                    where = np.array([i for i, _, _ in found])
                    crowded = [t not in few[i] for i, _, t in found]
                    digest = [xxhash.xxh3_128_digest(x) if c else None for (_, x, _), c in zip(found, crowded)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([t for _, _, t in found], pa.int64()), pa.array(crowded), pa.array(digest, pa.binary()),
                         pa.array([x for _, x, _ in found], pa.binary()), pa.array(ids[where]), pa.array(rows[where]),
                         pa.array(list(found.values()), pa.list_(pa.int64()))],
                        names=["trigger", "crowded", "digest", "x", "doc", "row", "places"])

    return docs.select("row", "doc", "data", "few", "many").mapInArrow(run, PHRASE)


# ---- dictionary and its suffixes --------------------------------------------------------------------


def sorted_suffixes(entries: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of at least ``length`` bytes in order of those bytes.

    Returns (entry of each, its offset there, number of the group of equal ones), in sorted order.
    """
    sizes = np.array([len(e) for e in entries])
    count = sizes - length + 1
    entry = np.repeat(np.arange(len(entries)), count)
    offset = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    data = np.frombuffer(b"".join(entries) + bytes(length + 16), np.uint8).astype(np.uint64)
    eight = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        eight |= data[k:len(data) - 7 + k] << np.uint64(56 - 8 * k)
    at = np.repeat(np.cumsum(sizes) - sizes, count) + offset
    words = [eight[at + k] for k in range(0, length, 8)]
    if length % 8:
        words[-1] = words[-1] >> np.uint64(64 - 8 * (length % 8))
    order = np.lexsort(words[::-1])
    new = np.zeros(len(order), bool)
    for w in words:
        w = w[order]
        new[1:] |= w[1:] != w[:-1]
    return entry[order], offset[order], np.cumsum(new)


def earlier_stretches(entries: list[bytes], first: np.ndarray, length: int) -> dict[int, list[tuple[int, int]]]:
    """Stretches of each entry whose strings stand in an entry that an earlier document has."""
    entry, offset, group = sorted_suffixes(entries, length)
    heads = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    earlier = np.minimum.reduceat(first[entry], heads)[group] < first[entry]
    e, o = entry[earlier], offset[earlier]
    order = np.lexsort((o, e))
    e, o = e[order], o[order]
    found: dict[int, list[tuple[int, int]]] = {}
    if len(e):
        begin = np.flatnonzero(np.r_[True, (e[1:] != e[:-1]) | (o[1:] != o[:-1] + 1)])
        end = np.r_[begin[1:], len(e)] - 1
        for i, a, b in zip(e[begin].tolist(), o[begin].tolist(), o[end].tolist()):
            found.setdefault(i, []).append((a, b + length))
    return found


def repeats_of(xs: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, dict[int, list[tuple[int, int]]]]:
    """Occurrences that stand as a whole in an earlier document, and the repeated stretches of the others."""
    entry_of: dict[bytes, int] = {}
    which = np.array([entry_of.setdefault(x, len(entry_of)) for x in xs])
    first = np.full(len(entry_of), np.iinfo(np.int64).max)
    np.minimum.at(first, which, docs)
    stretches = earlier_stretches(list(entry_of), first, length)
    whole = docs > first[which]
    return whole, {int(r): stretches[w] for r, w in enumerate(which.tolist()) if not whole[r] and w in stretches}


def by_trigger(batches, settle, aside=None):
    """``settle`` of tables of whole groups of a trigger; the rows come sorted by it.  ``aside`` takes rows out first and settles them by itself."""
    waiting, rows = [], 0
    for batch in slices(batches, 4096):
        if aside is not None:
            batch, settled = aside(batch)
            yield from settled
            if not batch.num_rows:
                continue
        waiting.append(batch)
        rows += batch.num_rows
        if rows < SORTED_AT_ONCE:
            continue
        table = pa.Table.from_batches(waiting)
        key = table["trigger"].to_numpy()
        if key[0] != key[-1]:
            cut = int(np.flatnonzero(key[1:] != key[:-1])[-1]) + 1
            yield settle(table.slice(0, cut))
            waiting, rows = table.slice(cut).to_batches(), table.num_rows - cut
    if rows:
        yield settle(pa.Table.from_batches(waiting))


SPAN = "doc long, row long, low long, high long"


def _spans(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], [], [], []))],
                                      names=["doc", "row", "low", "high"])


def _sorted(phrases: DataFrame, how: Repeats) -> DataFrame:
    """Repeated spans of phrases that stand together by trigger."""

    def settle(table: pa.Table):
        xs, docs = table["x"].to_pylist(), table["doc"].to_numpy()
        whole, partly = repeats_of(xs, docs, how.length)
        rows, places = table["row"].to_pylist(), table["places"]
        out = []
        for r in np.flatnonzero(whole).tolist():
            out += [(int(docs[r]), rows[r], at, at + len(xs[r])) for at in places[r].as_py()]
        for r, spans in partly.items():
            out += [(int(docs[r]), rows[r], at + a, at + b) for at in places[r].as_py() for a, b in spans]
        return _spans(out)

    return (phrases.select("trigger", "x", "doc", "row", "places").repartition("trigger").sortWithinPartitions("trigger", "doc")
            .mapInArrow(lambda batches: by_trigger(batches, settle), SPAN))


# ---- triggers of a crowd ------------------------------------------------------------------------------


def joined_back(rows: DataFrame, firsts: DataFrame, key: str, dealt_by: Column) -> DataFrame:
    """Inner join of ``rows`` with ``firsts`` (one row a key, with its number of rows as ``rows``), common keys dealt over several tasks.

    At most 20,000 keys count as common, so that their list can be broadcast.
    """
    total = firsts.agg(F.sum("rows")).first()[0] or 0
    most = max(1000, total // 20_000)
    common = F.broadcast(firsts.filter(F.col("rows") > most).select(key, F.ceil(F.col("rows") / most).cast("int").alias("parts")))
    dealt = rows.join(common, key, "left").withColumn("part", F.pmod(F.xxhash64(dealt_by), F.coalesce("parts", F.lit(1)))).drop("parts")
    last = F.when(F.col("rows") > most, F.ceil(F.col("rows") / most).cast("long") - 1).otherwise(0).cast("long")
    copied = firsts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last))).drop("rows")
    return dealt.join(copied, [key, "part"]).drop("part")


STRETCH = "digest binary, low long, high long, suffix binary, first long"


def _stretches(entries: DataFrame, how: Repeats) -> DataFrame:
    """(digest, low, high) of repeated stretches of entries; of a trigger with too many entries one row a suffix, to be grouped."""
    length = how.length
    kinds = [pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.int64()]

    def packed(found):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found) if found else [()] * 5, kinds)],
                                          names=["digest", "low", "high", "suffix", "first"])

    def settle(table: pa.Table):
        digests, first = table["digest"].to_pylist(), table["first"].to_numpy()
        return packed([(digests[i], a, b, None, None)
                       for i, spans in earlier_stretches(table["x"].to_pylist(), first, length).items() for a, b in spans])

    def aside(batch):
        many = batch.column("entries").to_numpy() > how.crowd
        if not many.any():
            return batch, []
        dense = batch.filter(pa.array(many))
        parts = (dense.slice(k, 256) for k in range(0, dense.num_rows, 256))
        return batch.filter(pa.array(~many)), (
            packed([(d, k, k + length, x[k:k + length], f) for d, x, f in zip(*(p.column(c).to_pylist() for c in ("digest", "x", "first")))
                    for k in range(len(x) - length + 1)]) for p in parts)

    sized = entries.withColumn("entries", F.count("*").over(Window.partitionBy("trigger")))
    return sized.select("trigger", "digest", "x", "first", "entries").sortWithinPartitions("trigger").mapInArrow(
        lambda batches: by_trigger(batches, settle, aside), STRETCH)


def _crowd(phrases: DataFrame, how: Repeats, steps: Steps) -> DataFrame:
    """Repeated spans of phrases with common triggers."""
    entries = steps.keep(phrases.groupBy("digest").agg(F.min("doc").alias("first"), F.first("trigger").alias("trigger"), F.first("x").alias("x"),
                                                       F.count("*").alias("rows")), "entries")
    found = steps.keep(_stretches(entries.drop("rows"), how), "stretches")
    dense = found.filter("suffix is not null")
    shared = steps.keep(dense.groupBy("suffix").agg(F.min("first").alias("least"), F.max("first").alias("most"), F.count("*").alias("rows"))
                        .filter("least < most").drop("most"), "suffixes")
    late = joined_back(dense, shared, "suffix", F.col("digest")).filter("first > least").select("digest", "low", "high")
    partly = found.filter("suffix is null").select("digest", "low", "high").unionByName(late)
    known = steps.keep(entries.select("digest", "first", "rows").unionByName(partly, allowMissingColumns=True).groupBy("digest").agg(
        F.max("first").alias("first"), F.max("rows").alias("rows"),
        F.collect_list(F.when(F.col("low").isNotNull(), F.struct("low", "high"))).alias("stretches")), "known")
    seen = joined_back(phrases.select("digest", F.length("x").cast("long").alias("size"), "doc", "row", "places"), known, "digest", F.col("row"))
    whole = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("size").alias("high")))
    parts = seen.withColumn("part", F.when(F.col("doc") > F.col("first"), whole).otherwise(F.col("stretches"))).filter("size(part) > 0")
    return parts.select("doc", "row", F.explode("places").alias("at"), "part").select("doc", "row", "at", F.inline("part")).select(
        "doc", "row", (F.col("at") + F.col("low")).alias("low"), (F.col("at") + F.col("high")).alias("high"))


# ---- the operator ---------------------------------------------------------------------------------------


def _identified(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc, row, data): ``row`` tells rows of one id apart."""
    source = docs.select(docs[key].cast("long").alias("doc"), F.coalesce(docs[text], F.lit("")).cast("binary").alias("data"))
    unique = source.filter("doc is not null").groupBy("doc").count().filter("count > 1").isEmpty()
    return source.withColumn("row", F.col("doc") if unique else F.when(F.col("doc").isNotNull(), F.xxhash64("doc", "data")))


def _copies(docs: DataFrame) -> DataFrame:
    """(doc, row, size) of documents whose whole text is an earlier one's: the dictionary and parse of whole texts."""
    told = docs.select(F.unhex(F.md5("data")).alias("digest"), "doc", "row", F.length("data").cast("long").alias("size"))
    firsts = keep(told.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count("*").alias("rows"))
                  .filter("first < last").drop("last"), "texts")
    return joined_back(told, firsts, "digest", F.col("row")).filter("doc > first").select("doc", "row", "size")


def spans(docs: DataFrame, how: Repeats = Repeats()) -> DataFrame:
    """(doc, row, low, high) of repeated stretches, which may overlap; ``docs`` is (doc, row, data)."""
    used = docs.filter(F.col("doc").isNotNull() & (F.length("data") >= how.length))
    every = max(1, used.count() // how.sampled)
    seen = used.filter(F.pmod(F.xxhash64("row", F.lit(how.seed)), F.lit(every)) == 0)
    common = frozenset(r["trigger"] for r in _triggers(seen, how, frozenset()).groupBy("trigger").agg(F.count("*").alias("n"))
                       .filter(F.col("n") >= max(how.common, -(-how.crowd // every))).orderBy(F.desc("n"), "trigger").limit(50_000).collect())
    one = Window.partitionBy("trigger")
    met = (_triggers(used, how, common).withColumn("one", F.min("row").over(one)).withColumn("other", F.max("row").over(one))
           .withColumn("crowded", F.count("*").over(one) > how.crowd).filter("one <> other"))
    steps = Steps(docs.sparkSession)
    copies = steps.keep(_copies(used), "copies")
    lists = steps.keep(
        met.select("row", "trigger", "crowded").unionByName(copies.select("row", F.lit(True).alias("copy")), allowMissingColumns=True)
        .groupBy("row").agg(F.collect_list(F.when(~F.col("crowded"), F.col("trigger"))).alias("few"),
                            F.collect_list(F.when(F.col("crowded"), F.col("trigger"))).alias("many"), F.max("copy").alias("copy")), "lists")
    others = used.join(lists, "row", "left").filter("copy is null")
    phrases = steps.keep(_shared(others, how, common), "phrases")
    found = (_sorted(phrases.filter("not crowded"), how).unionByName(_crowd(phrases.filter("crowded"), how, steps))
             .unionByName(copies.select("doc", "row", F.lit(0).cast("long").alias("low"), F.col("size").alias("high"))))
    out = Steps(docs.sparkSession).keep(found, "spans")
    steps.drop(*list(steps.paths))
    return out


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges as maximal runs."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(ranges):
        if out and low <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], high)
        else:
            out.append((low, high))
    return out


def remove(docs: DataFrame, how: Repeats = Repeats(), *, key: str = "doc_id", text: str = "text", content: bool = True) -> DataFrame:
    """(key, n_bytes, n_removed, n_spans, kept_sha256, kept, removed) of every row.

    ``kept`` are the remaining bytes and ``removed`` the maximal runs taken out, both left out without ``content``.
    """
    ship_package(docs.sparkSession)
    source = _identified(docs, key, text)
    lists = spans(source, how).groupBy("doc", "row").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    kind = docs.schema[key].dataType.simpleString()
    ends = pa.struct([("low", pa.int64()), ("high", pa.int64())])
    arrow = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    fields = "n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if content:
        arrow += [("kept", pa.binary()), ("removed", pa.list_(ends))]
        fields += ", kept binary, removed array<struct<low: long, high: long>>"

    def judged(data: bytes, ranges) -> tuple:
        runs = merged([(r["low"], r["high"]) for r in ranges or ()])
        parts, at = [], 0
        for low, high in runs:
            parts.append(data[at:low])
            at = high
        rest = b"".join(parts) + data[at:] if runs else data
        told = len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()
        return (*told, rest, [{"low": a, "high": b} for a, b in runs]) if content else told

    def run(batches):
        for batch in slices(batches):
            out = [judged(*r) for r in zip(_texts(batch.column(1)), batch.column(2).to_pylist())]
            columns = zip(*out) if out else [[] for _ in arrow]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, kind) for c, (_, kind) in zip(columns, arrow))],
                                             names=["doc", *(name for name, _ in arrow)])

    done = source.join(lists, ["doc", "row"], "left").select("doc", "data", "ranges").mapInArrow(run, f"doc long, {fields}")
    return done.withColumnRenamed("doc", key).withColumn(key, F.col(key).cast(kind))
