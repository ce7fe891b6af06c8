"""N-gram Jaccard join by MinHash banding with exact verification.

Words are what stands between ASCII white space in the lower-case text; shingles are runs of ``words`` of them (a shorter text is one
shingle).  Two texts are linked if the Jaccard similarity of their shingle sets is at least ``threshold``.

1. One narrow pass gives every text a key of its words and, for each tree, a path of ``deepest`` MinHash values.
   Equal keys are copies; only one of each goes on.
2. Of each path a prefix is matched whose length follows from the parameters alone, the longest with which texts exactly at the
   threshold share a node in some tree with probability ``recall`` (``matched_depth``): banding of fixed depth.  The texts below
   one node are tied to the smallest of them: as many ties as texts, however many meet there.
3. Ties are settled to candidate groups.  Every link lies within one.
4. Within a group all similarities are exact.  Shingles that most of the group share are turned round (missing instead of
   present), which leaves symmetric differences as they are, so that near copies cost their differences only.  A group beyond
   ``block_shingles`` or ``block_texts`` is dealt to blocks and each pair of blocks is a task's own work; nothing is emitted by pair.

Result: one row per document with its class (smallest key reachable by links) and its number of linked documents, copies
included.  Null and blank texts have no shingles and link with nothing.  Texts are judged, not keys: rows of one key with
different texts have the class and links of their own text.  Rows with a null key get class null and no links.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import keep, slices, texts_of
from tidepool.operators.components import connected_components
from tidepool.session import ship_package

BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_draws = np.random.default_rng(20240229)
LETTERS = _draws.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _draws.integers(1, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Forest:
    words: int = 5
    threshold: float = 0.8
    trees: int = 24
    deepest: int = 8
    recall: float = 0.999
    block_shingles: int = 200_000
    block_texts: int = 512

    @property
    def matched_depth(self) -> int:
        """The longest prefix with which a pair at the threshold meets in some tree with probability ``recall``."""
        depth = self.deepest
        while depth > 1 and 1 - (1 - self.threshold ** depth) ** self.trees < self.recall:
            depth -= 1
        return depth


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(data: bytes, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words of a lower-case text."""
    a = np.frombuffer(data, np.uint8)
    solid = ~BLANK[a]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8)))
    width = edge[1::2] - edge[::2]
    if not len(width):
        return np.empty(0, np.uint64)
    first = np.cumsum(width) - width
    place = (np.arange(int(width.sum())) - np.repeat(first, width)) & 4095
    word = mix(np.add.reduceat(LETTERS[a[solid]] * PLACES[place], first) + width.astype(np.uint64))
    n = max(1, len(word) - words + 1)
    out = np.full(n, words, np.uint64)
    for j in range(min(words, len(word))):
        out = out * STEP + word[j:j + n]
    return np.unique(mix(out))


class Signer:
    def __init__(self, forest: Forest):
        draws = np.random.default_rng(99)
        size = forest.trees * forest.deepest
        self.forest = forest
        self.flip = draws.integers(0, 1 << 32, (size, 1), dtype=np.uint64).astype(np.uint32)
        self.odd = (draws.integers(0, 1 << 31, (2, size, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)).astype(np.uint32)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """(trees, deepest) MinHash values."""
        short = (hashes >> np.uint64(32)).astype(np.uint32)
        least = None
        for at in range(0, len(short), 4096):
            x = (short[at:at + 4096] ^ self.flip) * self.odd[0]
            x ^= x >> np.uint32(16)
            x *= self.odd[1]
            low = x.min(axis=1)
            least = low if least is None else np.minimum(least, low)
        return least.reshape(self.forest.trees, self.forest.deepest)

    def nodes(self, hashes: np.ndarray, depth: int) -> np.ndarray:
        """The trie node, of ``depth`` values, that a text is below in each tree."""
        out = np.arange(1, self.forest.trees + 1, dtype=np.uint64)
        for j, column in enumerate(self.signature(hashes).T):
            if j < depth:
                out = mix(out * STEP + column)
        return out.view(np.int64)


def lowered(text: str) -> bytes:
    return text.lower().encode("utf-8", "surrogatepass")


def words_key(data: bytes) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(data.split()))


def whole(text) -> Column:
    """Digest of a text as it stands."""
    return F.coalesce(F.unhex(F.md5(text)), F.lit(b""))


def paths(docs: DataFrame, forest: Forest, key: str, text: str) -> DataFrame:
    """(id, whole, copy, n, nodes) of every row with a key: digest of the text, hash of its words, number of shingles, trie nodes."""
    depth = forest.matched_depth

    def run(batches):
        signer = Signer(forest)
        for part in slices(batches):
            copy, count, nodes = [], [], []
            for t in texts_of(part, "text"):
                data = lowered(t)
                found = shingles(data, forest.words)
                copy.append(words_key(data))
                count.append(len(found))
                nodes.append(signer.nodes(found, depth) if len(found) else np.empty(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in nodes])]).astype(np.int32)
            flat = np.concatenate(nodes) if nodes else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(copy, pa.binary()), pa.array(count, pa.int32()),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["id", "whole", "copy", "n", "nodes"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(docs[key].alias("id"), whole(docs[text]).alias("whole"), docs[text].alias("text")).filter("id is not null")
    return rows.mapInArrow(run, f"id {kind}, whole binary, copy binary, n int, nodes array<bigint>")


def compare(sets: list[np.ndarray], copies: np.ndarray, threshold: float,
            side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Linked documents of each text, and the smallest position that links reach from it; with ``side``, across sides only."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    owner = np.repeat(np.arange(n), size)
    _, column = np.unique(np.concatenate(sets), return_inverse=True)
    common = np.bincount(column) > n / 2
    lone = ~common[column]
    rare_owner, rare_column = owner[lone], column[lone]
    number = np.cumsum(common) - 1
    has = np.zeros((n, int(common.sum())), bool)
    has[owner[~lone], number[column[~lone]]] = True
    lack_owner, lack_column = np.nonzero(~has)
    owner = np.concatenate([rare_owner, lack_owner])
    column = np.concatenate([rare_column, np.flatnonzero(common)[lack_column]])
    apart = np.bincount(owner, minlength=n)  # distance from the common part
    shared = np.bincount(column, minlength=1)[column] > 1 if len(column) else np.empty(0, bool)
    owner, column = owner[shared], column[shared]
    by_column = np.argsort(column, kind="stable")
    posting = owner[by_column]
    first = np.searchsorted(column[by_column], column)
    length = np.searchsorted(column[by_column], column, side="right") - first
    by_owner = np.argsort(owner, kind="stable")
    bounds = np.searchsorted(owner[by_owner], np.arange(n + 1))
    links, root = np.zeros(n, np.int64), np.arange(n)
    for x in range(n):
        mine = by_owner[bounds[x]:bounds[x + 1]]
        run = length[mine]
        places = np.repeat(first[mine] - (np.cumsum(run) - run), run) + np.arange(int(run.sum()))
        both = np.bincount(posting[places], minlength=n)
        inter = (size[x] + size - (apart[x] + apart - 2 * both)) // 2
        near = inter / (size[x] + size - inter) >= threshold
        near[x] = False
        if side is not None:
            near &= side != side[x]
        found = np.flatnonzero(near)
        if len(found):
            links[x] = copies[found].sum()
            roots = np.unique(np.append(root[found], root[x]))
            if len(roots) > 1:
                root[np.isin(root, roots)] = roots[0]
    return links, root


def _verify(forest: Forest):
    """Rows sorted by their part (component, a, b); emits (id, links, root) of every text of every part."""

    def settle(part, rows: dict):
        if len(rows) < 2:
            return [], [], []
        ids, found = [i for i, _ in rows], list(rows.values())
        side = np.array([b for _, _, b in found]) if part[1] != part[2] else None
        links, root = compare([s for s, _, _ in found], np.array([c for _, c, _ in found], np.int64), forest.threshold, side)
        least: dict[int, int] = {}
        for i, r in zip(ids, root.tolist()):
            least[r] = min(i, least.get(r, i))
        return ids, links.tolist(), [least[r] for r in root.tolist()]

    def packed(columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["id", "links", "root"])

    def run(batches):
        part, rows = None, {}
        for batch in slices(batches, 64):
            for *now, i, copy, copies, side, text in zip(*(c.to_pylist() for c in batch.columns)):
                if now != part:
                    if len(rows) > 1:
                        yield packed(settle(part, rows))
                    part, rows = now, {}
                data = lowered(text or "")
                if words_key(data) == copy:  # else another row of the same document
                    rows[i, copy] = (shingles(data, forest.words), copies, side)
        yield packed(settle(part, rows))

    return run


def join(docs: DataFrame, forest: Forest = Forest(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, class_id, n_links) of every row; ``key`` is a whole number."""
    return judge(docs, forest, key=key, text=text).select(key, "class_id", "n_links")


def judge(docs: DataFrame, forest: Forest = Forest(), *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, whole, class_id, n_links, first) of every row.

    ``whole`` is the digest of the text and ``first`` says whether (key, whole) stands for its class: one such pair in each
    class, and every row without shingles or key.
    """
    ship_package(docs.sparkSession)
    docs = docs.select(docs[key].cast("long").alias("id"), docs[text].alias("text"))
    path = keep(paths(docs, forest, "id", "text"), "paths")
    # Every set of copies has a number of its own, in the order of its smallest row: one key may stand on several texts.
    copies = keep(path.groupBy("copy").agg(F.min(F.struct("id", "whole")).alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"))
                  .select("copy", F.col("rep.id").alias("rep"), F.col("rep.whole").alias("whole"), "copies", "n")
                  .orderBy("rep", "whole").withColumn("number", F.monotonically_increasing_id()), "copies")
    # One text of each set of copies is below a node of every tree.
    below = (path.filter("n > 0").join(copies.select("copy", F.col("rep").alias("id"), "whole", "number"), ["copy", "id", "whole"])
             .select(F.col("number").alias("id"), F.explode("nodes").alias("node")))
    tops = below.groupBy("node").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    ties = keep(below.join(tops, "node").filter("id > low").select(F.col("id").alias("src"), F.col("low").alias("dst")).distinct(),
                "ties")
    groups = connected_components(ties.select(F.col("src").alias("node")).union(ties.select("dst")), ties)
    member = keep(groups.withColumnRenamed("node", "number").join(copies.filter("n > 0"), "number"), "members")
    total = (member.groupBy("component").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"))
             .select("component", F.greatest(F.ceil(F.col("shingles") / forest.block_shingles),
                                             F.ceil(F.col("texts") / forest.block_texts)).cast("int").alias("blocks")))
    parts = (member.join(total, "component").withColumn("side", F.pmod(F.hash("copy", F.lit(5)), "blocks"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select("component", F.least("side", "other").alias("a"), F.greatest("side", "other").alias("b"),
                     "number", "rep", "whole", "copy", "copies", "side"))
    found = keep(docs.withColumn("whole", whole(F.col("text"))).withColumnRenamed("id", "rep").join(parts.hint("shuffle_hash"), ["rep", "whole"])
                 .select("component", "a", "b", "number", "copy", "copies", "side", "text")
                 .repartition("component", "a", "b").sortWithinPartitions("component", "a", "b")
                 .mapInArrow(_verify(forest), "id long, links long, root long"), "links")
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    edges = found.filter("root <> id").select(F.col("id").alias("src"), F.col("root").alias("dst"))
    classes = connected_components(links.select(F.col("id").alias("node")), edges).select(
        F.col("node").alias("number"), F.col("component").alias("root"))
    # Numbers follow the keys, so the smallest number of a class has its smallest key.
    classes = classes.join(copies.select(F.col("number").alias("root"), F.col("rep").alias("class")), "root")
    known = copies.join(links.withColumnRenamed("id", "number"), "number", "left").join(classes, "number", "left").select(
        "copy", "rep", F.col("whole").alias("_whole"), F.when(F.col("n") > 0, F.coalesce("class", "rep")).alias("class"),
        (F.coalesce("root", "number") == F.col("number")).alias("root"),
        F.when(F.col("n") > 0, F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("links"))
    rows = path.select("id", "whole", "copy").join(known, "copy").select(
        F.col("id").alias(key), "whole", F.coalesce("class", "id").alias("class_id"), F.col("links").cast("long").alias("n_links"),
        (F.col("class").isNull() | F.col("root") & (F.col("id") == F.col("rep")) & (F.col("whole") == F.col("_whole"))).alias("first"))
    lost = docs.filter("id is null").select(F.col("id").alias(key), whole(F.col("text")).alias("whole"), F.col("id").alias("class_id"),
                                            F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("first"))
    return rows.unionByName(lost)
